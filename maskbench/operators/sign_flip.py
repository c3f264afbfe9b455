"""Sign-flip test by partial sums: a task adds its rows to every permutation's sum at once."""

from __future__ import annotations

import hashlib
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BITS = 128  # signs that one md5 gives
WIDTH = 1024  # permutations whose sums travel in one row of 8 KB
ROWS = 128  # rows whose signs a task unpacks at a time


def _flips(units: Sequence[str], n_perm: int, seed: int) -> np.ndarray:
    """One row per unit with a 1 for every permutation that turns its sign."""
    blocks = range(-(-n_perm // BITS))
    raw = b"".join(hashlib.md5(f"{seed}|{b}|{u}".encode()).digest() for u in units for b in blocks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(units), -1), axis=1)[:, :n_perm]


def sign_flip_test(df: DataFrame, keys: Sequence[str], unit: Sequence[str], diff: str,
                   n_perm: int = 20000, seed: int = 0) -> DataFrame:
    """Two-sided sign-flip test of a zero mean: |sum of randomly signed differences|.

    Signs are md5 bits of (seed, block of permutations, unit). A task reads its rows key by key and keeps one vector
    of sums; what is shuffled is that vector, in pieces, once per task and key. Zero, NULL and NaN differences
    are left out; a key without any other gives no row.
    """
    keys = list(keys)
    d = df.where(F.col(diff).isNotNull() & ~F.isnan(F.col(diff).cast("double")) & (F.col(diff) != 0)).select(
        *keys, F.concat_ws("|", *[F.col(u).cast("string") for u in unit]).alias("_u"), F.col(diff).cast("double").alias("_d"))
    of_keys = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)

    def pieces(head: pa.Table, n: int, total: float, sums: np.ndarray) -> pa.RecordBatch:
        starts = range(0, n_perm, WIDTH)
        cols = {k: pa.chunked_array([head.column(k).chunk(0)] * len(starts)).combine_chunks() for k in keys}
        return pa.RecordBatch.from_pydict({
            **cols, "_piece": pa.array([s // WIDTH for s in starts], pa.int32()), "_n": pa.array([n] * len(starts), pa.int64()),
            "_sum": pa.array([total] * len(starts)), "_sums": pa.array([sums[s:s + WIDTH].tobytes() for s in starts], pa.binary())})

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            for lo, hi in _runs(t, keys):
                name = tuple(t.column(k)[lo].as_py() for k in keys)
                if at is None or at[0] != name:
                    if at is not None:
                        yield pieces(*at[1:])
                    at = [name, t.select(keys).slice(lo, 1).combine_chunks(), 0, 0.0, np.zeros(n_perm)]
                for s in range(lo, hi, ROWS):
                    part = t.slice(s, min(ROWS, hi - s))
                    v = part.column("_d").to_numpy()
                    at[2] += len(v)
                    at[3] += float(v.sum())
                    at[4] += v.sum() - 2.0 * (v @ _flips(part.column("_u").to_pylist(), n_perm, seed))
        if at is not None:
            yield pieces(*at[1:])

    def added(t: pa.Table) -> pa.Table:
        sums = np.zeros(len(t.column("_sums")[0].as_py()) // 8)
        for x in t.column("_sums"):
            sums += np.frombuffer(x.as_py())
        n, stat = sum(t.column("_n").to_pylist()), abs(sum(t.column("_sum").to_pylist()))
        hits = int((np.abs(sums) >= stat - 1e-9).sum())
        return pa.table({**{k: t.column(k).slice(0, 1) for k in keys}, "n": pa.array([n], pa.int64()), "stat": [stat],
                         "hits": pa.array([hits], pa.int64())})

    sums = d.sortWithinPartitions(*keys).mapInArrow(partial, f"{of_keys}, _piece int, _n bigint, _sum double, _sums binary")
    tested = sums.groupBy(*keys, "_piece").applyInArrow(added, f"{of_keys}, n bigint, stat double, hits bigint")
    return tested.groupBy(*keys).agg(F.max("n").alias("n"), F.max("stat").alias("stat"),
                                     (F.sum("hits") / F.lit(float(n_perm))).alias("p"))


def _runs(t: pa.Table, keys: Sequence[str]) -> list[tuple[int, int]]:
    """Bounds of the runs of equal keys in a sorted table."""
    codes = [t.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for c in codes:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), t.num_rows]))
