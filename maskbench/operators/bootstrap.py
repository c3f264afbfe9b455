"""Percentile bootstraps whose multiplicities are a hash of (seed, replicate, unit).

In each replicate a unit counts as often as a Poisson draw of mean 1 says, the limit of drawing as many
units as there are with replacement. A unit's draw needs no other unit, so there is one path for keys of
any size: every task adds up its own rows, and one row per key and replicate is shuffled.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.keys import c
from ..functions.ordered import rank_table
from ..kernels.draws import PER_HASH, STEPS, Draws
from ..session import materialise

MIN_CLUSTERS = 8


def finite(*values: str) -> Column:
    """True where no value is NULL or NaN."""
    out = F.lit(True)
    for v in values:
        out = out & F.col(v).isNotNull() & ~F.isnan(F.col(v).cast("double"))
    return out


def _hashed(df: DataFrame, unit: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Each row once for every PER_HASH replicates, with the md5 ``_h`` that their weights come from."""
    key = F.concat_ws("|", F.lit(seed).cast("string"), F.col("_k").cast("string"),
                      *[c(u).cast("string") for u in unit])
    blocks = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // PER_HASH)))
    return df.withColumn("_k", blocks).withColumn("_h", F.md5(key.cast("binary")))


def _weight(j: Column) -> Column:
    digits = F.substring(F.col("_h"), j * 4 + 1, F.lit(4))
    return sum([(digits >= F.lit(t)).cast("int") for t in STEPS], F.lit(0))


def multiplicities(df: DataFrame, unit: Sequence[str], n_boot: int, seed: int = 0) -> DataFrame:
    """Each row once per replicate ``b`` in which its unit counts, with its weight ``w``."""
    d = _hashed(df, unit, n_boot, seed)
    d = d.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(PER_HASH - 1))))
    d = d.withColumn("b", F.col("_k") * PER_HASH + F.col("_j")).withColumn("w", _weight(F.col("_j")))
    return d.where((F.col("w") > 0) & (F.col("b") < n_boot)).drop("_k", "_h", "_j")


#: Keys whose partial sums a task holds, 16 bytes for each key and replicate, and those it sends on in one batch.
HELD_KEYS, SENT_KEYS = 1024, 64


def _replicate_means(df: DataFrame, keys: Sequence[str], unit: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """(keys, b, _m): the means of ``_v``. A task adds up its rows for all replicates, so a row is not repeated per replicate."""
    keys, n_blocks = list(keys), (n_boot - 1) // PER_HASH + 1
    text = F.concat_ws("|", *[c(u).cast("string") for u in unit])
    d = df.select(*keys, text.alias("_u"), "_v")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            names = list(held)
            for lo in range(0, len(names), SENT_KEYS):
                part = names[lo:lo + SENT_KEYS]
                got = [held.pop(k) for k in part]
                cols = {m: pa.array([k[i] for k in part], types[i]) for i, m in enumerate(keys)}
                ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * n_blocks * PER_HASH)
                n, s = (pa.ListArray.from_arrays(ends, np.concatenate([v[i] for v in got])) for i in (0, 1))
                yield pa.RecordBatch.from_pydict({**cols, "_n": n, "_s": s})

        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(m).type for m in keys]
            rows = list(zip(*[batch.column(m).to_pylist() for m in keys])) if keys else [()] * batch.num_rows
            own = {k: i for i, k in enumerate(dict.fromkeys(rows))}
            at = np.array([own[k] for k in rows])
            v, draws = batch.column("_v").to_numpy(zero_copy_only=False), Draws(batch.column("_u"), seed)
            found = np.empty((len(own), 2, n_blocks * PER_HASH))
            for k in range(n_blocks):
                for j, w in enumerate(draws.block(k), k * PER_HASH):
                    found[:, 0, j] = np.bincount(at, weights=w, minlength=len(own))
                    found[:, 1, j] = np.bincount(at, weights=w * v, minlength=len(own))
            for k, i in own.items():
                held[k] = held[k] + found[i] if k in held else found[i].copy()
            if len(held) > HELD_KEYS:
                yield from sent()
        yield from sent()

    of_keys = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)
    each = d.mapInArrow(sums, f"{of_keys}_n array<double>, _s array<double>")
    each = each.select(*keys, F.posexplode(F.arrays_zip("_n", "_s")).alias("b", "_t")).where(F.col("b") < n_boot)
    n = F.sum("_t._n")
    return each.groupBy(*keys, "b").agg(F.when(n > 0, F.sum("_t._s") / n).alias("_m")).where(F.col("_m").isNotNull())


def percentile_bounds(df: DataFrame, keys: Sequence[str], value: str, alpha: float,
                      lo: str = "ci_lo", hi: str = "ci_hi") -> DataFrame:
    """Percentiles over the replicates of a key: at most ``n_boot`` values each."""
    p = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return df.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, F.col("_p")[0].alias(lo), F.col("_p")[1].alias(hi))


def bootstrap_ci(df: DataFrame, keys: Sequence[str], unit: Sequence[str], value: str,
                 n_boot: int = 10000, alpha: float = 0.05, seed: int = 0,
                 statistic: str = "mean") -> DataFrame:
    """Mean (or median) of ``value`` per key with its percentile interval; one row per unit expected.

    NULL and NaN values are left out and not counted in ``n``; a single unit gives the interval
    (v, v); keys without values give no row.
    """
    d = df.where(finite(value)).select(*keys, *unit, F.col(value).cast("double").alias("_v"))
    if statistic == "mean":
        point, boots = F.avg("_v"), _replicate_means(d, keys, unit, n_boot, seed)
    elif statistic == "median":
        point = F.percentile("_v", 0.5)
        boots = multiplicities(d, unit, n_boot, seed).groupBy(*keys, "b").agg(
            F.percentile("_v", 0.5, F.col("w")).alias("_m"))
    else:
        raise ValueError(f"no statistic {statistic}")
    points = d.groupBy(*keys).agg(point.alias("point"), F.count("*").alias("n"))
    return points.join(percentile_bounds(boots, keys, "_m", alpha), list(keys))


#: Cells (distinct pairs of values) of a key up to which one task sorts them; larger keys are ranked in chunks.
WHOLE_KEY = 1 << 18


def _centred_ranks_of_whole_keys(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_rx`` and ``_ry``: ranks less their mean, by one shuffle of the cells by key and one sort a side."""
    whole = F.sum("_w").over(W.partitionBy(*keys))

    def centred(v: str) -> Column:
        upto = F.sum("_w").over(W.partitionBy(*keys).orderBy(v).rangeBetween(W.unboundedPreceding, W.currentRow))
        tied = F.sum("_w").over(W.partitionBy(*keys, v))
        return upto - tied + (tied - whole) / F.lit(2.0)
    return cells.withColumn("_rx", centred("_x")).withColumn("_ry", centred("_y"))


def _centred_ranks_in_chunks(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for keys of any size: no task holds a key."""
    out = cells
    for v, r in (("_x", "_rx"), ("_y", "_ry")):
        t = rank_table(cells, keys, v, {"_n": F.col("_w")})
        out = out.join(t.select(*keys, v, (F.col("_n_before") + (F.col("_n") - F.col("_n_total")) / F.lit(2.0)).alias(r)), [*keys, v])
    return out


def weighted_rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str,
                              weight: str = "w") -> DataFrame:
    """Spearman's rho per key over rows repeated ``weight`` times: average-tie ranks, then
    the product moment. NULL below four observations or without spread."""
    keys = list(keys)
    named = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    cells = df.where(finite(x, y) & named)
    cells = cells.groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.sum(weight).alias("_w"))
    large = cells.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > WHOLE_KEY).select(*keys)
    if not keys:
        j = _centred_ranks_in_chunks(cells, keys)
    elif large.limit(1).count() == 0:
        j = _centred_ranks_of_whole_keys(cells, keys)
    else:
        j = _centred_ranks_of_whole_keys(cells.join(large, keys, "left_anti"), keys).unionByName(
            _centred_ranks_in_chunks(cells.join(large, keys, "left_semi"), keys))
    a = j.groupBy(*keys).agg(
        F.sum("_w").cast("bigint").alias("n"),
        F.sum(F.col("_w") * F.col("_rx") * F.col("_ry")).alias("_xy"),
        F.sum(F.col("_w") * F.col("_rx") * F.col("_rx")).alias("_xx"),
        F.sum(F.col("_w") * F.col("_ry") * F.col("_ry")).alias("_yy"),
    )
    ok = (F.col("n") >= 4) & (F.col("_xx") > 0) & (F.col("_yy") > 0)
    rho = F.when(ok, F.col("_xy") / F.sqrt(F.col("_xx")) / F.sqrt(F.col("_yy")))
    return a.select(*keys, "n", rho.alias("rho"))


def rank_correlation(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman's rho per key."""
    return weighted_rank_correlation(df.withColumn("_one", F.lit(1).cast("bigint")), keys, x, y,
                                     "_one")


#: Rows of a slab of an order (a value tied more often gets slabs of its own), and tasks to have at the least.
CHUNK_ROWS = 1 << 21
MIN_TASKS = 32
#: Distinct values (by estimate) up to which an order is told value by value, and then the rows of a slab of the other order.
FEW_VALUES, FEW_ROWS = 512, 1 << 18
SENT_BLOCKS = 25  # blocks of replicates whose sums by value are one row


def _placed(d: DataFrame, keys: Sequence[str], value: str, side: str) -> DataFrame:
    """Add the slab of a row's value in its key's order: column ``_at<side>``, a number made of chunk, hot and part.

    Tied values share a slab; a value tied more than CHUNK_ROWS times has slabs of its own, its rows dealt over parts.
    """
    size = F.lit(CHUNK_ROWS)
    t = rank_table(d, keys, value)
    parts = F.ceil(F.col("n") / size)
    t = t.select(*keys, value, F.floor(F.col("n_before") / size).alias("_c"), F.when(F.col("n") > size, parts).otherwise(0).alias("_parts"))
    part = F.when(F.col("_parts") > 0, F.pmod(F.xxhash64("_u", "_x", "_y"), F.greatest("_parts", F.lit(1)))).otherwise(0)
    at = F.shiftleft(F.col("_c").cast("bigint") * 2 + (F.col("_parts") > 0).cast("bigint"), 32) + part.cast("bigint")
    return d.join(t, [*keys, value]).withColumn(f"_at{side}", at).drop("_c", "_parts")


class _Slab:
    """Members of a slab in the order of their values, to be ranked in one replicate after another."""

    def __init__(self, values: pa.ChunkedArray, units: np.ndarray, hot: bool) -> None:
        v = values.to_numpy()
        self.rows = np.flatnonzero(~np.isnan(v))
        self.rows = self.rows[np.argsort(v[self.rows], kind="stable")]
        v = v[self.rows]
        self.units, self.hot = units[self.rows], hot
        start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        self.last = np.append(start[1:], len(v)) - 1
        self.times = None if len(start) == len(v) else np.diff(np.append(start, len(v)))

    def ranked(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Weights of the members, twice their ranks centred within the slab, and the slab's weight.

        Twice what lies below, plus what is tied, less the whole: 0 where all are tied.
        """
        w = w[self.units]
        upto = np.cumsum(w, dtype=np.int64)
        whole = int(upto[-1])
        if self.hot:
            return w, np.zeros(len(w)), whole
        if self.times is None:
            return w, (2 * upto - w - whole).astype(float), whole
        upto = upto[self.last]
        ranks = (2 * upto - np.diff(upto, prepend=0) - whole).astype(float)
        return w, np.repeat(ranks, self.times), whole


def _coded(t: pa.Table, seed: int) -> tuple[Draws, np.ndarray]:
    """The draws of a table's distinct units, and the place of each row's unit among them."""
    coded = t.column("_u").combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return Draws(coded.dictionary, seed), coded.indices.to_numpy()


def _cuts(n_blocks: int, groups: Column) -> Column:
    """Groups of blocks of replicates, from ``lo`` up to before ``hi``."""
    return F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.struct(
        F.floor(g * n_blocks / groups).cast("int").alias("lo"), F.floor((g + 1) * n_blocks / groups).cast("int").alias("hi")))


def _correlations_by_value(d: DataFrame, keys: Sequence[str], n_boot: int, seed: int, n_keys: int, largest: int) -> DataFrame:
    """``replicate_correlations`` of keys where ``_y`` has few distinct values, at a cost in proportion to the rows.

    Only the x order is cut into slabs, at approximate quantiles; a task ranks its slab and adds weights and ranks up by value of y.
    Ranks of y, and what lies in other slabs, are added at the end from those sums. A row is in one slab, whatever the key's size.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_blocks = (n_boot - 1) // PER_HASH + 1
    of_keys = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    n_slabs = -(-largest // FEW_ROWS)
    if n_slabs > 1:
        at = F.percentile_approx("_x", F.array(*[F.lit(i / n_slabs) for i in range(1, n_slabs)]), F.lit(20 * n_slabs))
        # every so many of the cuts for the largest key: a slab of a small key holds as many rows
        step = F.greatest(F.lit(1), F.floor(F.lit(n_slabs) * FEW_ROWS / F.col("_rows")))
        ends = d.groupBy(*keys).agg(at.alias("_all"), F.count("*").alias("_rows")).select(
            *keys, F.filter("_all", lambda v, i: (i + 1) % step == 0).alias("_ends"), F.ceil(n_slabs / step).alias("_slabs"))
        d = d.join(ends, list(keys))
        below = F.size(F.filter("_ends", lambda v: v < F.col("_x")))
        tied = F.size(F.filter("_ends", lambda v: v == F.col("_x")))
        # a value at two cuts fills whole slabs: its rows are dealt over as many parts
        part = F.when(tied > 1, F.pmod(F.xxhash64("_u", "_x", "_y"), tied.cast("bigint"))).otherwise(0)
        d = d.withColumn("_p", F.shiftleft(below.cast("bigint") * 2 + (tied > 1).cast("bigint"), 32) + part)
    else:
        d = d.withColumns({"_p": F.lit(0).cast("bigint"), "_slabs": F.lit(1)})
    groups = F.least(F.lit(n_blocks), F.ceil(F.lit(MIN_TASKS) / (F.col("_slabs") * n_keys)))
    sent = d.select(*keys, "_u", "_x", "_y", "_p", F.inline(_cuts(n_blocks, groups)).alias("_lo", "_hi"))

    def slab(t: pa.Table) -> pa.Table:
        lo, hi, at = (t.column(m)[0].as_py() for m in ("_lo", "_hi", "_p"))
        hot = bool(at >> 32 & 1)
        t = t.take(np.argsort(t.column("_x").to_numpy(), kind="stable"))
        draws, unit = _coded(t, seed)
        own = len(unit) != draws.n
        x, (values, code) = t.column("_x").to_numpy(), np.unique(t.column("_y").to_numpy(), return_inverse=True)
        start = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
        times = np.diff(np.append(start, len(x)))
        last, size = start + times - 1, (len(start), len(values))
        tied = size[0] * size[1] <= len(x) // 2
        cell = np.repeat(np.arange(len(start)), times) * len(values) + code if tied else None
        out = []
        for first in range(lo, hi, SENT_BLOCKS):
            blocks = range(first, min(first + SENT_BLOCKS, hi))
            by_value, squares = np.zeros((2, len(blocks) * PER_HASH, len(values))), np.zeros(len(blocks) * PER_HASH)
            for i, k in enumerate(blocks):
                for j, w in enumerate(draws.block(k), i * PER_HASH):
                    w = w[unit] if own else w
                    if tied:
                        table = np.bincount(cell, weights=w, minlength=size[0] * size[1]).reshape(size)
                        of_x = table.sum(1)
                        by_value[0, j] = table.sum(0)
                        if not hot:
                            upto = np.cumsum(of_x)
                            ranks = 2 * upto - of_x - upto[-1]
                            by_value[1, j] = np.einsum("i,ij->j", ranks, table)
                            squares[j] = np.einsum("i,i,i->", of_x, ranks, ranks)
                        continue
                    by_value[0, j] = np.bincount(code, weights=w, minlength=size[1])
                    if hot:
                        continue
                    upto = np.cumsum(w, dtype=np.int64)
                    if size[0] == len(x):
                        ranks = (2 * upto - w - upto[-1]).astype(float)
                    else:
                        of_x = upto[last]
                        ranks = np.repeat((2 * of_x - np.diff(of_x, prepend=0) - upto[-1]).astype(float), times)
                    weighted = w * ranks
                    by_value[1, j] = np.bincount(code, weights=weighted, minlength=size[1])
                    squares[j] = np.einsum("i,i->", weighted, ranks)
            out.append({**{m: t.column(m)[0].as_py() for m in keys}, "_lo": first, "_p": at, "_values": values.tobytes(),
                        "_sums": by_value.tobytes(), "_squares": squares.tobytes()})
        return pa.Table.from_pylist(out, pa.schema([*[t.schema.field(m) for m in keys], ("_lo", pa.int32()), ("_p", pa.int64()),
                                                    ("_values", pa.binary()), ("_sums", pa.binary()), ("_squares", pa.binary())]))

    def added(t: pa.Table) -> pa.Table:
        rows = t.select(["_lo", "_p", "_values", "_sums", "_squares"]).to_pylist()
        own = [np.frombuffer(r["_values"]) for r in rows]
        values = np.unique(np.concatenate(own))
        squares = np.array([np.frombuffer(r["_squares"]) for r in rows])
        weight = np.zeros((len(rows), squares.shape[1]))
        of_y, moved = np.zeros((2, squares.shape[1], len(values)))
        sums = [np.frombuffer(r["_sums"]).reshape(2, squares.shape[1], -1) for r in rows]
        for i, s in enumerate(sums):
            weight[i] = s[0].sum(1)
        shift, whole = _shifts([r["_p"] for r in rows], weight)
        for i, s in enumerate(sums):
            at = np.searchsorted(values, own[i])
            of_y[:, at] += s[0]
            moved[:, at] += s[1] + shift[i][:, None] * s[0]
        upto = np.cumsum(of_y, axis=1)
        ranks = 2 * upto - of_y - whole[:, None]
        xy, yy = (ranks * moved).sum(1), (of_y * ranks * ranks).sum(1)
        return _rhos(t, keys, n_boot, whole, xy, (squares + shift * shift * weight).sum(0), yy)

    by = [*keys, "_lo", "_p"]
    sums = sent.repartition(n, *by).groupBy(*by).applyInArrow(slab, f"{of_keys}, _lo int, _p bigint, _values binary, _sums binary, _squares binary")
    # tasks of a key cut its blocks alike, so rows of one _lo hold the same replicates
    return sums.groupBy(*keys, "_lo").applyInArrow(added, f"{of_keys}, b int, n bigint, rho double")


def _shifts(at: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What all ranks of a slab are shifted by, from the weights of all slabs, and the whole weight. Parts of a hot value are one."""
    order, index = np.unique(np.array(at) >> 32, return_inverse=True)
    sums = np.zeros((len(order), weight.shape[1]))
    np.add.at(sums, index, weight)
    whole = sums.sum(0)
    return (2 * np.cumsum(sums, axis=0) - sums - whole)[index], whole


def _rhos(t: pa.Table, keys: Sequence[str], n_boot: int, whole: np.ndarray, xy: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> pa.Table:
    """Rows of the replicates from ``_lo`` on, from the sums of weights, products and squares."""
    ok = (whole >= 4) & (xx > 0) & (yy > 0)
    rho = np.divide(xy, np.sqrt(xx) * np.sqrt(yy), out=np.zeros(len(xy)), where=ok)
    b = t.column("_lo")[0].as_py() * PER_HASH + np.arange(len(xy))
    kept = b < n_boot
    same = {m: pa.array([t.column(m)[0].as_py()] * int(kept.sum()), t.schema.field(m).type) for m in keys}
    return pa.table({**same, "b": pa.array(b[kept], pa.int32()), "n": pa.array(whole[kept].astype(np.int64)), "rho": pa.array(rho[kept], mask=~ok[kept])})


def replicate_correlations(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str,
                           n_boot: int, seed: int = 0) -> DataFrame:
    """(keys, b, n, rho): Spearman's rho of every replicate, without a sort per replicate and without shuffling
    anything per replicate.

    Keys with few distinct values in one of their orders take ``_correlations_by_value``, the others ``_correlations_by_slabs``.
    """
    keys = list(keys)
    d = df.select(*keys, F.concat_ws("|", *[c(u).cast("string") for u in unit]).alias("_u"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    d = d.where(finite("_x", "_y"))
    size = d.groupBy(*keys).agg(F.count("*").alias("_rows"), F.approx_count_distinct("_x").alias("_nx"), F.approx_count_distinct("_y").alias("_ny"))
    few = F.least("_nx", "_ny") <= FEW_VALUES
    seen = size.agg(F.count_if(few).alias("few"), F.count_if(~few).alias("many"), F.max(F.when(few, F.col("_rows"))).alias("largest")).first()
    if not seen.few:
        return _correlations_by_slabs(d, keys, n_boot, seed)
    of = size.select(*keys, few.alias("_few"), (F.col("_nx") < F.col("_ny")).alias("_swap"))
    d = d.join(of, keys)
    turned = d.where("_few").select(*keys, "_u", *[F.when(F.col("_swap"), F.col(a)).otherwise(F.col(b)).alias(b) for a, b in (("_y", "_x"), ("_x", "_y"))])
    out = _correlations_by_value(turned, keys, n_boot, seed, seen.few, seen.largest)
    if seen.many:
        out = out.unionByName(_correlations_by_slabs(d.where(~F.col("_few")).select(*keys, "_u", "_x", "_y"), keys, n_boot, seed))
    return out


def _correlations_by_slabs(d: DataFrame, keys: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """``replicate_correlations`` of keys with many distinct values in both orders.

    The x order and the y order of a key are cut into slabs of CHUNK_ROWS rows. A task gets one slab of either order, as
    units and values, and works out replicate after replicate: the ranks within both slabs, and the products of the rows that lie in both.
    What lies in other slabs shifts all ranks of a slab alike, so it is added at the end from the slabs' weights. A row is sent
    once per slab of the other order, and per group of replicates where a key has few slabs: a few hundred bytes in all. Memory is a slab's.
    """
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = _placed(_placed(d, keys, "_x", "x"), keys, "_y", "y")
    n_blocks = (n_boot - 1) // PER_HASH + 1
    of_keys = ", ".join(f"`{k}` {d.schema[k].dataType.simpleString()}" for k in keys)
    n_keys = d.select(*keys).distinct().count()
    slabs = d.groupBy(*keys).agg(F.sort_array(F.collect_set("_atx")).alias("_p"), F.sort_array(F.collect_set("_aty")).alias("_q"))
    # groups of blocks of replicates: the fewer slabs, the more
    groups = F.least(F.lit(n_blocks), F.ceil(F.lit(MIN_TASKS) / (F.size("_p") * F.size("_q") * max(n_keys, 1))))
    slabs = slabs.select(*keys, "_p", "_q", _cuts(n_blocks, groups).alias("_cuts"))
    none = F.lit(None).cast("double")
    tiles = F.concat(
        F.transform("_q", lambda q: F.struct(F.col("_atx").alias("p"), q.alias("q"), F.col("_x").alias("x"), F.when(q == F.col("_aty"), F.col("_y")).alias("y"))),
        F.transform(F.filter("_p", lambda p: p != F.col("_atx")), lambda p: F.struct(p.alias("p"), F.col("_aty").alias("q"), none.alias("x"), F.col("_y").alias("y"))))
    heads = F.struct(F.element_at("_p", 1).alias("p"), F.element_at("_q", 1).alias("q"))
    sent = d.join(slabs, keys).select(*keys, "_u", "_cuts", heads.alias("_head"), F.explode(tiles).alias("_t"))
    sent = sent.select(*keys, "_u", F.inline("_cuts").alias("_lo", "_hi"), F.col("_t.p").alias("_p"), F.col("_t.q").alias("_q"),
                       (F.col("_t.q") == F.col("_head.q")).alias("_of_x"), (F.col("_t.p") == F.col("_head.p")).alias("_of_y"),
                       F.col("_t.x").alias("_x"), F.col("_t.y").alias("_y"))

    def dot(a: np.ndarray, b: np.ndarray) -> float:
        return np.einsum("i,i->", a, b)  # a matrix product would start threads in every task

    def tile(t: pa.Table) -> pa.Table:
        draws, at = _coded(t, seed)
        head = {m: t.column(m)[0].as_py() for m in ("_lo", "_hi", "_p", "_q", "_of_x", "_of_y")}
        sx, sy = _Slab(t.column("_x"), at, head["_p"] >> 32 & 1), _Slab(t.column("_y"), at, head["_q"] >> 32 & 1)
        place = np.full(len(at), -1)
        place[sy.rows] = np.arange(len(sy.rows))
        of_y = place[sx.rows]
        of_x = np.flatnonzero(of_y >= 0)
        of_y = of_y[of_x]
        blocks = range(head["_lo"], head["_hi"])
        found = np.zeros((8, len(blocks) * PER_HASH))
        for i, k in enumerate(blocks):
            for j, w in enumerate(draws.block(k), i * PER_HASH):
                wx, rx, n_x = sx.ranked(w)
                wy, ry, n_y = sy.ranked(w)
                wt, tx, ty = wx[of_x], rx[of_x], ry[of_y]
                wtx = wt * tx
                found[:4, j] = wt.sum(dtype=np.int64), wtx.sum(), wt @ ty, wtx @ ty
                if head["_of_x"]:
                    found[4:6, j] = n_x, dot(wx * rx, rx)
                if head["_of_y"]:
                    found[6:, j] = n_y, dot(wy * ry, ry)
        return pa.table({**{m: t.column(m).slice(0, 1) for m in (*keys, "_lo", "_p", "_q", "_of_x", "_of_y")}, "_sums": [found.tobytes()]})

    def added(t: pa.Table) -> pa.Table:
        rows = t.select(["_p", "_q", "_of_x", "_of_y"]).to_pylist()
        sums = np.array([np.frombuffer(v) for v in t.column("_sums").to_pylist()]).reshape(len(rows), 8, -1)
        squares, move = [], []
        for side, of, first in (("_p", "_of_x", 4), ("_q", "_of_y", 6)):
            own = [i for i, r in enumerate(rows) if r[of]]
            shift, whole = _shifts([rows[i][side] for i in own], sums[own, first])
            squares.append((sums[own, first + 1] + shift * shift * sums[own, first]).sum(0))
            at = {rows[i][side]: s for i, s in zip(own, shift)}
            move.append(np.array([at[r[side]] for r in rows]))
        (xx, yy), (cx, cy) = squares, move
        xy = (sums[:, 3] + cx * sums[:, 2] + cy * sums[:, 1] + cx * cy * sums[:, 0]).sum(0)
        return _rhos(t, keys, n_boot, whole, xy, xx, yy)

    by = [*keys, "_lo", "_p", "_q"]
    sums = sent.repartition(n, *by).groupBy(*by).applyInArrow(
        tile, f"{of_keys}, _lo int, _p bigint, _q bigint, _of_x boolean, _of_y boolean, _sums binary")
    return sums.groupBy(*keys, "_lo").applyInArrow(added, f"{of_keys}, b int, n bigint, rho double")


def _clustered_rho(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str,
                   n_boot: int, alpha: float, seed: int, stratum: str | None, min_rows: int,
                   min_units: int) -> DataFrame:
    keys, strat = list(keys), [stratum] if stratum else []
    d = df.where(finite(x, y)).select(*keys, *strat, F.concat_ws("|", *[c(u).cast("string") for u in unit]).alias("_u"),
                                      F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    units = d.groupBy(*keys).agg(F.count_distinct("_u").alias("_n"))
    d = d.join(units.where(F.col("_n") >= min_units).drop("_n"), keys)
    if stratum:
        sizes = d.groupBy(*keys, stratum).agg(F.count("*").alias("_n"))
        d = d.join(sizes.where(F.col("_n") >= min_rows).drop("_n"), [*keys, stratum])
    rho = replicate_correlations(materialise(d), [*keys, *strat], ["_u"], "_x", "_y", n_boot, seed)
    if stratum:
        rho = rho.where(F.col("n") >= min_rows).groupBy(*keys, "b").agg(F.avg("rho").alias("rho"))
    return percentile_bounds(rho, keys, "rho", alpha).where(F.col("ci_lo").isNotNull())


def unit_bootstrap_rho(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str,
                       n_boot: int, alpha: float = 0.05, seed: int = 0,
                       min_units: int = MIN_CLUSTERS) -> DataFrame:
    """Interval of the pooled rho when whole units (rows, instances, clips) are resampled.

    Keys with fewer than ``min_units`` units are refused: they give no row.
    """
    return _clustered_rho(df, keys, unit, x, y, n_boot, alpha, seed, None, 0, min_units)


def stratified_bootstrap_rho(df: DataFrame, keys: Sequence[str], stratum: str,
                             unit: Sequence[str], x: str, y: str, n_boot: int,
                             min_rows: int = 8, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Interval of the mean of per-stratum rhos, drawing the same units in every stratum."""
    return _clustered_rho(df, keys, unit, x, y, n_boot, alpha, seed, stratum, min_rows, 0)
