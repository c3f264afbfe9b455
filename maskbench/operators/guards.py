"""Data-quality guards: each returns the violating rows, ``require_none`` turns them into a
failure that names some of them."""

from __future__ import annotations

import hashlib
import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import hash32
from ..functions.ordered import ordinal


class GuardError(RuntimeError):
    """A guard found violations."""


def require_none(violations: DataFrame, what: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise GuardError(f"{what}: for example {[r.asDict() for r in rows]}")


def grid_violations(expected: DataFrame, rows: DataFrame, cell: Sequence[str],
                    instances: int | None = None, sequences: int | None = None,
                    obj: str = "obj_id", seq: str = "seq") -> DataFrame:
    """Cells that are missing, incomplete or duplicated against the expected grid of cells."""
    got = rows.groupBy(*cell, seq, obj).agg(F.count("*").alias("_k")).groupBy(*cell).agg(
        F.count("*").alias("n_instances"), F.countDistinct(seq).alias("n_sequences"),
        F.sum("_k").alias("n_rows"))
    j = expected.join(got, list(cell), "left")
    why = F.when(F.col("n_rows").isNull(), "missing cell").when(
        F.col("n_rows") > F.col("n_instances"), "duplicate rows")
    if instances is not None:
        why = why.when(F.col("n_instances") != instances, "wrong instance count")
    if sequences is not None:
        why = why.when(F.col("n_sequences") != sequences, "wrong sequence count")
    zero = [F.coalesce(x, F.lit(0)).alias(x) for x in ("n_rows", "n_instances", "n_sequences")]
    return j.select(*cell, *zero, why.alias("violation")).where(F.col("violation").isNotNull())


def structural_audit(rows: DataFrame, arm: str = "mode") -> DataFrame:
    """Per arm, in one pass: rows, distinct keys, levels, range errors and clean-cell errors."""
    clean = F.col("degradation") == "clean"
    keyed = rows.groupBy(arm, "seq", "obj_id", "degradation", "level").agg(
        F.count("*").alias("k"),
        F.count_if(~F.coalesce(F.col("jf").between(0, 1), F.lit(False))).alias("bad_range"),
        F.count_if(clean & (F.abs(F.col("severity_mean") - 1.0) >= 1e-9)).alias("bad_severity"),
        F.count_if(clean & (F.col("n_predict_failures") > 0)).alias("clean_failures"))
    total = lambda x: F.sum(x).cast("bigint").alias(x)
    return keyed.groupBy(arm).agg(
        F.sum("k").alias("rows"), F.count("*").alias("distinct_keys"),
        F.countDistinct("level").alias("levels"), F.countDistinct("degradation").alias("degradations"),
        total("bad_range"), total("bad_severity"), total("clean_failures"))


def universe_differences(rows: DataFrame, arm: str, arms: Sequence[str],
                         keys: Sequence[str] = ("seq", "obj_id")) -> DataFrame:
    """Keys that some of the arms lack, with the number of arms that have them."""
    g = rows.where(F.col(arm).isin(list(arms))).groupBy(*keys).agg(
        F.countDistinct(arm).alias("n_arms"))
    return g.where(F.col("n_arms") < len(arms))


def noop_arms(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Arms bit-identical to the reference on every instance: their setting never took effect."""
    g = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_change"))
    return g.where(F.col("n_changed") == 0)


def arm_effect(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many instances each arm changes and by how much at most."""
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("n_changed"),
        F.max(F.abs(F.col("a") - F.col("b"))).alias("max_change"))


def reference_drift(recomputed: DataFrame, authority: DataFrame, keys: Sequence[str], value: str,
                    tol: float = 1e-6) -> DataFrame:
    """Keys whose value is absent from, or farther than ``tol`` off, the authoritative table."""
    a = authority.select(*keys, F.col(value).alias("_want"))
    j = recomputed.select(*keys, value).join(a, list(keys), "left")
    d = F.abs(F.col(value) - F.col("_want"))
    return j.select(*keys, F.col(value).alias("got"), F.col("_want").alias("want"),
                    d.alias("diff")).where(F.col("want").isNull() | (F.col("diff") > tol))


def replay_drift(replayed: DataFrame, landed: DataFrame, keys: Sequence[str],
                 values: Sequence[str] = ("severity_mean", "severity_max"), tol: float = 1e-5
                 ) -> DataFrame:
    """Cells whose replayed severity does not match what the sweep recorded.

    A cell that only one side has comes out with a NULL difference.
    """
    a = replayed.select(*keys, *values, F.lit(1).alias("_a"))
    b = landed.select(*keys, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(1).alias("_b"))
    j = a.join(b, list(keys), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    worst = F.greatest(F.lit(0.0), *[F.abs(F.col(v) - F.col(f"_l_{v}")) for v in values])
    return j.select(*keys, F.when(both, worst).alias("max_diff")).where(
        F.col("max_diff").isNull() | (F.col("max_diff") > tol))


def collapse_disagreement(a: DataFrame, b: DataFrame, keys: Sequence[str],
                          value: str = "jf", tol: float = 1e-12) -> DataFrame:
    """Rows where two implementations of one collapse differ, or only one of them has the key."""
    x = a.select(*keys, F.col(value).alias("va"))
    y = b.select(*keys, F.col(value).alias("vb"))
    j = x.join(y, list(keys), "full_outer")
    return j.where(F.col("va").isNull() | F.col("vb").isNull()
                   | (F.abs(F.col("va") - F.col("vb")) > tol))


def series_digest(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], chunk: Column,
                  value: str, start: int = 0) -> DataFrame:
    """Digest of a numeric series printed as ``%.9g``, one definition at every size.

    Each value is hashed with its position (md5 of ``position|text``); the four 32-bit words of the hashes are added
    up modulo 2^32. Tasks print, hash and add up their own rows, and digests of parts whose positions follow each other
    (``start`` is the position of a part's first value) merge into that of the whole: see ``merge_digests``.
    """
    d = ordinal(df, keys, order, chunk, "_i")
    keys = list(keys)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            texts = ["NULL" if v is None else _printed(v) for v in b.column(len(keys) + 1).to_pylist()]
            h = b"".join([hashlib.md5(b"%d|%s" % (i + start, t.encode())).digest()
                          for i, t in zip(b.column(len(keys)).to_pylist(), texts)])
            words = np.frombuffer(h, ">u4").reshape(n, 4).astype(np.int64)
            t = pa.table([*b.columns[:len(keys)], pa.array(np.zeros(n, np.int8)), pa.array(np.ones(n, np.int64)), *[pa.array(np.ascontiguousarray(words[:, j])) for j in range(4)]],
                         names=[*[f"k{i}" for i in range(len(keys))], "all", "n", "w0", "w1", "w2", "w3"])
            sums = t.group_by([*[f"k{i}" for i in range(len(keys))], "all"], use_threads=False).aggregate([(x, "sum") for x in ("n", "w0", "w1", "w2", "w3")])
            out = [*[sums.column(f"k{i}") for i in range(len(keys))], *[sums.column(f"{x}_sum") for x in ("n", "w0", "w1", "w2", "w3")]]
            yield from pa.table(out, names=[*keys, "_n", "_w0", "_w1", "_w2", "_w3"]).to_batches()

    of_keys = "".join(f"`{k}` {d.schema[k].dataType.simpleString()}, " for k in keys)
    sums = d.select(*keys, "_i", F.col(value).cast("double").alias("_v")).mapInArrow(
        added, of_keys + "_n long, _w0 long, _w1 long, _w2 long, _w3 long")
    return _summed_words(sums, keys, [F.col(f"_w{j}").cast("decimal(20,0)") for j in range(4)])


def _printed(v: float) -> str:
    """``%.9g``; zero has no sign, what is no finite number is empty, as in :func:`format_9g`."""
    return "0" if v == 0 else "%.9g" % v if math.isfinite(v) else ""


def merge_digests(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Digest of series whose parts' digests (keys, n, digest) are given, in any order."""
    return _added_words(parts.withColumnRenamed("n", "_n").withColumnRenamed("digest", "_h"), keys)


def _added_words(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _summed_words(df, keys, [F.conv(F.substring("_h", 8 * j + 1, 8), 16, 10).cast("decimal(20,0)") for j in range(4)])


def _summed_words(df: DataFrame, keys: Sequence[str], word: Sequence[Column]) -> DataFrame:
    sums = df.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("n"), *[F.sum(w).alias(f"_w{j}") for j, w in enumerate(word)])
    hexed = [F.lpad(F.lower(F.hex((F.col(f"_w{j}") % F.lit(1 << 32)).cast("bigint"))), 8, "0") for j in range(4)]
    return sums.select(*keys, "n", F.concat(*hexed).alias("digest"))


def format_9g(v: Column) -> Column:
    """Nine significant digits as C's ``%.9g`` prints numbers of everyday size.

    Exponents below -5 or from 9 on switch to scientific notation.
    """
    v = v.cast("double")
    sci = F.format_string("%.8e", v)
    e = F.regexp_extract(sci, r"e([+-]\d+)$", 1).cast("int")
    mant = F.regexp_replace(F.regexp_extract(sci, r"^(-?[\d.]+)e", 1), r"\.?0+$", "")
    mant = F.when(F.regexp_extract(sci, r"^(-?[\d.]+)e", 1).contains("."), mant).otherwise(
        F.regexp_extract(sci, r"^(-?[\d.]+)e", 1))
    fixed = F.when(e == -5, F.lit(None).cast("string"))
    for k in range(-4, 9):
        fixed = fixed.when(e == k, F.format_string(f"%.{8 - k}f", v))
    trimmed = F.when(fixed.contains("."), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.when(v == 0, "0").when(e.between(-4, 8), trimmed).otherwise(
        F.concat(mant, F.regexp_extract(sci, r"(e[+-]\d+)$", 1)))


def table_disagreement(derived: DataFrame, published: DataFrame, keys: Sequence[str],
                       tol: float = 5e-7) -> DataFrame:
    """Published correlation rows that differ in n, or in rho by more than ``tol``."""
    a = derived.select(*keys, F.col("n").alias("n_derived"), F.col("rho").alias("rho_derived"))
    b = published.select(*keys, F.col("n").alias("n_published"), F.col("rho").alias("rho_published"))
    j = a.join(b, list(keys), "full_outer")
    same = (F.col("n_derived") == F.col("n_published")) & (
        F.abs(F.col("rho_derived") - F.col("rho_published")) <= tol)
    return j.where(~F.coalesce(same, F.lit(False)))


def profile_checks(profile: DataFrame, lengths: DataFrame, analytic: dict[str, float],
                   ratio_tol: float = 0.25, costlier: tuple[str, str] | None = None) -> DataFrame:
    """Violations of the profiling protocol: mixed conditions, clip lengths, call rates, order."""
    cond = profile.agg(F.countDistinct("degradation").alias("d"), F.countDistinct("level").alias("l"))
    mixed = cond.where((F.col("d") > 1) | (F.col("l") > 1)).select(
        F.lit("mixed conditions").alias("check"), F.lit("").alias("subject"),
        (F.col("d") * F.col("l")).cast("double").alias("value"))
    want = lengths.select("seq", F.col("n_frames").alias("_want"))
    bad_len = profile.join(want, "seq", "left").where(
        F.col("_want").isNull() | (F.col("n_frames") != F.col("_want"))).select(
        F.lit("clip length").alias("check"), F.col("seq").cast("string").alias("subject"),
        F.col("n_frames").cast("double").alias("value")).distinct()
    rate = profile.groupBy("mode").agg(
        (F.sum("encoder_calls") / F.sum("n_frames")).alias("r"))
    exp = F.lit(None).cast("double")
    for m, v in analytic.items():
        exp = F.when(F.col("mode") == m, F.lit(float(v))).otherwise(exp)
    bad_rate = rate.where(F.abs(F.col("r") / exp - 1) > ratio_tol).select(
        F.lit("call rate").alias("check"), F.col("mode").alias("subject"), F.col("r").alias("value"))
    out = mixed.unionByName(bad_len).unionByName(bad_rate)
    if costlier:
        pick = lambda m: F.max(F.when(F.col("mode") == m, F.col("r")))
        gap = rate.agg((pick(costlier[0]) - pick(costlier[1])).alias("g"))
        out = out.unionByName(gap.where(~(F.col("g") > 0)).select(
            F.lit("cost order").alias("check"), F.lit(costlier[0]).alias("subject"),
            F.col("g").alias("value")))
    return out


def dataset_violations(manifest: DataFrame, frames: DataFrame, labels: DataFrame,
                       label_ids: DataFrame) -> DataFrame:
    """Manifest against what the scans found, one row per problem.

    ``manifest``: (video_id, n_frames, object_ids "1|2"); ``frames`` and ``labels``: (seq,
    frame, h, w, and for frames ``flat`` 0/1); ``label_ids``: (seq, frame, obj_id) in use.
    """
    m = manifest.select(F.col("video_id").alias("seq"), F.col("n_frames").alias("want"))

    def layout(df: DataFrame, what: str) -> DataFrame:
        g = df.groupBy("seq").agg(F.count("*").alias("n"), F.max("frame").alias("hi"),
                                  F.countDistinct("frame").alias("nd"),
                                  F.countDistinct("h", "w").alias("sizes"))
        j = m.join(g, "seq", "full_outer")
        why = (F.when(F.col("want").isNull(), f"stray {what}")
               .when(F.col("n").isNull(), f"no {what}")
               .when((F.col("nd") != F.col("want")) | (F.col("hi") != F.col("want") - 1),
                     f"{what} count or gap")
               .when(F.col("n") != F.col("nd"), f"duplicate {what}")
               .when(F.col("sizes") != 1, f"mixed {what} size"))
        return j.select("seq", why.alias("violation")).where(F.col("violation").isNotNull())

    sizes = frames.select("seq", "frame", "h", "w").join(
        labels.select("seq", "frame", F.col("h").alias("lh"), F.col("w").alias("lw")),
        ["seq", "frame"]).where((F.col("h") != F.col("lh")) | (F.col("w") != F.col("lw")))
    flat = frames.where(F.col("flat") == 1)
    declared = manifest.select(F.col("video_id").alias("seq"), F.explode(F.transform(
        F.split("object_ids", r"\|"), lambda x: x.try_cast("int"))).alias("obj_id"))
    used = label_ids.where(F.col("obj_id") != 0)
    ids = used.select("seq", "obj_id").distinct()
    undeclared = ids.join(declared, ["seq", "obj_id"], "left_anti")
    unused = declared.join(ids, ["seq", "obj_id"], "left_anti")
    late = declared.join(used.where(F.col("frame") == 0).select("seq", "obj_id").distinct(),
                         ["seq", "obj_id"], "left_anti").join(ids, ["seq", "obj_id"])
    tag = lambda d, t: d.select("seq", F.lit(t).alias("violation")).distinct()
    out = layout(frames, "frames").unionByName(layout(labels, "labels"))
    for d, t in ((sizes, "frame and label size differ"), (flat, "flat frame"),
                 (undeclared, "undeclared object"), (unused, "declared object never labelled"),
                 (late, "object missing in the first frame")):
        out = out.unionByName(tag(d, t))
    return out


def round_trip_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], payload: str,
                           share: int = 1, seed: int = 0) -> DataFrame:
    """Rows (a keyed hash sample of one in ``share``) whose payload differs between two decodes."""
    pick = hash32(F.lit(seed), *keys) % share == 0
    x = a.where(pick).select(*keys, F.sha2(payload, 256).alias("ha"))
    y = b.where(pick).select(*keys, F.sha2(payload, 256).alias("hb"))
    return x.join(y, list(keys), "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb")))
