"""Gaps between arms: memory arm minus family arm, by condition and by clip."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import stats
from .bootstrap import bootstrap_ci

WIDEN_TOL = 0.02  # fixed value: a smaller gap change is flat


def arm_means(clips: DataFrame, keys: Sequence[str], arms: Sequence[str]) -> DataFrame:
    """Conditional means, one column per arm, in a single aggregation."""
    return clips.groupBy(*keys).agg(*[F.avg(F.when(F.col("mode") == m, F.col("jf"))).alias(m)
                                      for m in arms])


def group_gap(clips: DataFrame, hi: str, lo: str, keys: Sequence[str] = ("degradation",)
              ) -> DataFrame:
    """Difference of the two arm means; needs both arms."""
    m = arm_means(clips, keys, [hi, lo]).where(F.col(hi).isNotNull() & F.col(lo).isNotNull())
    return m.select(*keys, hi, lo, (F.col(hi) - F.col(lo)).alias("gap"))


def clip_gap(clips: DataFrame, hi: str, lo: str, keys: Sequence[str] = ("degradation",)
             ) -> DataFrame:
    """Signed gap per clip: positive where the ``hi`` arm is better."""
    means = arm_means(clips, [*keys, "seq"], [hi, lo])
    return means.where(F.col(hi).isNotNull() & F.col(lo).isNotNull()).select(
        *keys, "seq", F.col(hi).alias("hi"), F.col(lo).alias("lo"),
        (F.col(hi) - F.col(lo)).alias("gap"))


def pooled_means(clips: DataFrame, sets: Mapping[str, Sequence[str]], arms: Sequence[str]
                 ) -> DataFrame:
    """Arm means over named sets of degradations; a row may belong to several sets."""
    tags = F.filter(F.array(*[F.when(F.col("degradation").isin(list(v)), F.lit(k))
                              for k, v in sets.items()]), lambda t: t.isNotNull())
    return arm_means(clips.withColumn("pool", F.explode(tags)), ["pool"], arms)


def member_table(spark: SparkSession, compounds: Mapping[str, Sequence[str]]) -> DataFrame:
    """Constant table of compound degradations, one row per member."""
    rows = [(k, m, i) for k, v in compounds.items() for i, m in enumerate(v)]
    return spark.createDataFrame(rows, "compound string, member string, position int")


def compound_members(clips: DataFrame, members: DataFrame) -> DataFrame:
    """Compound rows joined to the rows of their members on the same clip, arm and level."""
    keys = ["seq", "mode", "level"]
    comp = clips.select(*keys, F.col("degradation").alias("compound"), F.col("jf").alias("jf_compound"))
    mem = clips.select(*keys, F.col("degradation").alias("member"), F.col("jf").alias("jf_member"))
    return comp.join(members.select("compound", "member"), "compound").join(mem, [*keys, "member"])


def widening_verdict(gaps: DataFrame, members: DataFrame, tol: float = WIDEN_TOL) -> DataFrame:
    """Compound gap against the largest and mean member gap, with a verdict for every compound."""
    g = gaps.select("degradation", "gap")
    ref = members.join(g.withColumnRenamed("degradation", "member"), "member", "left").groupBy(
        F.col("compound").alias("degradation")).agg(
        F.count("*").alias("n_members"), F.count("gap").alias("n_known"),
        F.max("gap").alias("member_gap_max"), F.avg("gap").alias("member_gap_mean"))
    d_max, d_mean = F.col("gap") - F.col("member_gap_max"), F.col("gap") - F.col("member_gap_mean")
    return ref.join(g, "degradation", "left").select(
        "degradation", "n_members", "n_known", "gap", "member_gap_max", "member_gap_mean",
        d_max.alias("delta_vs_max"), d_mean.alias("delta_vs_mean"),
        F.when(F.col("gap").isNull(), "PARTIAL").when(F.col("n_known") == 0, "NO_BASELINE")
        .when(d_max > tol, "WIDENS").when(d_mean < -tol, "NARROWS").otherwise("FLAT")
        .alias("verdict"))


def pooled_pairs(clips: DataFrame, degradations: Sequence[str], base: str, methods: Sequence[str]
                 ) -> DataFrame:
    """Clip means over a set of degradations, then paired: n counts clips, not cells."""
    d = clips.where(F.col("degradation").isin(list(degradations)))
    per_seq = d.groupBy("seq", "mode").agg(F.avg("jf").alias("jf"))
    return stats.paired_values(per_seq, ["seq"], "mode", "jf", base, list(methods))


def gap_shift_pairs(clips: DataFrame, members: DataFrame, hi: str, lo: str) -> DataFrame:
    """Per clip and (compound, member): member gap ``a``, compound gap ``b`` and the shift."""
    g = clip_gap(clips, hi, lo)
    comp = g.select(F.col("degradation").alias("compound"), "seq", F.col("gap").alias("b"))
    mem = g.select(F.col("degradation").alias("member"), "seq", F.col("gap").alias("a"))
    j = comp.join(members.select("compound", "member"), "compound").join(mem, ["member", "seq"])
    return stats.with_difference(j)


def gap_shift(clips: DataFrame, members: DataFrame, hi: str, lo: str) -> DataFrame:
    """Mean shift of paired clips beside the shift of the independent group gaps.

    The two agree if every condition has the same clips in both arms; ``consistent`` is 0 where they do not.
    """
    p = gap_shift_pairs(clips, members, hi, lo)
    paired = p.groupBy("compound", "member").agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_shift"),
        F.count_if(F.col("d") > 0).alias("n_widen"), F.count_if(F.col("d") < 0).alias("n_narrow"))
    gap = group_gap(clips, hi, lo)
    for side in ("compound", "member"):
        paired = paired.join(gap.select(F.col("degradation").alias(side), F.col("gap").alias(f"_{side}")), side)
    shift = F.col("_compound") - F.col("_member")
    return paired.select("compound", "member", "n", "mean_shift", shift.alias("group_shift"), "n_widen", "n_narrow",
                         (F.abs(F.col("mean_shift") - shift) < 1e-9).cast("int").alias("consistent"))



def severity_gaps(clips: DataFrame, memory: str, subtrahends: Sequence[str]) -> DataFrame:
    """Gap by degradation and level for every subtrahend arm, in one pass."""
    keys = ["degradation", "level"]
    m = arm_means(clips, keys, [memory, *subtrahends])
    return m.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("subtrahend"), (F.col(memory) - F.col(s)).alias("gap"))
        for s in subtrahends]))).where(F.col("gap").isNotNull())


def gap_blocks_identical(gaps: DataFrame) -> DataFrame:
    """Violation rows if two subtrahends give one and the same block of gaps."""
    a = gaps.select("degradation", "level", F.col("subtrahend").alias("s1"), F.col("gap").alias("g1"))
    b = gaps.select("degradation", "level", F.col("subtrahend").alias("s2"), F.col("gap").alias("g2"))
    j = a.join(b, ["degradation", "level"]).where(F.col("s1") < F.col("s2"))
    return j.groupBy("s1", "s2").agg(F.max(F.abs(F.col("g1") - F.col("g2"))).alias("max_diff")
                                     ).where(F.col("max_diff") == 0)


def endpoint_pairs(clips: DataFrame, memory: str, subtrahends: Sequence[str]) -> DataFrame:
    """Per clip: the gap at the highest level minus the gap at the lowest level."""
    keys = ["degradation", "level", "seq"]
    m = arm_means(clips, keys, [memory, *subtrahends])
    long = m.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(s).alias("subtrahend"), (F.col(memory) - F.col(s)).alias("gap"))
        for s in subtrahends]))).where(F.col("gap").isNotNull())
    e = long.groupBy("degradation", "subtrahend", "seq").agg(
        F.min_by("gap", "level").alias("a"), F.max_by("gap", "level").alias("b"),
        F.countDistinct("level").alias("n_levels"))
    return stats.with_difference(e.where(F.col("n_levels") > 1))


def extra_over_clean(clips: DataFrame, hi: str, lo: str, n_boot: int = 10000, seed: int = 0
                     ) -> DataFrame:
    """Gap on each degradation minus the same clip's clean gap, with interval and zero check."""
    keys = ["degradation", "level"]
    g = clip_gap(clips, hi, lo, keys)
    clean = g.where(F.col("degradation") == "clean").groupBy("seq").agg(F.avg("gap").alias("_c"))
    e = g.where(F.col("degradation") != "clean").join(clean, "seq").withColumn(
        "extra", F.col("gap") - F.col("_c"))
    ci = bootstrap_ci(e, keys, ["seq"], "extra", n_boot=n_boot, seed=seed)
    means = e.groupBy(*keys).agg(F.avg("gap").alias("gap"), F.avg("_c").alias("gap_clean"))
    return means.join(ci, keys).select(
        *keys, "n", "gap", "gap_clean", F.col("point").alias("extra"), "ci_lo", "ci_hi",
        ((F.col("ci_lo") <= 0) & (F.col("ci_hi") >= 0)).cast("int").alias("contains_zero"))
