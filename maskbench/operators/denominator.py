"""Frame denominators: presence, the arm-independent correction and convention transfer."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F


def presence_counts(labels: DataFrame, clips: DataFrame, objects: DataFrame) -> DataFrame:
    """Frames that show each object, and the clip length; listed objects never seen count 0.

    ``labels`` holds (seq, frame, obj_id) rows, ``clips`` (seq, n_clip), ``objects`` the ids.
    """
    seen = labels.where(F.col("obj_id") != 0).select("seq", "frame", "obj_id").distinct().groupBy(
        "seq", "obj_id").agg(F.count("*").alias("n_present"))
    every = objects.select("seq", "obj_id").unionByName(seen.select("seq", "obj_id")).distinct()
    return every.join(seen, ["seq", "obj_id"], "left").join(clips, "seq", "left").select(
        "seq", "obj_id", "n_clip", F.coalesce("n_present", F.lit(0)).alias("n_present"))


def with_presence(rows: DataFrame, presence: DataFrame, keys: Sequence[str] = ("seq", "obj_id")
                  ) -> DataFrame:
    """Left join of the counts; rows without ground truth stay, with NULL counts."""
    return rows.join(presence.select(*keys, "n_clip", "n_present"), list(keys), "left")


def correction_violations(rows: DataFrame, presence: DataFrame,
                          keys: Sequence[str] = ("seq", "obj_id")) -> DataFrame:
    """Rows that cannot be corrected: no count, nothing present, or fewer frames than present."""
    j = with_presence(rows, presence, keys)
    why = (F.when(F.col("n_present").isNull(), "no presence count")
           .when(F.col("n_present") <= 0, "object never present")
           .when(F.col("n_frames") < F.col("n_present"), "fewer frames than present"))
    return j.withColumn("violation", why).where(F.col("violation").isNotNull())


def correct_denominator(rows: DataFrame, presence: DataFrame, values: Sequence[str],
                        keys: Sequence[str] = ("seq", "obj_id"), check: bool = True) -> DataFrame:
    """Scores over the frames where the object is present: value * n_frames / n_present.

    Raw values are kept. Exact if absent frames scored 0 and no present frame was skipped.
    With ``check`` an uncorrectable row fails the job, so no row is dropped in silence.
    """
    if check:
        bad = correction_violations(rows, presence, keys).limit(5).collect()
        if bad:
            raise ValueError(f"rows cannot be corrected, for example {bad}")
    j = with_presence(rows, presence, keys)
    scale = F.col("n_frames") / F.nullif(F.col("n_present"), F.lit(0))
    j = j.withColumn("p1_scale", scale)
    for v in values:
        j = j.withColumn(f"{v}_raw", F.col(v)).withColumn(v, F.col(v) * F.col("p1_scale"))
    return j.withColumn("protocol", F.lit("P1"))


def denominator_audit(rows: DataFrame, presence: DataFrame, by: Sequence[str] = ("mode",),
                      keys: Sequence[str] = ("seq", "obj_id")) -> DataFrame:
    """Rows scored over more, or fewer, frames than the object is present in."""
    j = with_presence(rows, presence, keys)
    over = F.col("n_frames") > F.col("n_present")
    return j.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(over).alias("over"),
        F.count_if(F.col("n_frames") < F.col("n_present")).alias("under"),
        F.countDistinct(F.when(over, F.col("seq"))).alias("affected_seqs"))


def denominator_split(rows: DataFrame, presence: DataFrame, by: Sequence[str] = ("mode",),
                      keys: Sequence[str] = ("seq", "obj_id")) -> DataFrame:
    """Where n_frames lies between presence and clip length, and rows outside that range."""
    j = with_presence(rows, presence, keys)
    n, p, t = F.col("n_frames"), F.col("n_present"), F.col("n_clip")
    inside = (n >= p) & (n <= t)
    return j.groupBy(*by).agg(
        F.count_if(n == t).alias("clip"), F.count_if((n == p) & (n != t)).alias("present"),
        F.count_if(inside & (n != t) & (n != p)).alias("between"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"))


def protocol_summary(p0: DataFrame, p1: DataFrame) -> DataFrame:
    """Clip-equal means of both protocols per degradation and arm, and the change."""
    both = p0.select("degradation", "mode", "jf", F.lit("p0").alias("protocol")).unionByName(
        p1.select("degradation", "mode", "jf", F.lit("p1").alias("protocol")))
    w = both.groupBy("degradation", "mode").pivot("protocol", ["p0", "p1"]).agg(F.avg("jf"))
    return w.withColumn("change", F.col("p1") - F.col("p0"))


def protocol_gaps(summary: DataFrame, memory: str, families: Sequence[str]) -> DataFrame:
    """Memory-arm gap under both protocols for each family arm, averaged over degradations."""
    pick = lambda m, p: F.max(F.when(F.col("mode") == m, F.col(p)))
    g = summary.groupBy("degradation").agg(*[
        (pick(memory, p) - pick(f, p)).alias(f"{f}_{p}") for f in families for p in ("p0", "p1")])
    rows = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f"{f}_p0").alias("gap_p0"),
                              F.col(f"{f}_p1").alias("gap_p1")) for f in families])
    long = g.select("degradation", F.inline(rows)).where(F.col("gap_p0").isNotNull())
    return long.groupBy("family").agg(F.avg("gap_p0").alias("gap_p0"), F.avg("gap_p1").alias(
        "gap_p1"), F.count("*").alias("n_degradations"))


def skip_ends(df: DataFrame, n: str = "n_frames", frame: str = "frame") -> DataFrame:
    """Drop the first and last frame of clips longer than two frames."""
    return df.where((F.col(n) <= 2) | ((F.col(frame) > 0) & (F.col(frame) < F.col(n) - 1)))


def convention_gain(ab: DataFrame) -> DataFrame:
    """Additive gain of the released boundary rule over the measured cells."""
    gain = F.lit(0.5) * (F.col("official_f") - F.col("ours_f"))
    return ab.agg(F.avg(gain).alias("gain_mean"), F.min(gain).alias("gain_min"),
                  F.max(gain).alias("gain_max"), F.count("*").alias("n_cells"))


def transfer_convention(instances: DataFrame, ab: DataFrame) -> DataFrame:
    """Scores moved to the released rule, clip-equal, overall and per degradation.

    The gain is a single aggregated row; scores cannot exceed 1.
    """
    g = convention_gain(ab)
    tags = instances.select("*", F.explode(F.array(F.lit("all"), F.col("degradation"))).alias("pool"))
    per_seq = tags.groupBy("pool", "mode", "seq").agg(F.avg("jf").alias("base"))
    up = lambda x: F.avg(F.least(F.lit(1.0), F.col("base") + F.col(x)))
    names = ("gain_mean", "gain_min", "gain_max")
    j = per_seq.withColumn("_g", g.select(F.struct(*names)).scalar()).select(
        "*", *[F.col(f"_g.{n}").alias(n) for n in names])
    return j.groupBy("pool", "mode").agg(
        F.avg("base").alias("jf"), up("gain_mean").alias("jf_released"),
        up("gain_min").alias("jf_released_lo"), up("gain_max").alias("jf_released_hi"),
        F.count("*").alias("n_segments"))
