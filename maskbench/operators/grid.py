"""Filters, the protocol grid, resume, subset selection and arm configuration."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.keys import c, is_main
from ..functions.ordered import number_chunk, ordinal
from ..kernels.degrade import COMPOUNDS

ORACLE_MODE = "oracle_clean"


def temporal_subsample(df: DataFrame, stride: int, max_frames: int = 0, frame: str = "frame"
                       ) -> DataFrame:
    """Every ``stride``-th frame from 0, then at most ``max_frames`` of them per clip."""
    stride = max(1, int(stride))
    out = df.where(F.col(frame) % stride == 0)
    return out.where(F.col(frame) < max_frames * stride) if max_frames else out


def sequence_slice(df: DataFrame, offset: int = 0, limit: int = 0, seq: str = "seq",
                   chunk: Column | None = None) -> DataFrame:
    """Rows of the clips ``offset .. offset+limit`` in clip order."""
    names = df.select(seq).distinct()
    names = ordinal(names, [], [seq], number_chunk(seq) if chunk is None else chunk, "_i")
    keep = F.col("_i") >= offset
    if limit:
        keep = keep & (F.col("_i") < offset + limit)
    return df.join(names.where(keep).select(seq), seq, "left_semi")


def object_cap(df: DataFrame, max_objects: int, seq: str = "seq", obj: str = "obj_id"
               ) -> DataFrame:
    """Rows of the lowest ``max_objects`` object ids of each clip; 0 keeps all."""
    if not max_objects:
        return df
    w = W.partitionBy(seq).orderBy(obj)
    ids = df.select(seq, obj).distinct().withColumn("_r", F.row_number().over(w))
    return df.join(ids.where(F.col("_r") <= max_objects).select(seq, obj), [seq, obj],
                   "left_semi")


def first_frame_objects(pixels: DataFrame) -> DataFrame:
    """Objects labelled in frame 0 of each clip, from (seq, frame, obj_id) label counts."""
    return pixels.where((F.col("frame") == 0) & (F.col("obj_id") != 0)).select(
        "seq", "obj_id").distinct()


def sequences_without_objects(pixels: DataFrame) -> DataFrame:
    """Clips whose first frame shows no object: they would vanish from every table."""
    return pixels.select("seq").distinct().join(first_frame_objects(pixels), "seq", "left_anti")


def iqa_subset(df: DataFrame, mode: str) -> DataFrame:
    """Rows of one policy on degraded input; ablation rows and clean references are left out."""
    if mode == ORACLE_MODE:
        raise ValueError("the clean-input arm does not see the degraded frames")
    clean_ref = F.coalesce(F.col("clean_reference").cast("int"), F.lit(0)) == 0 \
        if "clean_reference" in df.columns else F.lit(True)
    return df.where((F.col("mode") == mode) & (F.col("degradation") != "clean") & clean_ref
                    & is_main("arm"))


def routed_observation(clean: Column | str, degraded: Column | str, mode: Column | str = "mode"
                       ) -> Column:
    """The oracle arm sees clean frames, all others the degraded ones."""
    return F.when(c(mode) == ORACLE_MODE, c(clean)).otherwise(c(degraded))


def contiguous_videos(frames: DataFrame, min_frames: int, max_frames: int, take: int = 0,
                      chunk: Column | None = None) -> DataFrame:
    """Every video with its verdict; the first ``take`` usable ones (all if 0) are selected.

    Usable: frame ids run 0..n-1 without gaps and n lies in the allowed range. The choice
    looks at ids only, never at scores.
    """
    g = frames.groupBy("video_id").agg(
        F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"), F.count("*").alias("n_frames"),
        F.countDistinct("frame_id").alias("n_distinct"))
    contiguous = ((F.col("lo") == 0) & (F.col("hi") == F.col("n_frames") - 1)
                  & (F.col("n_frames") == F.col("n_distinct")))
    g = g.select("video_id", "n_frames", F.when(~contiguous, "non-contiguous")
                 .when(F.col("n_frames") < min_frames, "too short")
                 .when(F.col("n_frames") > max_frames, "too long").alias("reason"))
    ok = ordinal(g.where(F.col("reason").isNull()), [], ["video_id"],
                 number_chunk("video_id") if chunk is None else chunk, "_i")
    keep = F.lit(True) if not take else F.col("_i") < take
    ok = ok.select("video_id", "n_frames", F.when(~keep, "beyond limit").alias("reason"))
    out = ok.unionByName(g.where(F.col("reason").isNotNull()))
    return out.select("video_id", "n_frames", F.coalesce("reason", F.lit("")).alias("reason"),
                      F.col("reason").isNull().cast("int").alias("selected"))


def condition_table(spark: SparkSession, degradations: Sequence[str], levels: Sequence[float]
                    ) -> DataFrame:
    """The protocol grid: a constant list of conditions with their members."""
    rows = [(d, float(v), int(d in COMPOUNDS), list(COMPOUNDS.get(d, [d])))
            for d in degradations for v in levels]
    return spark.createDataFrame(
        rows, "degradation string, level double, is_compound int, members array<string>")


def cell_grid(seqs: DataFrame, degradations: Sequence[str], levels: Sequence[float],
              modes: Sequence[str] = (), compounds: Mapping[str, Sequence[str]] = COMPOUNDS
              ) -> DataFrame:
    """Clips x conditions x arms, exploded from constant arrays on each clip row."""
    def is_comp(name: Column) -> Column:
        return name.isin(list(compounds)) if compounds else F.lit(False)

    out = seqs.select("seq", F.explode(F.array(*[F.lit(d) for d in degradations]))
                      .alias("degradation"))
    out = out.select("*", F.explode(F.array(*[F.lit(float(v)) for v in levels])).alias("level"))
    if modes:
        out = out.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return out.withColumn("is_compound", is_comp(F.col("degradation")).cast("int"))


def pending_cells(grid: DataFrame, done: DataFrame,
                  keys: Sequence[str] = ("seq", "mode", "degradation", "level")) -> DataFrame:
    """Cells without any finished row. The key leaves the object out on purpose."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def sweep_progress(grid: DataFrame, done: DataFrame, seconds_per_cell: float) -> DataFrame:
    """Finished and total cells, finished and started clips, and the time left."""
    keys = ["seq", "mode", "degradation", "level"]
    d = done.select(*keys).distinct().withColumn("_done", F.lit(1))
    j = grid.join(d, keys, "left")
    per_seq = j.groupBy("seq").agg(F.count("*").alias("t"), F.count("_done").alias("k"))
    return per_seq.agg(
        F.sum("k").alias("done_cells"), F.sum("t").alias("total_cells"),
        F.count_if(F.col("k") == F.col("t")).alias("finished_seqs"),
        F.count_if((F.col("k") > 0) & (F.col("k") < F.col("t"))).alias("in_flight_seqs"),
    ).withColumn("eta_s", (F.col("total_cells") - F.col("done_cells")) * F.lit(seconds_per_cell))


def resolve_arms(spark: SparkSession, defaults: Mapping[str, float],
                 arms: Mapping[str, Mapping[str, float]], ignored: Sequence[str] = ()
                 ) -> DataFrame:
    """Arm settings as rows: defaults overridden per arm.

    An unknown setting, one that never reaches a run, or an arm equal to the reference arm
    without saying so is refused.
    """
    rows = []
    for arm, over in arms.items():
        bad = sorted(set(over) - set(defaults))
        if bad:
            raise KeyError(f"arm {arm}: unknown setting(s) {bad}")
        dead = sorted(set(over) & set(ignored))
        if dead:
            raise ValueError(f"arm {arm}: setting(s) {dead} never reach a run")
        merged = {**defaults, **over}
        rows += [(arm, k, float(v), int(k in over)) for k, v in merged.items()]
    return spark.createDataFrame(rows, "arm string, setting string, value double, overridden int")


def arm_settings(arms: DataFrame, settings: Sequence[str]) -> DataFrame:
    """One row per arm with a typed column per setting, ready to join to results."""
    return arms.groupBy("arm").pivot("setting", list(settings)).agg(F.first("value"))
