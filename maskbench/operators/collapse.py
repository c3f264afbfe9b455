"""Equal-weight collapses: frames to instances, instances to clips, clips to group means."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..schemas import INSTANCE_KEY, SEQUENCE_KEY


def _moments(value: str, mean: str, std: str) -> list:
    return [F.avg(value).alias(mean), F.stddev_pop(value).alias(std)]


def sequence_level(df: DataFrame, value: str = "jf_frame", keys: Sequence[str] = INSTANCE_KEY,
                   meta: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Frames to one score per instance cell: mean, population std, count.

    ``meta`` columns repeat on every frame; they are taken from the first frame by ``order``.
    """
    pick = [(F.min_by(m, order) if order else F.min(m)).alias(m) for m in meta]
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *_moments(value, "jf", "jf_std"), F.count("*").alias("n_frames"), *pick)


def collapse_objects(df: DataFrame, value: str = "jf", keys: Sequence[str] = SEQUENCE_KEY,
                     counters: Sequence[str] = ()) -> DataFrame:
    """Instances to one score per clip: the mean of instance means, so clips weigh the same."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        *_moments(value, "jf", "jf_std"), F.count("*").alias("n_objects"),
        *[F.avg(x).alias(x) for x in counters])


def clip_scores(df: DataFrame, value: str = "jf_frame") -> DataFrame:
    """Both collapses in a row: frames to clips."""
    return collapse_objects(sequence_level(df, value))


def collapse_instances_per_frame(df: DataFrame, value: str = "jf_frame",
                                 metrics: Sequence[str] = ()) -> DataFrame:
    """One observation per cell and frame: a frame's image metrics count once, not per object."""
    keys = ("seq", "mode", "degradation", "level", "arm", "frame")
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias(value), F.count("*").alias("n_instances"),
        *[F.min_by(m, "obj_id").alias(m) for m in metrics])


def group_mean(df: DataFrame, keys: Sequence[str], value: str = "jf") -> DataFrame:
    """Mean, population std and count by any keys."""
    return df.groupBy(*keys).agg(*_moments(value, "jf_mean", "jf_std"), F.count("*").alias("n"))


def attribute_breakdown(df: DataFrame, attribute: str = "degradation", value: str = "jf"
                        ) -> DataFrame:
    return df.groupBy(attribute).agg(F.avg(value).alias("jf_mean"), F.count("*").alias("n"))


def describe_dataset(frames: DataFrame) -> DataFrame:
    """Clips, frames and objects of a (seq, frame, obj_id) table, in one pass per level."""
    per_seq = frames.groupBy("seq").agg(F.countDistinct("frame").alias("f"),
                                        F.countDistinct("obj_id").alias("o"))
    return per_seq.agg(F.count("*").alias("n_sequences"), F.sum("f").alias("n_frames"),
                       F.sum("o").alias("n_objects"), F.max("o").alias("max_objects"))
