"""Frame jobs: severity schedule, corruption, restoration, image quality, resizing.

Kernels are pandas UDFs on one frame at a time. Seeds come from the clip name and the original
frame index, so any partitioning renders the same pixels.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..functions.keys import c, hash32, sequence_seed
from ..functions.ordered import spread
from ..kernels import degrade as D, quality as Q, restore as R
from ..kernels.image import as_bytes
from ..schemas import IQA_METRICS, row_type
from .grid import ORACLE_MODE

FRAME_KEY = ("seq", "frame")
_IQA_TYPE = row_type(" ".join(f"{m}:d" for m in IQA_METRICS))


def _image(px: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(bytes(px), np.uint8).reshape(int(h), int(w), 3)


@F.pandas_udf(DoubleType())
def _numpy_phase(seed: pd.Series) -> pd.Series:
    return seed.map(D.schedule_phase).astype(float)


def severity_schedule(level: Column | str, t: Column | str, n: Column | str, seed: Column | str,
                      amp: float = 0.30, phase: str = "numpy") -> Column:
    """Severity of frame t of n: level * (1 + amp sin(2 pi t / period + phase)) within [1, 5].

    The phase comes from the seed by the numpy generator, or from md5 where any SQL engine
    has to reproduce it.
    """
    period = F.greatest(F.lit(8), F.floor(c(n) / 2)).cast("double")
    if phase == "numpy":
        phi = _numpy_phase(c(seed))
    else:
        phi = hash32(seed, F.lit("phase")) / F.lit(float(1 << 32)) * F.lit(2 * np.pi)
    wave = c(level) * (1 + F.lit(float(amp)) * F.sin(F.lit(2 * np.pi) * c(t) / period + phi))
    return F.least(F.lit(5.0), F.greatest(F.lit(1.0), wave))


def severity_scaled(level: Column | str) -> Column:
    return (F.least(F.lit(5.0), F.greatest(F.lit(1.0), c(level).cast("double"))) - 1) / 4


def stream_seed(seed: Column | str, stream: Column | str) -> Column:
    return c(seed).cast("bigint") * 1_000_003 + c(stream)


@F.pandas_udf(BinaryType())
def _degrade(rgb: pd.Series, h: pd.Series, w: pd.Series, name: pd.Series, severity: pd.Series,
             seed: pd.Series, stream: pd.Series) -> pd.Series:
    return pd.Series([
        as_bytes(D.degrade(_image(px, a, b), n, s, k, t)).tobytes()
        for px, a, b, n, s, k, t in zip(rgb, h, w, name, severity, seed, stream)], dtype=object)


@F.pandas_udf(BinaryType())
def _restore(rgb: pd.Series, h: pd.Series, w: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([as_bytes(R.restore(_image(px, a, b), n)).tobytes()
                      for px, a, b, n in zip(rgb, h, w, name)], dtype=object)


@F.pandas_udf(_IQA_TYPE)
def iqa_panel(rgb: pd.Series, clean: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    """The eight image metrics; the two full-reference ones are NaN without a clean frame."""
    rows = [Q.panel(_image(px, a, b), None if ref is None else _image(ref, a, b))
            for px, ref, a, b in zip(rgb, clean, h, w)]
    return pd.DataFrame(rows, columns=list(IQA_METRICS), dtype=float)


def degraded_sequences(frames: DataFrame, conditions: Sequence[tuple[str, float]], stride: int = 1,
                       max_frames: int = 0, seed: int = 0, amp: float = 0.30,
                       temporal_variation: bool = True) -> DataFrame:
    """Subsampled clips under every (degradation, level) of a constant grid.

    ``t`` is the position in the subsampled clip, ``frame`` the original index that seeds the
    pixels. A clean condition copies the frames at severity 1.
    """
    stride = max(1, stride)
    f = frames.where(F.col("frame") % stride == 0)
    if max_frames:
        f = f.where(F.col("frame") < max_frames * stride)
    n = f.groupBy("seq").agg(F.count("*").alias("n_frames"))
    cond = F.array(*[F.struct(F.lit(d).alias("degradation"), F.lit(float(v)).alias("level"))
                     for d, v in conditions])
    d = spread(f.join(n, "seq"), FRAME_KEY).withColumn("t", (F.col("frame") / stride).cast("int")).select(
        "*", F.inline(cond))
    d = d.withColumn("seq_seed", sequence_seed("seq", seed))
    sev = F.col("level")
    if temporal_variation:
        sev = severity_schedule("level", "t", "n_frames", "seq_seed", amp)
    d = d.withColumn("severity", F.when(F.col("degradation") == "clean", 1.0).otherwise(
        sev.cast("float").cast("double")))
    return d.withColumnRenamed("rgb", "clean_rgb").withColumn(
        "rgb", _degrade("clean_rgb", "h", "w", "degradation", "severity", "seq_seed", "frame"))


def degrade_frames(frames: DataFrame, name: str, level: float, seed: int = 0) -> DataFrame:
    """Every frame under one condition at constant severity."""
    return spread(frames, FRAME_KEY).withColumn("rgb", _degrade(
        "rgb", "h", "w", F.lit(name), F.lit(float(level)), sequence_seed("seq", seed), "frame"))


def restore_frames(frames: DataFrame, names: Sequence[str] = R.NAMES) -> DataFrame:
    """Each frame through each named filter; the names are a constant list.

    A frame moves once and is repeated for the filters where it arrives.
    """
    unknown = sorted(set(names) - set(R.NAMES))
    if unknown:
        raise KeyError(f"unknown filter(s) {unknown}")
    ops = F.array(*[F.struct(F.lit(R.NAMES.index(n)).alias("op"), F.lit(n).alias("op_name"))
                    for n in names])
    return spread(frames, FRAME_KEY).select("*", F.inline(ops)).withColumn(
        "rgb", _restore("rgb", "h", "w", "op_name"))


def bank_table(spark) -> DataFrame:
    """The restoration bank as rows: index, name, target family."""
    return spark.createDataFrame([(i, n, f) for i, (n, f, _) in enumerate(R.BANK)],
                                 "op int, op_name string, family string")


def with_iqa(frames: DataFrame, clean: str | None = None) -> DataFrame:
    """Add the image metrics of every observation, once per frame and not per object."""
    ref = F.col(clean) if clean else F.lit(None).cast("binary")
    d = frames.withColumn("_q", iqa_panel("rgb", ref, "h", "w"))
    return d.select(*frames.columns, *[
        F.when(~F.isnan(f"_q.{m}"), F.col(f"_q.{m}")).alias(m) for m in IQA_METRICS])


def iqa_for_instances(instances: DataFrame, iqa: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Image metrics joined to the instance rows of the same observation."""
    return instances.join(iqa.select(*keys, *IQA_METRICS), list(keys), "left")


def observations_for_modes(degraded: DataFrame, modes: Sequence[str]) -> DataFrame:
    """Frames as each arm sees them: the oracle arm gets the clean ones."""
    d = degraded.select("*", F.explode(F.array(*[F.lit(m) for m in modes])).alias("mode"))
    return d.withColumn("rgb", F.when(F.col("mode") == ORACLE_MODE, F.col("clean_rgb"))
                        .otherwise(F.col("rgb")))


@F.pandas_udf(BinaryType())
def _resize_area(rgb: pd.Series, h: pd.Series, w: pd.Series, nh: pd.Series, nw: pd.Series
                 ) -> pd.Series:
    def overlap(n_out: int, n_in: int) -> np.ndarray:
        edge = np.arange(n_out + 1) * n_in / n_out
        cell = np.arange(n_in)
        m = np.clip(np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell), 0, 1)
        return m / m.sum(1, keepdims=True)

    out = []
    for px, a, b, x, y in zip(rgb, h, w, nh, nw):
        img = _image(px, a, b).astype(float)
        small = np.einsum("ij,jkc,lk->ilc", overlap(int(x), int(a)), img, overlap(int(y), int(b)))
        out.append(np.floor(small + 0.5).clip(0, 255).astype(np.uint8).tobytes())
    return pd.Series(out, dtype=object)


@F.pandas_udf(BinaryType())
def _resize_nearest(ids: pd.Series, h: pd.Series, w: pd.Series, nh: pd.Series, nw: pd.Series
                    ) -> pd.Series:
    out = []
    for px, a, b, x, y in zip(ids, h, w, nh, nw):
        m = np.frombuffer(bytes(px), np.uint8).reshape(int(a), int(b))
        iy = np.arange(int(x)) * int(a) // int(x)
        ix = np.arange(int(y)) * int(b) // int(y)
        out.append(m[np.ix_(iy, ix)].tobytes())
    return pd.Series(out, dtype=object)


def resize_frames(frames: DataFrame, h: int, w: int) -> DataFrame:
    """Frames to a fixed size by area averaging."""
    return frames.withColumn("rgb", _resize_area("rgb", "h", "w", F.lit(h), F.lit(w))).withColumn(
        "h", F.lit(h)).withColumn("w", F.lit(w))


def resize_labels(labels: DataFrame, h: int, w: int) -> DataFrame:
    """Label maps to a fixed size by nearest index, so ids never blend."""
    return labels.withColumn("ids", _resize_nearest("ids", "h", "w", F.lit(h), F.lit(w))).withColumn(
        "h", F.lit(h)).withColumn("w", F.lit(w))


@F.pandas_udf(DoubleType())
def separation(rgb: pd.Series, bits: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """|mean luminance inside - outside| of a mask on a frame; NaN if one side is empty."""
    from ..kernels.image import luminance

    out = []
    for px, b, x, y in zip(rgb, bits, h, w):
        g = luminance(_image(px, x, y)).ravel()
        m = np.unpackbits(np.frombuffer(bytes(b), np.uint8))[: g.size].astype(bool)
        out.append(abs(g[m].mean() - g[~m].mean()) if m.any() and not m.all() else np.nan)
    return pd.Series(out, dtype=float)


def alignment_profile(frames: DataFrame, masks: DataFrame, offsets: Sequence[int] = range(-3, 4)
                      ) -> DataFrame:
    """Mean fit of masks to frames shifted by each offset: it must peak at 0.

    A mask counts only if it can be scored at every offset. The offsets are a short constant
    list, so this is an equi join on (seq, frame + offset).
    """
    offsets = [int(o) for o in offsets]
    m = masks.select("seq", "frame", "bits", F.explode(F.array(*[F.lit(o) for o in offsets]))
                     .alias("offset")).withColumn("at", F.col("frame") + F.col("offset"))
    f = frames.select("seq", F.col("frame").alias("at"), "rgb", "h", "w")
    s = m.join(f, ["seq", "at"]).select("seq", "frame", "offset",
                                        separation("rgb", "bits", "h", "w").alias("s"))
    s = s.where(~F.isnan("s"))
    whole = s.groupBy("seq", "frame").agg(F.count("*").alias("k")).where(
        F.col("k") == len(offsets)).drop("k")
    return s.join(whole, ["seq", "frame"]).groupBy("offset").agg(
        F.avg("s").alias("mean_fit"), F.count("*").alias("n"))


def alignment_win_rate(frames: DataFrame, masks: DataFrame, gap: int = 1, shift: int = 0
                       ) -> DataFrame:
    """Share of masks that fit their own frame at least as well as the frame ``gap`` later.

    ``shift`` takes the mask from a later frame instead: the control that must lose.
    """
    m = masks.select("seq", (F.col("frame") - shift).alias("frame"), "bits")
    f = frames.select("seq", "frame", "rgb", "h", "w")
    far = frames.select("seq", (F.col("frame") - gap).alias("frame"), F.col("rgb").alias("far"))
    j = m.join(f, ["seq", "frame"]).join(far, ["seq", "frame"]).select(
        separation("rgb", "bits", "h", "w").alias("here"),
        separation("far", "bits", "h", "w").alias("there"))
    ok = j.where(~F.isnan("here") & ~F.isnan("there"))
    return ok.agg(F.lit(gap).alias("gap"), F.lit(shift).alias("shift"), F.count("*").alias("n"),
                  F.avg((F.col("here") >= F.col("there")).cast("double")).alias("win_rate"))
