"""Mask jobs: packed-bit columns in, scores and geometry out.

The kernels run per Arrow batch on stacks of equally sized masks; everything around them
(pairing, averaging, skipping) stays in DataFrame operations.
"""

from __future__ import annotations

from typing import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, LongType

from ..kernels import mask as K
from ..schemas import row_type


def _stacks(fn: Callable, cols: Sequence[pd.Series], h: pd.Series, w: pd.Series, n_out: int
            ) -> list[np.ndarray]:
    """Apply a stack kernel to each group of rows that share a frame size."""
    out = [np.full(len(h), np.nan, dtype=object) for _ in range(n_out)]
    for (hh, ww), idx in pd.DataFrame({"h": h.values, "w": w.values}).groupby(["h", "w"]).indices.items():
        args = [K.unpack([bytes(b) for b in c.values[idx]], int(hh), int(ww)) for c in cols]
        res = fn(*args)
        for o, r in zip(out, res if isinstance(res, tuple) else (res,)):
            o[idx] = list(r)
    return out


@F.pandas_udf(DoubleType())
def iou(a: pd.Series, b: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Region similarity J; two empty masks score 1."""
    return pd.Series(_stacks(K.region, (a, b), h, w, 1)[0].astype(float))


@F.pandas_udf(LongType())
def perimeter(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series(_stacks(lambda m: K.count(K.rim(m)), (a,), h, w, 1)[0].astype(np.int64))


@F.pandas_udf(LongType())
def area(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    return pd.Series(_stacks(K.count, (a,), h, w, 1)[0].astype(np.int64))


@F.pandas_udf(row_type("j:d f:d pred_area:l gt_area:l"))
def region_and_boundary(p: pd.Series, g: pd.Series, h: pd.Series, w: pd.Series, tol: pd.Series
                        ) -> pd.DataFrame:
    parts = []
    for t in tol.unique():
        at = tol == t
        j, f, pa, ga = _stacks(lambda x, y: (K.region(x, y), K.boundary(x, y, int(t)), K.count(x), K.count(y)),
                               (p[at], g[at]), h[at], w[at], 4)
        parts.append(pd.DataFrame({"j": j.astype(float), "f": f.astype(float), "pred_area": pa.astype(np.int64),
                                   "gt_area": ga.astype(np.int64)}, index=tol.index[at]))
    return pd.concat(parts).reindex(tol.index) if parts else pd.DataFrame(columns=["j", "f", "pred_area", "gt_area"])


@F.pandas_udf(row_type("j:d f:d"))
def released_region_and_boundary(p: pd.Series, g: pd.Series, h: pd.Series, w: pd.Series
                                 ) -> pd.DataFrame:
    j, f = _stacks(K.released_scores, (p, g), h, w, 2)
    return pd.DataFrame({"j": j.astype(float), "f": f.astype(float)})


@F.pandas_udf(row_type("x0:d y0:d x1:d y1:d"))
def bounding_box(a: pd.Series, h: pd.Series, w: pd.Series, pad: pd.Series) -> pd.DataFrame:
    parts = []
    for p in pad.unique():
        at = pad == p
        b = _stacks(lambda m: K.boxes(m, float(p)), (a[at],), h[at], w[at], 1)[0]
        parts.append(pd.DataFrame(list(b), columns=["x0", "y0", "x1", "y1"], index=pad.index[at], dtype=float))
    return pd.concat(parts).reindex(pad.index) if parts else pd.DataFrame(columns=["x0", "y0", "x1", "y1"], dtype=float)


@F.pandas_udf(BinaryType())
def fill_holes(a: pd.Series, h: pd.Series, w: pd.Series, max_area: pd.Series) -> pd.Series:
    return pd.Series([K.pack(K.fill_small_holes(K.unpack([bytes(b)], int(x), int(y))[0], int(lim))[None])[0]
                      for b, x, y, lim in zip(a, h, w, max_area)], dtype=object)


@F.pandas_udf(row_type("n_components:l largest:l smallest:l"))
def component_stats(a: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
    rows = []
    for b, x, y in zip(a, h, w):
        areas = K.components(K.unpack([bytes(b)], int(x), int(y))[0])[1][1:]
        rows.append((len(areas), areas.max() if len(areas) else 0, areas.min() if len(areas) else 0))
    return pd.DataFrame(rows, columns=["n_components", "largest", "smallest"], dtype="int64")


@F.pandas_udf(ArrayType(DoubleType()))
def colour_descriptor(rgb: pd.Series, bits: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    out = []
    for px, b, x, y in zip(rgb, bits, h, w):
        img = np.frombuffer(bytes(px), np.uint8).reshape(int(x), int(y), 3)
        out.append(K.colour_histogram(img, K.unpack([bytes(b)], int(x), int(y))[0]))
    return pd.Series(out)


@F.pandas_udf(BinaryType())
def label_mask(ids: pd.Series, h: pd.Series, w: pd.Series, obj: pd.Series) -> pd.Series:
    """Packed mask of one object id in a label map."""
    return pd.Series([np.packbits(np.frombuffer(bytes(b), np.uint8) == o).tobytes()
                      for b, o in zip(ids, obj)], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def label_histogram(ids: pd.Series) -> pd.Series:
    """Pixel count of each of the 256 palette indices."""
    return pd.Series([np.bincount(np.frombuffer(bytes(b), np.uint8), minlength=256) for b in ids])


def label_rows(labels: DataFrame) -> DataFrame:
    """(seq, frame, obj_id, n_pixels) of every id that occurs in a label map."""
    e = labels.select("seq", "frame", F.posexplode(label_histogram("ids")).alias("obj_id", "n_pixels"))
    return e.where(F.col("n_pixels") > 0)


def object_masks(labels: DataFrame, objects: DataFrame) -> DataFrame:
    """One packed mask per frame of every object listed for the clip."""
    j = labels.join(objects.select("seq", "obj_id"), "seq")
    m = j.withColumn("bits", label_mask("ids", "h", "w", "obj_id"))
    return m.select("seq", "obj_id", "frame", "h", "w", "bits").withColumn(
        "area", area("bits", "h", "w"))


def score_frames(pred: DataFrame, gt: DataFrame, keys: Sequence[str], tol: int = 2,
                 convention: str = "ours") -> DataFrame:
    """J, F and their mean for every (key) mask pair."""
    p = pred.select(*keys, "h", "w", F.col("bits").alias("_p"))
    j = p.join(gt.select(*keys, F.col("bits").alias("_g")), list(keys))
    if convention == "released":
        s = j.withColumn("_s", released_region_and_boundary("_p", "_g", "h", "w"))
        out = s.select(*keys, "_s.j", "_s.f")
    else:
        s = j.withColumn("_s", region_and_boundary("_p", "_g", "h", "w", F.lit(tol)))
        out = s.select(*keys, "_s.j", "_s.f", "_s.pred_area", "_s.gt_area")
    return out.withColumn("jf", (F.col("j") + F.col("f")) / 2)


def sequence_scores(frames: DataFrame, keys: Sequence[str], skip_empty: bool = True) -> DataFrame:
    """Mean J and F over a clip. Frames where both masks are empty are not scored by default;
    a clip without scored frames gets 0 over 0 frames."""
    scored = F.lit(True)
    if skip_empty:
        scored = (F.col("pred_area") > 0) | (F.col("gt_area") > 0)
    g = frames.groupBy(*keys).agg(F.avg(F.when(scored, F.col("j"))).alias("j"),
                                  F.avg(F.when(scored, F.col("f"))).alias("f"),
                                  F.count_if(scored).alias("n_frames"))
    j, f = (F.coalesce(F.col(x), F.lit(0.0)) for x in "jf")
    return g.select(*keys, j.alias("j"), f.alias("f"), ((j + f) / 2).alias("jf"), "n_frames")


def convention_table(pred: DataFrame, gt: DataFrame, keys: Sequence[str], clip: Sequence[str],
                     lengths: DataFrame) -> DataFrame:
    """Both scoring conventions with and without the clip ends, one row per clip and object."""
    ours = score_frames(pred, gt, keys).join(lengths, list(clip))
    rel = score_frames(pred, gt, keys, convention="released").join(lengths, list(clip))
    inner = (F.col("n_clip") <= 2) | ((F.col("frame") > 0) & (F.col("frame") < F.col("n_clip") - 1))
    by = [k for k in keys if k != "frame"]

    def part(df: DataFrame, name: str, skip: bool) -> DataFrame:
        s = sequence_scores(df.where(inner) if skip else df, by, skip_empty=name == "ours")
        tag = f"{name}_skip" if skip else name
        return s.select(*by, *[F.col(x).alias(f"{tag}_{x}") for x in ("j", "f", "jf")])

    out = part(ours, "ours", False)
    for df, name, skip in ((ours, "ours", True), (rel, "released", False), (rel, "released", True)):
        out = out.join(part(df, name, skip), by)
    return out.withColumn("delta_skip_released", F.col("released_skip_jf") - F.col("ours_jf"))


def expand_box(x0: Column, y0: Column, x1: Column, y1: Column, scale: float, h: Column, w: Column
               ) -> Column:
    """Box scaled about its centre and clamped to the frame; a side is at least two pixels."""
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    hw = F.greatest(F.lit(1.0), (x1 - x0) / 2) * scale
    hh = F.greatest(F.lit(1.0), (y1 - y0) / 2) * scale
    return F.struct(F.greatest(F.lit(0.0), cx - hw).alias("x0"),
                    F.greatest(F.lit(0.0), cy - hh).alias("y0"),
                    F.least(w - 1.0, cx + hw).alias("x1"), F.least(h - 1.0, cy + hh).alias("y1"))


@F.pandas_udf(BinaryType())
def _weighted_vote(masks: pd.Series, weights: pd.Series, h: pd.Series, w: pd.Series,
                   thresh: pd.Series) -> pd.Series:
    out = []
    for bs, ws, x, y, t in zip(masks, weights, h, w, thresh):
        m = K.unpack([bytes(b) for b in bs], int(x), int(y)).astype(np.float64)
        acc = np.tensordot(np.asarray(ws, float), m, axes=1)
        out.append(K.pack((np.round(acc, 9) >= t)[None])[0])
    return pd.Series(out, dtype=object)


def fuse(chosen: DataFrame, key: Sequence[str], thresh: float = 0.5) -> DataFrame:
    """Belief-weighted vote of the chosen candidates of a frame: a top-k list, so k masks."""
    g = chosen.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("rank", "weight", "bits"))).alias("_c"),
        F.first("h").alias("h"), F.first("w").alias("w"))
    return g.select(*key, "h", "w", F.size("_c").alias("n_fused"), _weighted_vote(
        "_c.bits", "_c.weight", "h", "w", F.lit(float(thresh))).alias("bits"))


def bits_from_array(values: Column | str, threshold: float = 0.0) -> Column:
    """Packed bits of a 64-value array: bit i is ``value > threshold`` (JVM-side)."""
    v = F.col(values) if isinstance(values, str) else values
    digits = F.array_join(F.transform(v, lambda x: F.when(x > threshold, "1").otherwise("0")), "")
    return F.unhex(F.lpad(F.conv(digits, 2, 16), 16, "0"))


