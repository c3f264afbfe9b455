"""Mask propagation along supplied optical flow (float32 HxWx2, frame t to t + 1)."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.ordered import median
from ..kernels import flow as K, mask as M
from ..schemas import row_type
from .masks import area, iou


def _flow(raw: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(bytes(raw), np.float32).reshape(int(h), int(w), 2)


@F.pandas_udf(BinaryType())
def warp_mask(bits: pd.Series, flow: pd.Series, h: pd.Series, w: pd.Series, sign: pd.Series
              ) -> pd.Series:
    """One nearest-neighbour step of a packed mask; sign 0 leaves it in place."""
    out = []
    for b, f, x, y, s in zip(bits, flow, h, w, sign):
        m = M.unpack([bytes(b)], int(x), int(y))[0]
        out.append(M.pack(K.warp(m, s * _flow(f, x, y))[None])[0])
    return pd.Series(out, dtype=object)


@F.pandas_udf(BinaryType())
def warp_soft(soft: pd.Series, flow: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """One bilinear step of a float32 probability map."""
    out = []
    for b, f, x, y in zip(soft, flow, h, w):
        m = np.frombuffer(bytes(b), np.float32).reshape(int(x), int(y)).astype(float)
        out.append(K.warp(m, _flow(f, x, y), soft=True).astype(np.float32).tobytes())
    return pd.Series(out, dtype=object)


@F.pandas_udf(DoubleType())
def soft_mass(soft: pd.Series) -> pd.Series:
    """Sum of a float32 probability map."""
    return pd.Series([float(np.frombuffer(bytes(b), np.float32).sum(dtype=float)) for b in soft], dtype=float)


@F.pandas_udf(DoubleType())
def inside_fraction(bits: pd.Series, flow: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Area after a step that drops what comes from outside, over the area before it."""
    out = []
    for b, f, x, y in zip(bits, flow, h, w):
        m = M.unpack([bytes(b)], int(x), int(y))[0]
        out.append(float(K.warp_inside(m, _flow(f, x, y)).sum()) / max(int(m.sum()), 1))
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def cycle_error(fwd: pd.Series, bwd: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Mean forward-backward inconsistency of two supplied flow fields."""
    return pd.Series([K.cycle_error(_flow(a, x, y), _flow(b, x, y))
                      for a, b, x, y in zip(fwd, bwd, h, w)], dtype=float)


@F.pandas_udf(row_type("move:d p95:d"))
def displacement(a: pd.Series, b: pd.Series, flow: pd.Series, h: pd.Series, w: pd.Series
                 ) -> pd.DataFrame:
    """Centroid shift between two masks and the 95th percentile flow inside the first."""
    rows = []
    for x, y, f, hh, ww in zip(a, b, flow, h, w):
        m, n = (M.unpack([bytes(v)], int(hh), int(ww))[0] for v in (x, y))
        if not m.any() or not n.any():
            rows.append((np.nan, np.nan))
            continue
        shift = np.argwhere(n).mean(0) - np.argwhere(m).mean(0)
        mag = np.sqrt((_flow(f, hh, ww).astype(float) ** 2).sum(-1))
        rows.append((float(np.hypot(*shift)), float(np.percentile(mag[m], 95))))
    return pd.DataFrame(rows, columns=["move", "p95"], dtype=float)


def flow_direction_audit(masks: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IoU with the next mask without a warp, along the flow and against it.

    ``keys`` identify an instance; masks meet their successor by an equi join on frame + 1.
    """
    nxt = masks.select(*keys, (F.col("frame") - 1).alias("frame"), F.col("bits").alias("_next"),
                       F.col("area").alias("_next_area"))
    j = masks.join(nxt, [*keys, "frame"]).join(flows.select("seq", "frame", "flow"),
                                               ["seq", "frame"])
    j = j.where((F.col("area") > 0) & (F.col("_next_area") > 0))
    sizes = ("h", "w")
    step = lambda s: iou(warp_mask("bits", "flow", *sizes, F.lit(s)), "_next", *sizes)
    s = j.select(F.lit("all").alias("k"), iou("bits", "_next", *sizes).alias("stay"),
                 step(1.0).alias("plus"), step(-1.0).alias("minus"),
                 displacement("bits", "_next", "flow", *sizes).alias("_d"))
    s = s.withColumn("ratio", F.col("_d.p95") / F.greatest(F.col("_d.move"), F.lit(1e-6)))
    gap = F.col("plus") - F.col("minus")
    out = s.groupBy("k").agg(
        F.count("*").alias("pairs"), F.avg("stay").alias("iou_stay"),
        F.avg("plus").alias("iou_plus"), F.avg("minus").alias("iou_minus"),
        F.count_if(gap > 1e-9).alias("wins"), F.count_if(F.abs(gap) <= 1e-9).alias("ties"))
    mid = median(s, ["k"], "ratio", "median_ratio").select("median_ratio").scalar()
    return out.drop("k").withColumn("median_ratio", mid)


def propagate(masks: DataFrame, flows: DataFrame, keys: Sequence[str], soft: bool = False) -> DataFrame:
    """Carry an instance's mask at frame 0 along the flow to the end of its clip: (keys, frame, h, w, mask).

    The start mask and the flow fields of a clip are one ordered stream of rows; a task folds it with one mask in
    memory, whatever the length of the clip. A chain ends where a flow field is missing; instances without a mask at
    frame 0 give no rows. ``keys`` include ``seq``; the masks' other frames are not read.
    """
    column = "soft" if soft else "bits"
    names = list(keys)
    start = masks.where(F.col("frame") == 0).select(*names, F.lit(-1).cast("bigint").alias("frame"), F.col("h").cast("int"), F.col("w").cast("int"),
                                                    F.col(column).alias("_data"))
    none = F.lit(None).cast("int")
    steps = flows.join(masks.select(*names).distinct(), "seq").where("frame >= 0").select(
        *names, F.col("frame").cast("bigint"), none.alias("h"), none.alias("w"), F.col("flow").alias("_data"))
    parts = int(masks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = start.unionByName(steps).repartition(parts, *names).sortWithinPartitions(*names, "frame")
    schema = StructType([*[masks.schema[k] for k in names], StructField("frame", LongType()), StructField("h", IntegerType()),
                         StructField("w", IntegerType()), StructField(column, BinaryType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instance, mask, due, h, w = None, None, 0, 0, 0
        for b in batches:
            at, out = [], []
            columns = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for i, (*key, frame, rows, width, data) in enumerate(zip(*columns)):
                if key != instance:
                    instance, mask, due = key, None, 0
                if frame < 0:
                    h, w = rows, width
                    mask = np.frombuffer(data, np.float32).reshape(h, w).astype(float) if soft else M.unpack([data], h, w)[0]
                    continue
                if frame != due:
                    mask = None
                if mask is not None:
                    mask, due = K.warp(mask, _flow(data, h, w), soft=soft), due + 1
                    at.append(i)
                    out.append((due, h, w, mask.astype(np.float32).tobytes() if soft else M.pack(mask[None])[0]))
            made = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i).take(pa.array(at, pa.int64())) for i in range(len(names))], pa.array(made[0], pa.int64()), pa.array(made[1], pa.int32()),
                 pa.array(made[2], pa.int32()), pa.array(made[3], pa.binary())], names=schema.fieldNames())

    return stream.mapInArrow(walk, schema)


def chain_table(masks: DataFrame, flows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area ratio and IoU of masks propagated from frame 0 against the true ones, one row per instance.

    Frames without a true mask are not compared; a ratio is NULL where the true mask is empty, an IoU where both are.
    An instance without a mask at frame 0 keeps its row, with nothing compared and NULL results.
    """
    p = propagate(masks, flows, keys).select(*keys, "frame", F.col("bits").alias("_p"))
    j = p.join(masks.select(*keys, F.col("frame").cast("bigint").alias("frame"), "h", "w", "bits", "area"), [*keys, "frame"])
    j = j.withColumn("_area", area("_p", "h", "w")).select(
        *keys, "frame", (F.col("_area") / F.nullif(F.col("area"), F.lit(0))).alias("ratio"),
        F.when(F.col("_area") + F.col("area") > 0, iou("_p", "bits", "h", "w")).alias("iou"))
    at = lambda c, s: F.max(F.when(F.col("frame") == s, F.col(c)))
    found = j.groupBy(*keys).agg(
        F.count("*").alias("n"), at("ratio", 1).alias("ratio_1"), at("ratio", 20).alias("ratio_20"),
        F.max("ratio").alias("ratio_max"), at("iou", 1).alias("iou_1"), at("iou", 10).alias("iou_10"),
        at("iou", 20).alias("iou_20"), F.max_by("iou", "frame").alias("iou_last"),
        F.min("iou").alias("iou_min"), F.count_if(F.col("ratio") > 3).alias("n_inflated"),
        F.count_if(F.col("iou") < 0.5).alias("n_lost"))
    return masks.select(*keys).distinct().join(found, list(keys), "left").na.fill(0, ["n", "n_inflated", "n_lost"])
