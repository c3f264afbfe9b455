"""Label maps of a tree: palette indices and 24-bit colours to object ids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from ..kernels.png import read_png
from ..schemas import row_type


@F.pandas_udf(row_type("h:i w:i ids:b"))
def _palette(content: pd.Series) -> pd.DataFrame:
    rows = []
    for m in read_png(content):
        if m.ndim != 2:
            raise ValueError("expected a grey or palette PNG")
        if m.max(initial=0) == 255 and not ((m > 0) & (m < 255)).any():
            m = (m == 255).astype(np.uint8)
        rows.append((*m.shape, m.tobytes()))
    return pd.DataFrame(rows, columns=["h", "w", "ids"]).astype({"h": "int32", "w": "int32"})


def palette_labels(tree: DataFrame) -> DataFrame:
    """(seq, frame, h, w, ids): the palette index is the id, a map of 0 and 255 only is a single object.

    ``tree`` has (seq, number, content); labels are addressed by the number in the file's name.
    """
    return tree.withColumn("_l", _palette("content")).select("seq", F.col("number").alias("frame"), "_l.h", "_l.w", "_l.ids")


_COLOURS = StructType([StructField("h", IntegerType()), StructField("w", IntegerType()), StructField("colours", ArrayType(LongType())),
                       StructField("at", BinaryType())])


@F.pandas_udf(_COLOURS)
def _colours(content: pd.Series) -> pd.DataFrame:
    """Distinct 24-bit keys in ascending order, and for each pixel the place of its key among them."""
    rows = []
    for m in read_png(content):
        m = m.astype(np.int32)
        key = (m * 65793 if m.ndim == 2 else (m[..., 0] << 16) + (m[..., 1] << 8) + m[..., 2]).ravel()
        keys = np.unique(key)
        if len(keys) > 65536:
            raise ValueError("more than 65536 colours: not a label map")
        rows.append((*m.shape[:2], keys.tolist(), np.searchsorted(keys, key).astype("<u2").tobytes()))
    return pd.DataFrame(rows, columns=["h", "w", "colours", "at"]).astype({"h": "int32", "w": "int32"})


@F.pandas_udf(BinaryType())
def _paint(at: pd.Series, ids: pd.Series) -> pd.Series:
    out = []
    for a, table in zip(at, ids):
        table = np.asarray(table, np.int64)
        if table.max(initial=0) > 255:
            raise ValueError("an object id above 255 does not fit a label map of bytes")
        out.append(table.astype(np.uint8)[np.frombuffer(bytes(a), "<u2")].tobytes())
    return pd.Series(out, dtype=object)


def colour_maps(tree: DataFrame) -> DataFrame:
    """The tree with (h, w, colours, at) in place of ``content``: what :func:`colour_labels` makes of it, for use by several of them."""
    kept = [x for x in tree.columns if x != "content"]
    return tree.withColumn("_l", _colours("content")).select(*kept, "_l.*")


def colour_labels(tree: DataFrame, colours: DataFrame | None = None, category: Column | None = None) -> DataFrame:
    """(seq, frame, h, w, ids) of 24-bit colour maps.

    ``colours`` has (category, key, obj_id); a clip of ``category`` takes its ids from there, and a colour
    that the category does not name is background. A clip whose category has no colours at all, or every
    clip without ``colours``, numbers the distinct colours of a map in ascending order from 1; black is 0
    but uses up its number. Ids come from a join on the few colours of a map; pixels are not joined.
    ``tree`` has one row for each (seq, number), or is what :func:`colour_maps` gives.
    """
    d = (colour_maps(tree) if "content" in tree.columns else tree).withColumn("category", F.lit("") if category is None else category).select(
        "seq", F.col("number").alias("frame"), "category", "h", "w", "colours", "at")
    ranked = F.transform("colours", lambda k, i: F.when(k == 0, 0).otherwise(i + 1))
    if colours is None:
        return d.select("seq", "frame", "h", "w", _paint("at", ranked).alias("ids"))
    table = colours.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("key", "obj_id"))).alias("ids_of"))
    d = d.join(table, "category", "left")
    named = F.transform("colours", lambda k: F.coalesce(F.try_element_at("ids_of", k), F.lit(0)))
    ids = F.when(F.col("ids_of").isNull(), ranked).otherwise(named)
    return d.select("seq", "frame", "h", "w", _paint("at", ids).alias("ids"))


def meta_colours(meta: DataFrame) -> DataFrame:
    """(category, key, obj_id) from the text of meta files, column ``value``; of ids with one colour the last named stays."""
    kind = "struct<objects: map<string, map<string, struct<palette: array<int>>>>>"
    cats = meta.select(F.explode(F.from_json("value", kind)["objects"]).alias("category", "objs"))
    objs = cats.select("category", F.posexplode(F.map_entries("objs")).alias("at", "o"))
    r, g, b = (F.coalesce(F.try_element_at("o.value.palette", F.lit(i)), F.lit(0)).cast("long") for i in (1, 2, 3))
    return objs.groupBy("category", (r * 65536 + g * 256 + b).alias("key")).agg(F.max_by(F.col("o.key").cast("int"), "at").alias("obj_id"))
