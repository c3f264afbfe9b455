"""Queries over frame and label trees: texts are written as one file per document in the known layouts and read back."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType

from ..kernels.png import write_png
from ..session import materialise, shared_dir
from ..sources import frame_tree as ft, labels as lb
from . import views as V
from .registry import query

KINDS = ("davis", "mose", "ytvos")
FRAMES_AT = {"davis": "davis/JPEGImages/480p", "mose": "mose/valid/JPEGImages", "ytvos": "ytvos/valid/JPEGImages"}
LABELS_AT = {"davis": "davis/Annotations/480p", "mose": "mose/valid/Annotations", "ytvos": "ytvos/valid/Annotations"}
_KIND = "CASE (doc_id // 16) % 3 WHEN 0 THEN 'davis' WHEN 1 THEN 'mose' ELSE 'ytvos' END"


def _root(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _documents(spark, sf) -> DataFrame:
    """Documents as frames: 16 to a clip, clips dealt to the three layouts, file numbers in steps of five."""
    d = V.table(spark, sf, "documents")
    seq = F.floor(F.col("doc_id") / 16)
    return d.select(seq.alias("clip"), seq.cast("string").alias("seq"), (F.col("doc_id") % 16 * 5).alias("number"),
                    F.element_at(F.array(*[F.lit(k) for k in KINDS]), (seq % 3 + 1).cast("int")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def _path(at: dict[str, str], extension: str):
    where = F.element_at(F.create_map(*[F.lit(x) for kv in at.items() for x in kv]), F.col("kind"))
    return F.format_string("%s/%s/%05d." + extension, where, F.col("seq"), F.col("number"))


def _write_frames(spark, d: DataFrame) -> str:
    root = _root(spark, "tree")
    ft.write_tree(d.select(_path(FRAMES_AT, "jpg").alias("file"), F.encode("text", "UTF-8").alias("content")), root)
    return root


@query("frame_trees", f"""SELECT {_KIND} AS kind, CAST(doc_id // 16 AS VARCHAR) AS seq, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) - 1 AS frame,
5 * (doc_id % 16) AS number, strlen(coalesce(text, '')) AS bytes, md5(coalesce(text, '')) AS digest FROM documents""")
def _(spark, sf):
    """Frames of three layouts, with their places in the clips and their whole contents."""
    root = _write_frames(spark, _documents(spark, sf))
    out = None
    for kind in KINDS:
        one = ft.read_tree(spark, kind, [f"{root}/absent", f"{root}/{kind}"], split="valid", allow_missing_split=True).select(
            F.lit(kind).alias("kind"), "seq", "frame", "number", F.col("length").alias("bytes"), F.md5("content").alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@query("split_frames", """WITH f AS (SELECT doc_id // 16 AS clip, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY doc_id) - 1 AS frame, strlen(coalesce(text, '')) AS n FROM documents
WHERE (doc_id // 16) % 3 = 0) SELECT 'listed' AS part, CAST(clip AS VARCHAR) AS seq, count(*) AS frames, CAST(sum(n) AS BIGINT) AS bytes FROM f WHERE clip % 2 = 0 GROUP BY clip
UNION ALL SELECT 'no_list', CAST(clip AS VARCHAR), count(*), CAST(sum(n) AS BIGINT) FROM f GROUP BY clip
UNION ALL SELECT 'early', CAST(clip AS VARCHAR), count(*), CAST(sum(n) AS BIGINT) FROM f WHERE frame < 3 GROUP BY clip""")
def _(spark, sf):
    """The clips of a split list, all clips where there is none, and the first frames of each; contents are not read."""
    d = _documents(spark, sf)
    root = _write_frames(spark, d.where("kind = 'davis'"))
    d.where("kind = 'davis' AND clip % 2 = 0").select("seq").distinct().write.text(f"{root}/davis/ImageSets/2017/val.txt")
    kept = ft.read_tree(spark, "davis", root, "val", content=False)
    every = ft.read_tree(spark, "davis", root, "absent", content=False, allow_missing_split=True)
    early = ft.read_tree(spark, "davis", root, "absent", content=False, allow_missing_split=True, frames=(0, 3))
    parts = [("listed", kept), ("no_list", every), ("early", early)]
    out = None
    for name, rows in parts:
        one = rows.groupBy("seq").agg(F.count("*").alias("frames"), F.sum("length").alias("bytes")).select(F.lit(name).alias("part"), "seq", "frames", "bytes")
        out = one if out is None else out.unionByName(one)
    return out


# ---- label maps -----------------------------------------------------------------------------

WIDTH = 32


def _maps(texts: pd.Series, values: dict[str, int]) -> list[np.ndarray]:
    table = np.zeros(256, np.uint8)
    for letter, v in values.items():
        table[ord(letter)] = v
    out = []
    for t in texts:
        raw = t.encode("utf-8")
        h = max(1, -(-len(raw) // WIDTH))
        out.append(table[np.frombuffer(raw.ljust(h * WIDTH, b"\x00"), np.uint8)].reshape(h, WIDTH))
    return out


@F.pandas_udf(BinaryType())
def _palette_file(text: pd.Series, kind: pd.Series) -> pd.Series:
    maps = _maps(text, {"e": 1, "a": 2, " ": 4})
    return pd.Series([write_png(m, int(k), palette=True) for m, k in zip(maps, kind)], dtype=object)


@F.pandas_udf(BinaryType())
def _colour_file(text: pd.Series, kind: pd.Series) -> pd.Series:
    shades = np.array([[0, 0, 0], [10, 0, 0], [0, 200, 0], [0, 0, 7]], np.uint8)
    return pd.Series([write_png(shades[m], int(k)) for m, k in zip(_maps(text, {"e": 1, "a": 2, " ": 3}), kind)], dtype=object)


def _pixels(ids: str, k: int):
    """Pixels of one id below 128 in a map of bytes."""
    s = F.col(ids).cast("string")
    return (F.length(s) - F.length(F.replace(s, F.lit(chr(k)), F.lit("")))).cast("bigint")


def _label_tree(spark, d: DataFrame, file) -> str:
    """Labels where they lie beside frames; labels are found by the frame folder of a layout, so one empty frame each is there."""
    root = _root(spark, "labels")
    kind = (F.col("number") / 5 % 3).cast("int")
    ft.write_tree(d.select(_path(LABELS_AT, "png").alias("file"), file("text", kind).alias("content")), root)
    first = d.groupBy("kind").agg(F.min(F.struct("seq", "number")).alias("f")).select("kind", "f.*")
    ft.write_tree(first.select(_path(FRAMES_AT, "jpg").alias("file"), F.lit(b"").alias("content")), root)
    return root


def _sql_count(letter: str) -> str:
    return f"CAST(length(text) - length(replace(text, '{letter}', '')) AS BIGINT)"


_DOCS = (f"(SELECT *, {_sql_count('e')} AS e, {_sql_count('a')} AS a, {_sql_count(' ')} AS s, CAST({WIDTH} * greatest(1, ceil(strlen(text) / {float(WIDTH)})) AS BIGINT) AS px "
         "FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))")


@query("palette_labels", f"SELECT {_KIND} AS kind, CAST(doc_id // 16 AS VARCHAR) AS seq, 5 * (doc_id % 16) AS frame, px AS pixels, e AS id_1, a AS id_2, s AS id_4 FROM {_DOCS}")
def _(spark, sf):
    """Palette maps of three layouts: pixels of each object by label number."""
    root = _label_tree(spark, _documents(spark, sf), _palette_file)
    out = None
    for kind in KINDS:
        tree = ft.read_tree(spark, kind, f"{root}/{kind}", "valid", "labels", allow_missing_split=True)
        one = lb.palette_labels(tree).select(F.lit(kind).alias("kind"), "seq", "frame", F.length("ids").cast("bigint").alias("pixels"),
                                             *[_pixels("ids", k).alias(f"id_{k}") for k in (1, 2, 4)])
        out = one if out is None else out.unionByName(one)
    return out


@query("colour_labels", f"""WITH d AS (SELECT *, CAST(doc_id // 16 AS VARCHAR) AS seq, 5 * (doc_id % 16) AS frame, (e + a + s < px)::INT AS k, (s > 0)::INT AS ks, (a > 0)::INT AS ka FROM {_DOCS}
WHERE (doc_id // 16) % 3 = 2)
SELECT 'named' AS part, seq, frame, px - e - a AS background, array_to_string([e, a], ',') AS areas FROM d UNION ALL
SELECT 'ranked', seq, frame, px - e - a - s, array_to_string(list_transform([1, 2, 3, 4], lambda i: CASE WHEN s > 0 AND i = k + 1 THEN s WHEN a > 0 AND i = k + ks + 1 THEN a
WHEN e > 0 AND i = k + ks + ka + 1 THEN e ELSE 0 END), ',') FROM d""")
def _(spark, sf):
    """24-bit maps: ids by the colours of a meta file, where an unnamed colour is background, and by rank where there is none."""
    root = _label_tree(spark, _documents(spark, sf).where("kind = 'ytvos'"), _colour_file)
    meta = '{"objects": {"": {"1": {"palette": [10, 0, 0]}, "2": {"palette": [0, 200, 0]}}}}'
    tree = ft.read_tree(spark, "ytvos", f"{root}/ytvos", "valid", "labels")
    maps = materialise(lb.colour_maps(tree).select("seq", "number", "h", "w", "colours", "at"))
    named = lb.colour_labels(maps, lb.meta_colours(spark.range(1).select(F.lit(meta).alias("value"))))
    out = None
    for part, rows, ids in (("named", named, (1, 2)), ("ranked", lb.colour_labels(maps), (1, 2, 3, 4))):
        areas = F.array_join(F.array(*[_pixels("ids", k).cast("string") for k in ids]), ",")
        one = rows.select(F.lit(part).alias("part"), "seq", "frame", _pixels("ids", 0).alias("background"), areas.alias("areas"))
        out = one if out is None else out.unionByName(one)
    return out
