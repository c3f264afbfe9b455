"""Result tables: tolerant CSV scans, chunk discovery, sinks."""

from __future__ import annotations

import re
from typing import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.keys import to_number
from ..schemas import RESULTS_CELL, RESULTS_FRAME

REQUIRED_CELL = ("seq", "obj_id", "mode", "degradation", "level")


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: its first line only."""
    first = spark.read.text(path).limit(1).collect()
    return [x.strip().strip('"') for x in first[0][0].lstrip("﻿").split(",")] if first else []


def file_headers(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, header) of every CSV file under the paths, from one scan: the first line of each file's first split.

    Files without any line give no row. Names are stripped of blanks and quotes.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    lines = reader.text([paths] if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("path"), "value", F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_row")).where("_start = 0")
    first = lines.groupBy("path").agg(F.min_by("value", "_row").alias("_line"))
    names = F.split(F.regexp_replace("_line", "^\ufeff", ""), ",")
    return first.select("path", F.transform(names, lambda x: F.btrim(F.btrim(x), F.lit('"'))).alias("header"))


def header_report(headers: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(path, missing, extra, reordered) of files against the expected names; the order alone is no deviation."""
    want = F.array(*[F.lit(x) for x in expected])
    return headers.select("path", F.array_sort(F.array_except(want, F.col("header"))).alias("missing"),
                          F.array_sort(F.array_except(F.col("header"), want)).alias("extra"),
                          (F.array_intersect(F.col("header"), want) != F.array_intersect(want, F.col("header"))).cast("int").alias("reordered"))


def is_per_frame(header: Sequence[str]) -> bool:
    return "frame" in header


def _typed(schema: StructType) -> list:
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, StringType):
            out.append(F.coalesce(F.col(f"`{f.name}`"), F.lit("")).alias(f.name))
        else:
            out.append(to_number(F.col(f"`{f.name}`")).cast(f.dataType).alias(f.name))
    return out


def scan_results(spark: SparkSession, paths: str | Sequence[str],
                 required: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, dropped) of result CSVs of one format.

    Files are read as text columns, each by its own header, and typed afterwards, so columns may come in any
    order and one torn line costs itself only: rows without a required value are returned apart. Mixing per-frame and
    per-cell files is refused.
    """
    # one row per file; files of one header are read together, so the columns of each are taken by name
    variants: dict[tuple[str, ...], list[str]] = {}
    for r in file_headers(spark, paths).collect():
        variants.setdefault(tuple(r.header), []).append(unquote(r.path))
    kinds = {is_per_frame(h) for h in variants}
    if len(kinds) > 1:
        raise ValueError("per-frame and per-cell results cannot be mixed")
    per_frame = kinds == {True}
    schema = RESULTS_FRAME if per_frame else RESULTS_CELL
    need = list(required or REQUIRED_CELL + (("frame",) if per_frame else ("n_frames", "J&F")))
    parts = []
    for header, mine in sorted(variants.items()):
        text = StructType([StructField(x, StringType()) for x in header])
        df = spark.read.schema(text).option("header", True).option("mode", "PERMISSIVE").option("escape", "\"").option(
            "enforceSchema", True).csv(mine)
        df = df.select(*[F.col(f"`{x}`") for x in header], F.input_file_name().alias("_src"))
        for f in schema.fields:
            if f.name not in header:
                df = df.withColumn(f.name, F.lit(None).cast("string"))
        parts.append(df.select(*_typed(schema), "_src"))
    if not parts:
        raise FileNotFoundError(f"no result rows in {paths}")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    bad = F.lit(False)
    for n in need:
        col = F.col(f"`{n}`")
        bad = bad | (col.isNull() | (col.cast("string") == ""))
    return rows.where(~bad), rows.where(bad)


def discover_chunks(spark: SparkSession, folder: str, base: str, exclude: Sequence[str] = ()
                    ) -> list[str]:
    """Chunk files ``<base>*.csv`` of a folder without the named outputs, in name order."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", f"{base}*.csv").load(
        folder).select("path").distinct()
    out = [r[0] for r in names.collect()]
    return sorted(p for p in out if re.split(r"[/\\]", p)[-1] not in set(exclude))


def check_headers(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Common column names of the chunks, in the first one's order; a chunk with other names fails and is named."""
    want = csv_header(spark, paths[0])
    bad = {r.path: [*r.missing, *r.extra] for r in header_report(file_headers(spark, paths), want).where(
        "size(missing) + size(extra) > 0").collect()}
    if bad:
        raise ValueError(f"chunk headers differ from {paths[0]}: {bad}")
    return want


def write_results(df: DataFrame, path: str, mode: str = "overwrite",
                  partition: Sequence[str] = ("degradation", "level")) -> None:
    """Parquet partitioned by condition; the committer makes the write all or nothing.

    Rows of a condition spread over tasks by clip, so a large condition is many files.
    """
    df.write.mode(mode).partitionBy(*partition).parquet(path)


def append_results(df: DataFrame, path: str, **kw) -> None:
    write_results(df, path, mode="append", **kw)


def write_results_csv(parts: Sequence[DataFrame], path: str) -> None:
    """CSV with the union of the columns in first-seen order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result table written by ``write_results``; conditions prune partitions."""
    df = spark.read.parquet(path)
    return df.withColumn("level", F.col("level").cast("double"))


def write_degraded(df: DataFrame, path: str) -> None:
    """Materialise degraded frames by condition; the protocol travels as columns."""
    df.write.mode("overwrite").partitionBy("degradation", "level").parquet(path)
