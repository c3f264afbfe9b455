"""Merging chunked sweeps: union, duplicate conflicts, short cells, reconciliation."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import all_of
from ..schemas import CELL_KEY
from ..session import materialise


def union_chunks(chunks: Sequence[DataFrame], source: Sequence[str] | None = None) -> DataFrame:
    """Chunks by column name, each row tagged with its source."""
    tagged = [d.withColumn("src", F.lit(s)) for d, s in zip(chunks, source or range(len(chunks)))]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def duplicate_groups(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key: rows, and whether the duplicates agree on every value column.

    Minimum and maximum per value combine map-side, so a key repeated in millions of rows
    costs a few bytes per task.
    """
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *_bounds(values))
    return g.select(*keys, "n_rows", (~_agree(values)).cast("int").alias("conflict"))


def _bounds(values: Sequence[str]) -> list[Column]:
    null = [F.count_if(F.col(v).isNull()).alias(f"_z{i}") for i, v in enumerate(values)]
    return null + [e for i, v in enumerate(values)
                   for e in (F.min(v).alias(f"_a{i}"), F.max(v).alias(f"_b{i}"))]


def _agree(values: Sequence[str]) -> Column:
    return all_of([F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
                   & F.col(f"_z{i}").isin(0) | (F.col(f"_z{i}") == F.col("n_rows"))
                   for i in range(len(values))])


def duplicate_report(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    g = duplicate_groups(df, keys, values)
    return g.agg(
        F.count("*").alias("distinct_rows"),
        F.sum(F.when(F.col("conflict") == 0, F.col("n_rows") - 1).otherwise(0)).alias("agreed"),
        F.sum("conflict").cast("bigint").alias("conflicts"))


def conflicts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return duplicate_groups(df, keys, values).where(F.col("conflict") == 1).drop("conflict")


def merge_chunks(df: DataFrame, keys: Sequence[str], values: Sequence[str],
                 check: bool = True) -> DataFrame:
    """One row per key. With ``check`` conflicting duplicates fail the job first.

    The checked rows are written once, so that what lies before is not worked out again for the result.
    """
    if not check:
        return df.dropDuplicates(list(keys))
    rest = [x for x in df.columns if x not in keys]
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *_bounds(values), *[F.first(F.col(f"`{x}`")).alias(f"_f{i}") for i, x in enumerate(rest)])
    place = {x: f"_f{i}" for i, x in enumerate(rest)}
    g = materialise(g.select(*[F.col(f"`{x}`") if x in keys else F.col(place[x]).alias(x) for x in df.columns],
                             F.when(~_agree(values), F.col("n_rows")).alias("_conflict")))
    bad = g.where(F.col("_conflict").isNotNull()).select(*keys, F.col("_conflict").alias("n_rows")).limit(5).collect()
    if bad:
        raise ValueError(f"conflicting duplicates, for example {bad}")
    return g.drop("_conflict")


def partial_cells(df: DataFrame, keys: Sequence[str], declared: str = "n_frames",
                  cell: Sequence[str] = CELL_KEY) -> DataFrame:
    """Cells with an instance whose row count differs from the declared one, or declares none."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.max(declared).alias("declared"))
    bad = (F.coalesce("declared", F.lit(0)) <= 0) | (F.col("n_rows") != F.col("declared"))
    return g.where(bad).groupBy(*cell).agg(F.count("*").alias("n_bad_instances"))


def trim_partial(df: DataFrame, keys: Sequence[str], declared: str = "n_frames",
                 cell: Sequence[str] = CELL_KEY) -> DataFrame:
    """Rows of complete cells only; trimmed cells can then be resumed."""
    return df.join(partial_cells(df, keys, declared, cell).select(*cell), list(cell), "left_anti")


def set_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one table that the other lacks, tagged missing (in a only) or extra (in b only)."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    return ka.join(kb, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(
        kb.join(ka, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def reconcile(recomputed: DataFrame, published: DataFrame, keys: Sequence[str],
              values: Sequence[str], within: Sequence[str]) -> DataFrame:
    """Full outer comparison: matched and unmatched rows and the largest difference per value."""
    a = recomputed.select(*keys, F.lit(1).alias("_l"), *[F.col(v).alias(f"_a_{v}") for v in values])
    b = published.select(*keys, F.lit(1).alias("_r"), *[F.col(v).alias(f"_b_{v}") for v in values])
    j = a.join(b, list(keys), "full_outer")
    return j.groupBy(*within).agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("only_recomputed"),
        F.count_if(F.col("_l").isNull()).alias("only_published"),
        *[F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(f"max_diff_{v}")
          for v in values])


def same_frame_restriction(trace: DataFrame, reference: DataFrame, stride: int,
                           keys: Sequence[str] = ("seq", "obj_id"), score: str = "jf_frame"
                           ) -> DataFrame:
    """Dense trace on the frames a strided run evaluated, next to that run's score."""
    hit = F.col("frame") % stride == 0
    m = trace.groupBy(*keys).agg(
        F.avg(F.when(hit, F.col(score))).alias("restricted"),
        F.avg(F.when(~hit, F.col(score))).alias("interior"), F.count_if(hit).alias("n_frames"))
    return m.join(reference.select(*keys, F.col("jf").alias("reference")), list(keys)).where(
        F.col("n_frames") > 0).withColumn("delta", F.col("restricted") - F.col("reference"))


def frame_diff(frames: DataFrame, keys: Sequence[str], arm: str, a: str, b: str,
               value: str = "jf_frame", threshold: float = 0.02) -> DataFrame:
    """Frames where two arms differ by more than the threshold, by one pivoting aggregation."""
    w = frames.where(F.col(arm).isin(a, b)).groupBy(*keys).agg(
        F.max(F.when(F.col(arm) == a, F.col(value))).alias("a"),
        F.max(F.when(F.col(arm) == b, F.col(value))).alias("b"))
    return w.withColumn("d", F.col("b") - F.col("a")).where(F.abs("d") > threshold)
