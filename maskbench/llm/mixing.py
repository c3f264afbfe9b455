"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import WORD, staged

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
CAP = 2
BUCKETS = 4096


def word_count(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, total: float = TOTAL, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) and other columns, with ``target`` added: shares by weight, none above ``cap`` times its size.

    Weights repeat over the sources in order, null last. Sources are filled in the order in which they
    reach their cap; the level at which the rest shares what is left is where the first one stays below it.
    One row per source goes in, so the windows without a key see few rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(x) for x in weights]),
                     ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", w).withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    over = Window.partitionBy()
    level = ((F.lit(total) * F.sum("source_size").over(over) - (F.sum("most").over(order) - F.col("most")))
             / (F.sum("weight").over(over) - (F.sum("weight").over(order) - F.col("weight"))))
    leveled = ranked.withColumn("level", level)
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))).over(over)
    common = F.min(F.when(F.col("most") / F.col("weight") >= F.col("free"), F.struct(
        F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(over)["level"]
    return (leveled.withColumn("free", free).withColumn("common", common)
            .select(*sources.columns, F.when(F.col("common").isNull() | (F.col("most") / F.col("weight") < F.col("free")),
                                                    F.col("most").cast("double"))
                    .otherwise(F.col("weight") * F.col("common")).alias("target")))


def draw(doc_id: str, text: str, seed: str) -> Column:
    """A number in (0, 1) fixed by seed, id and text."""
    key = F.concat(F.lit(seed + "|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text), F.lit("")))
    return (F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(281474976710656.0)


def length_score(size: Column, n_docs: Column, source_size: Column) -> Column:
    """size / (size + mean size of the source), in whole millionths."""
    x = size.cast("double") * n_docs.cast("double")
    return F.when(source_size > 0, F.floor(F.lit(1e6) * x / (x + source_size.cast("double")))).otherwise(0).cast("long")


def mix(docs: DataFrame, total: float = TOTAL, cap: int = CAP, weights: tuple[int, ...] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """Add how often each document enters the mix: columns size, source_size, target, copies.

    A source's rate is its target over its size. Every document gets the whole part of the rate as certain
    copies; the rest is a Pareto sample of unequal probabilities. With f the fraction of the rate, a document is to
    be included with f + (h - H) * min(f, 1 - f), where h = size / (size + mean size) and H is the mean of h over the
    source's words: longer documents are likelier, and the expected words are f times the source's size. Documents
    rank by their random odds over the odds of inclusion and enter in that order while the source's remaining
    words last. The last one enters if more than half of it fits, so a source misses its target by half a document at most.

    Only sums leave the tasks: words by source and bucket of the rank, then the rows of the one bucket where
    a source's cut lies. Each row compares itself with the cut, so texts are never shuffled and a source with
    most of the rows is spread. Rows with one source, id and text share a draw and enter together. Null text has
    size 0 and null source is a source of its own; other columns are kept, and input columns called size, source_size,
    target or copies are replaced; an empty table gives an empty result.
    """
    keep = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), "source", "doc_id", word_count("text").alias("size"),
                    draw("doc_id", "text", seed).alias("u"))
    slim = staged(d.groupBy("source", "doc_id", "u", "size").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.col("size")))
    sums = slim.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"))
    goals = staged(targets(sums, total, cap, weights))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor("rate")
    same = F.col("g_source").eqNullSafe(F.col("source"))
    score = length_score(F.col("size"), F.col("n_docs"), F.col("source_size"))
    goals = goals.withColumn("rate", rate).withColumn("part", F.col("rate") - whole).withColumnRenamed("source", "g_source")
    mean = slim.join(goals, same).where("source_size > 0").groupBy(F.col("g_source").alias("m_source"), "source_size").agg(
        F.sum((F.col("words") * score).cast("decimal(38,0)")).cast("double").alias("total"))
    mean = mean.select("m_source", (F.col("total") / F.col("source_size")).alias("mean"))
    side = staged(goals.join(mean, F.col("m_source").eqNullSafe(F.col("g_source")), "left").drop("m_source"))

    def keyed(x: DataFrame) -> DataFrame:
        u, f = F.col("u"), F.col("part")
        p = f + (score - F.col("mean")) / F.lit(1e6) * F.least(f, 1 - f)
        odds = F.when((f > 0) & (p > 0) & (p < 1), (u / (1 - u)) / (p / (1 - p)))
        return (x.withColumn("odds", odds)
                .withColumn("bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * BUCKETS)))

    k = keyed(slim.join(side, same)).where("odds is not null").select(
        "source", "doc_id", "words", "odds", "bucket", (F.col("part") * F.col("source_size")).alias("room"))
    sums = k.groupBy("source", "bucket", "room").agg(F.sum("words").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    cut = (sums.withColumn("upto", F.sum("words").over(w)).where("upto >= room")
           .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("c"))
           .select(F.col("source").alias("c_source"), "c.bucket", "c.before"))
    near = k.join(cut.withColumnRenamed("bucket", "c_bucket"), F.col("c_source").eqNullSafe(F.col("source"))
                  & (F.col("bucket") == F.col("c_bucket")))
    w = Window.partitionBy("source").orderBy("odds", F.col("doc_id").asc_nulls_first())
    inside = near.withColumn("middle", F.col("before") + F.sum("words").over(w) - F.col("words") / 2).where("middle <= room")
    last = inside.groupBy(F.col("source").alias("l_source")).agg(F.max(F.struct("odds", "doc_id")).alias("last"))
    plan = staged(side.join(cut.select("c_source", F.col("bucket").alias("c_bucket")), F.col("c_source").eqNullSafe(F.col("g_source")), "left")
                  .join(last, F.col("l_source").eqNullSafe(F.col("g_source")), "left").drop("c_source", "l_source"))
    row = F.struct("odds", "doc_id")
    enters = (F.col("odds").isNotNull() & (F.col("c_bucket").isNull() | (F.col("bucket") < F.col("c_bucket"))
              | ((F.col("bucket") == F.col("c_bucket")) & F.coalesce(row <= F.col("last"), F.lit(False)))))
    return keyed(d.join(plan, same)).select(
        *[F.col("_row").getField(c).alias(c) for c in keep], "size", "source_size", "target", (whole + enters.cast("long")).cast("int").alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for every copy that the mix takes."""
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).where("copies > 0").drop("_copy")
