"""Removal of lines that many documents share, with levelled sorted runs of line hashes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .base import split_by_ids, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Batches of documents, and runs of one level that are compacted into one of the next.
BATCHES = 8
FANOUT = 4
#: A key in more documents than HEAVY is met in SALTS parts.
HEAVY = 10_000
SALTS = 64


def lines_of(text: Column) -> Column:
    """Lines of a text; null and empty text are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def lower_ascii(text: Column) -> Column:
    """Only A-Z lower-cased; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def row_key() -> Column:
    """A row's code by id and text; rows equal in both share it."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def keys_of(text: Column, least_chars: int) -> Column:
    """Sorted (hash, pos, first) of a text's keys of at least ``least_chars``; ``first`` marks one place of each key."""
    bare = F.transform(lines_of(lower_ascii(text)), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    hashed = F.transform(bare, lambda x, i: F.struct(F.when(F.length(x) >= least_chars, F.xxhash64(x)).alias("hash"), i.alias("pos")))
    ordered = F.sort_array(F.filter(hashed, lambda x: x["hash"].isNotNull()))
    before = lambda x: F.concat(F.array(F.get(x, F.lit(-1))), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))
    return let(ordered, lambda x: F.zip_with(x, before(x), lambda y, z: F.struct(
        y["hash"].alias("hash"), y["pos"].alias("pos"), F.coalesce(y["hash"] != z["hash"], F.lit(True)).alias("first"))))


def long_lines(docs: DataFrame, cuts: list[int], least_chars: int) -> DataFrame:
    """(batch, row, doc_id, hash, pos, first) of all rows' keys.

    Batches fall by id, so the first batch that has a key also has the largest id; null ids come last.
    """
    batch = reduce(lambda a, b: a + b, [F.coalesce(F.col("doc_id") < c, F.lit(True)).cast("int") for c in cuts], F.lit(0))
    return docs.select(batch.alias("batch"), row_key().alias("row"), "doc_id", F.inline(keys_of(F.col("text"), least_chars)))


class Runs:
    """Levels of runs (hash, docs, keeper), each sorted by hash.

    ``add`` takes a batch of smaller ids than all before: what the settled runs hold already is left out by a merge
    anti-join, the rest becomes a run of level 0. When a level has FANOUT runs, they are merged into one of the next level,
    and keys that have reached ``least_docs`` documents move to the settled runs. A key may be in several runs; their sum counts.
    """

    def __init__(self, least_docs: int, fanout: int = FANOUT) -> None:
        self.least, self.fanout, self.levels, self.settled = least_docs, fanout, [[]], []

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        both = reduce(DataFrame.unionByName, runs)
        return both.groupBy("hash").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"))

    @staticmethod
    def written(d: DataFrame) -> DataFrame:
        return staged(d.sortWithinPartitions("hash"))

    def add(self, batch: DataFrame) -> None:
        new = batch.groupBy("hash").agg(F.count_if("first").alias("docs"), F.max("doc_id").alias("keeper"))
        for run in self.settled:
            new = new.join(run.select("hash").hint("merge"), "hash", "left_anti")
        self.levels[0].append(self.written(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self.compact(level)
            level += 1

    def compact(self, level: int) -> None:
        whole = self.written(self.merged(self.levels[level]))
        if len(self.levels) == level + 1:
            self.levels.append([])
        self.levels[level] = []
        self.levels[level + 1].append(whole.where(F.col("docs") < self.least))
        self.settled.append(whole.where(F.col("docs") >= self.least))

    def frequent(self) -> DataFrame:
        """Keys in at least ``least_docs`` documents, and the largest id that has them."""
        runs = [r for level in self.levels for r in level] + self.settled
        return self.merged(runs).where(F.col("docs") >= self.least)


def met(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, pos) of lines whose key is frequent and whose row is not the one that keeps it.

    A filter of hashes spares most other lines the shuffle; keys in more than HEAVY documents are met in SALTS parts, on
    both sides by the same filter.
    """
    heavy = frequent.where(F.col("docs") > HEAVY).select("hash")
    known = split_by_ids(lines, frequent.select("hash"), "hash").where("possible").drop("possible")
    salt = F.when(F.col("possible"), F.pmod("row", F.lit(SALTS))).otherwise(0).alias("salt")
    salts = F.explode(F.when(F.col("possible"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    left = split_by_ids(known, heavy, "hash").select("row", "doc_id", "pos", "hash", salt.cast("int").alias("salt"))
    right = split_by_ids(frequent.select("hash", "keeper"), heavy, "hash").select("hash", "keeper", salts)
    return left.join(right, ["hash", "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).select("row", "pos")


def strip_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, batches: int = BATCHES) -> DataFrame:
    """Add n_lines, n_dropped and ``kept``, the text without lines that at least ``least_docs`` documents share.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys shorter than ``least_chars`` code points are
    left alone. The largest doc_id that has a frequent key keeps all its lines of that key. Keys are told apart by 64-bit hashes.

    Lines are hashed once and written by batch of ids; batches enter the runs one after the other (``Runs``). Then lines
    meet the frequent keys, and only rows that lose lines, found by a filter of bounded size, are shuffled with their text.

    Every row counts as a document. Null ids are smaller than all others; rows that share the largest id all keep the line. Null and
    empty texts are one empty line. Input columns called n_lines, n_dropped or kept are replaced, others stay; an empty table
    gives an empty result. ``doc_id`` is a whole number.
    """
    own = ("n_lines", "n_dropped", "kept")
    d = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).withColumn("doc_id", F.col("doc_id").cast("long"))
    steps = [i / batches for i in range(1, batches)]
    cuts = (d.agg(F.percentile_approx("doc_id", steps, 1000)).first()[0] if steps else None) or []
    lines = staged(long_lines(d, cuts, least_chars), "batch")
    runs = Runs(least_docs)
    for i in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == i))
    frequent = staged(runs.frequent())
    drops = staged(met(lines, frequent).groupBy("row").agg(F.sort_array(F.collect_set("pos")).alias("_drops")))

    marked = split_by_ids(d.withColumn("_row", row_key()), drops.select(F.col("row").alias("_row")), "_row")
    n = F.size(lines_of(F.col("text"))).cast("long").alias("n_lines")
    keep = [F.col(f"`{c}`") for c in d.columns]
    whole = marked.where(~F.col("possible")).select(*keep, n, F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("kept"))

    def rest(x: Column) -> Column:
        k, at = F.size(x["drops"]), x["drops"]
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(at, i - 1) + 1)
        end = lambda i: F.when(i == k, F.size(x["lines"])).otherwise(F.get(at, i))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), k), lambda i: F.slice(x["lines"], start(i) + 1, end(i) - start(i)))), "\n")

    # a row's array is cut between the dropped places, so its work is linear in its lines
    part = marked.where("possible").join(drops.withColumnRenamed("row", "_row").hint("merge"), "_row", "left")
    kept = F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        let(F.struct(lines_of(F.col("text")).alias("lines"), F.col("_drops").alias("drops")), rest))
    cut = part.select(*keep, n, F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
    return whole.unionByName(cut.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long"))))
