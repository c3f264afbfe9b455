"""How far the sources of a language lie apart: exact term shares, merged pair by pair."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .base import bytes_of, parts_for, staged, term_table

TERMS = term_table(digits=False)
#: A term's share is 1 + floor(UNIT * (count + PRIOR) / (all + PRIOR * terms)).
UNIT = 1_000_000_000
PRIOR = 5
#: Entries of a task's tables before they are sent on, and terms in one piece of a group's array.
HELD = 400_000
PIECE = 1 << 14


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows that hold the term, summed within parts of a task.

    Every group also gets a row with an empty term and zeros, so that groups without terms are known.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held = {}, 0

        def rows() -> pa.RecordBatch:
            keys, cols = [], ([], [], [])
            for (lang, source), (n, docs_with) in table.items():
                keys += [(lang, source)] * (len(n) + 1)
                cols[0].extend((b"", *n))
                cols[1].extend((0, *n.values()))
                cols[2].extend((0, *(docs_with[t] for t in n)))
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array(cols[0], pa.binary()).cast(pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), bytes_of(b.column(2))):
                n, docs_with = table.setdefault((lang, source), (Counter(), Counter()))
                words = text.translate(TERMS).split()
                before = len(n)
                n.update(words)
                docs_with.update(set(words))
                held += len(n) - before
                if held > HELD:
                    yield rows()
                    table, held = {}, 0
        yield rows()

    kept = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return kept.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def share(count: Column, size: Column, terms: Column) -> Column:
    """The share of a term in whole numbers, by long division in steps of a thousand that do not overflow."""
    div = lambda a, b: F.call_function("div", a, b)
    d = F.when(size + PRIOR * terms > 0, size + PRIOR * terms)
    out, rest = F.lit(1).cast("long"), count + PRIOR
    parts = []
    for _ in range(3):
        rest = rest * 1000
        parts.append(div(rest, d))
        rest = rest % d
    return out + parts[0] * 1_000_000 + parts[1] * 1000 + parts[2]


def shares(count: np.ndarray, size: int, terms: int) -> np.ndarray:
    """The same for an array."""
    d, out, rest = size + PRIOR * terms, np.zeros(len(count), np.int64), count.astype(np.int64) + PRIOR
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest = rest % d
    return out + 1


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sizes: tuple[int, int], terms: int) -> tuple[int, int]:
    """Sum of differences over the terms that a piece of either group holds, and their number.

    The shorter array's ids gallop through the longer one; what is met is priced by both counts,
    what is only on one side against the other group's share of a term that it lacks.
    """
    if len(a[0]) > len(b[0]):
        a, b, sizes = b, a, sizes[::-1]
    zero = np.zeros(1, np.int64)
    pa_, pb = shares(a[1], sizes[0], terms), shares(b[1], sizes[1], terms)
    none_a, none_b = shares(zero, sizes[0], terms)[0], shares(zero, sizes[1], terms)[0]
    at = np.searchsorted(b[0], a[0])
    met = at < len(b[0])
    met[met] = b[0][at[met]] == a[0][met]
    both = at[met]
    alone = np.ones(len(b[0]), bool)
    alone[both] = False
    value = (np.abs(pa_[met] - pb[both]).sum() + np.abs(pa_[~met] - none_b).sum() + np.abs(pb[alone] - none_a).sum())
    return int(value), len(a[0]) + int(alone.sum())


def priced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pair task a row: a piece of either group's array, one of which may be missing."""
    def array(column: pa.Array, i: int, kind: type) -> np.ndarray:
        v = column[i].values
        return np.empty(0, kind) if v is None else v.to_numpy(zero_copy_only=False)

    for b in batches:
        c = {n: b.column(n) for n in b.schema.names}
        size_a, size_b, terms = (c[n].to_pylist() for n in ("size_a", "size_b", "terms"))
        out = [merged((array(c["ids_a"], i, np.int32), array(c["counts_a"], i, np.int64)), (array(c["ids_b"], i, np.int32), array(c["counts_b"], i, np.int64)),
                      (size_a[i], size_b[i]), terms[i]) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([c["lang"], c["a"], c["b"], pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())],
                                         names=["lang", "a", "b", "value", "seen"])


def audit(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of every group of a language and source.

    Part ``pair`` compares a group with every other source of its language: the sum over the language's terms
    (those in at least ``least`` of its rows) of the difference of their shares. Part ``term`` lists the ``top``
    terms whose share in the group lies most above that in the language.

    A group's sparse array of (term id, count) is cut into pieces of about PIECE terms by the term's hash; ids number
    a piece's terms. Each unordered pair's task co-groups the two arrays of a piece (an outer
    join on pair and piece); terms that neither holds are counted, not listed. Before that only sums by group and term are shuffled, so a source with most of the rows costs no task more than its terms.

    Null text, lang and source are ''; repeated rows are rows of their own; other columns are ignored; an empty table gives
    an empty result. Long texts are whole. Equal values rank by the item's UTF-8 bytes.
    """
    cells = staged(counted(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    words = staged(cells.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
                   .where(F.col("docs") >= least).drop("docs"))
    pieces = parts_for(words.count(), PIECE)
    piece = F.pmod(F.xxhash64("term"), F.lit(pieces)).cast("int")
    numbered = words.withColumn("piece", piece).withColumn("id", F.row_number().over(Window.partitionBy("lang", "piece").orderBy("term")))
    kept = staged(cells.where("term <> ''").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))
    groups = staged(cells.select("lang", "source").distinct()
                    .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left")
                    .join(words.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("whole")), "lang", "left")
                    .na.fill(0, ["size", "terms", "whole"]))

    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    p, q = share(F.col("n"), F.col("size"), F.col("terms")), share(F.col("total"), F.col("whole"), F.col("terms"))
    term = (kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
            .where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))

    arrays = staged(kept.groupBy("lang", "source", "piece").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("cells"))
                    .select("lang", "source", "piece", F.col("cells.id").alias("ids"), F.col("cells.n").alias("counts")))
    a = groups.select("lang", F.col("source").alias("a"), F.col("size").alias("size_a"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("size").alias("size_b"))
    pairs = staged(a.join(b, "lang").where("a < b"))
    key = ["lang", "a", "b", "piece"]
    left, right = (arrays.select("lang", F.col("source").alias(g), "piece", F.col("ids").alias(f"ids_{g}"), F.col("counts").alias(f"counts_{g}"))
                   .join(pairs.select("lang", "a", "b"), ["lang", g]) for g in ("a", "b"))
    tasks = left.join(right, key, "full_outer").join(pairs, ["lang", "a", "b"])
    sums = (tasks.select("lang", "a", "b", "size_a", "size_b", "terms", "ids_a", "counts_a", "ids_b", "counts_b")
            .mapInArrow(priced, "lang string, a string, b string, value bigint, seen bigint")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")))
    none = F.abs(share(F.lit(0), F.col("size_a"), F.col("terms")) - share(F.lit(0), F.col("size_b"), F.col("terms")))
    whole = pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce("value", F.lit(0)) + F.coalesce((F.col("terms") - F.coalesce("seen", F.lit(0))) * none, F.lit(0))).alias("value"))
    both = whole.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                                                           F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"))
    pair = both.select("lang", "x.source", "x.item", "value").withColumn("rank", F.row_number().over(order))
    columns = lambda d, part: d.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pair, "pair").unionByName(columns(term, "term"))
