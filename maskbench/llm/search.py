"""Ranked lexical search by K2-treaps over blocks of documents."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .base import bytes_of, parts_for, term_table

TERMS = term_table(digits=True)
#: Documents of one grid, terms of the queries that are handled at once, and ranges that are opened in one step.
GRID_DOCS = 4096
QUERY_BLOCK = 1 << 20
OPENED = 128
#: A missing document id sorts after all others.
NO_ID = np.iinfo(np.int64).max

#: Set bits of the numbers below 16.
BITS = np.array([bin(i).count("1") for i in range(16)], np.int32)


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Put a zero bit before every bit of numbers below 2^32."""
    x = x.astype(np.uint64)
    for shift in (16, 8, 4, 2, 1):
        mask = np.uint64(((1 << 64) - 1) // ((1 << shift) + 1))
        x = (x | (x << np.uint64(shift))) & mask
    return x


@dataclass
class Treap:
    """A compressed quadtree over (term row, document column); every cell knows the largest impact below it.

    Cells lie level by level in Z order, so the children of a cell are neighbours: ``first`` is the first
    one and ``mask`` tells which of the four quadrants exist. The last cell stands for every missing one.
    """
    height: int
    first: np.ndarray
    mask: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray) -> "Treap":
        height = max(1, int(max(rows.max(initial=0), columns.max(initial=0))).bit_length())
        code = (spread_bits(rows) << np.uint64(1)) | spread_bits(columns)
        order = np.argsort(code)
        code, value = code[order], impact[order]
        levels = [(np.zeros(len(code), np.int64), np.zeros(len(code), np.uint8), value)]
        for _ in range(height):
            parent = code >> np.uint64(2)
            start = np.flatnonzero(np.concatenate(([True], parent[1:] != parent[:-1])))
            mask = np.bitwise_or.reduceat(np.left_shift(np.uint8(1), (code & np.uint64(3)).astype(np.uint8)), start)
            value = np.maximum.reduceat(value, start)
            levels.append((start, mask, value))
            code = parent[start]
        levels.reverse()
        sizes = np.cumsum([len(x[0]) for x in levels])
        first = np.concatenate([x[0] + sizes[i] for i, x in enumerate(levels)] + [[sizes[-1]]]).astype(np.int32)
        return cls(height, first, np.concatenate([x[1] for x in levels] + [[0]]).astype(np.uint8),
                   np.concatenate([x[2] for x in levels] + [[0]]).astype(np.int64))

    def child(self, cell: np.ndarray, quadrant: np.ndarray) -> np.ndarray:
        mask = self.mask[cell].astype(np.int32)
        there = (mask >> quadrant) & 1
        return np.where(there == 1, self.first[cell] + BITS[mask & ((1 << quadrant) - 1)], len(self.mask) - 1)


def descend(treap: Treap, rows: np.ndarray, weights: np.ndarray, best: tuple[np.ndarray, np.ndarray], ids: np.ndarray,
            top: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` best of ``best`` (scores, ids) and of the grid's documents.

    One cell per term row is held for every open range of documents; their maxima bound the score of each document in
    it. The ranges with the largest bounds are opened first, some at a time, until none can reach the last score kept.
    A range of one document has its score as bound. A bound equal to that score is opened too, for the smaller id wins.
    """
    scores, kept = best
    cells, level = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64)
    column, bound = np.zeros(1, np.int64), (treap.most[cells] * weights).sum(1)
    row_bit = np.array([(rows >> (treap.height - 1 - i)) & 1 for i in range(treap.height)])
    while len(bound):
        least = max(1, scores[-1] if len(scores) >= top else 1)
        able = bound >= least
        if not able.all():
            cells, level, column, bound = cells[able], level[able], column[able], bound[able]
        if not len(bound):
            break
        if len(bound) > OPENED:
            pick = np.argpartition(bound, len(bound) - OPENED)
            now, later = pick[-OPENED:], pick[:-OPENED]
        else:
            now, later = np.arange(len(bound)), np.empty(0, np.int64)
        quadrant = row_bit[level[now]] * 2
        made = [treap.child(cells[now], quadrant + side) for side in (0, 1)]
        new_cells = np.concatenate(made)
        new_bound = (treap.most[new_cells] * weights).sum(1)
        new_level = np.concatenate([level[now] + 1] * 2)
        new_column = np.concatenate([column[now] * 2, column[now] * 2 + 1])
        able = new_bound >= least
        single = able & (new_level == treap.height)
        if single.any():
            scores = np.concatenate([scores, new_bound[single]])
            kept = np.concatenate([kept, ids[new_column[single]]])
            order = np.lexsort((kept, -scores))[:top]
            scores, kept = scores[order], kept[order]
        able &= ~single
        cells, level = np.concatenate([cells[later], new_cells[able]]), np.concatenate([level[later], new_level[able]])
        column, bound = np.concatenate([column[later], new_column[able]]), np.concatenate([bound[later], new_bound[able]])
    return scores, kept


def statistics(docs: DataFrame, words: dict[bytes, int]) -> tuple[int, int, dict[int, int]]:
    """Number of documents with terms, of all terms, and of documents by each of ``words``; at most a row per word leaves a task."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, holding = shared.value, [0, 0], Counter()
        for b in batches:
            for text in bytes_of(b.column(0)):
                found = text.translate(TERMS).split()
                n[0] += bool(found)
                n[1] += len(found)
                holding.update(known.keys() & set(found))
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *(known[w] for w in holding)], pa.int64()), pa.array([*n, *holding.values()], pa.int64())],
                                         names=["word", "n"])

    found = dict(docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n")).collect())
    return found.get(-1, 0), found.get(-2, 0), {k: v for k, v in found.items() if k >= 0}


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def searched(docs: DataFrame, items: list[tuple[int | None, bytes]], top: int) -> DataFrame:
    """(item, item_id, doc_id, score) of one block of queries: every task's best ``top`` of each."""
    found = [Counter(t.translate(TERMS).split()) for _, t in items]
    words = {w: i for i, w in enumerate(sorted(set().union(*found)))}
    n, length, df = statistics(docs, words)
    weights = {i: weight(n, d) for i, d in df.items()}
    wanted = []
    for c in found:
        rows = np.array([words[w] for w in c if words[w] in df], np.int64)
        wanted.append((rows, np.array([c[w] * weights[words[w]] for w in c if words[w] in df], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast((words, weights, wanted, [i for i, _ in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights, wanted, item_ids = shared.value
        best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in wanted]

        def search(grid: list[tuple[int, list[tuple[int, int]]]]) -> None:
            if not grid:
                return
            # documents with like sums of impacts lie side by side, which keeps the maxima of ranges close to them
            grid.sort(key=lambda d: sum(weights[w] * i for w, i in d[1]))
            size = [len(d[1]) for d in grid]
            rows, impact = (np.fromiter((x[k] for d in grid for x in d[1]), np.int64, sum(size)) for k in (0, 1))
            present = np.unique(rows)
            treap = Treap.of(np.searchsorted(present, rows), np.repeat(np.arange(len(grid)), size), impact)
            ids = np.array([d[0] for d in grid], np.int64)
            for k, (terms, w) in enumerate(wanted):
                here = np.isin(terms, present, assume_unique=True) & (w > 0)
                if here.any():
                    best[k] = descend(treap, np.searchsorted(present, terms[here]), w[here], best[k], ids, top)

        grid = []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), bytes_of(b.column(1))):
                c = Counter(text.translate(TERMS).split())
                hit = c.keys() & words.keys()
                if hit:
                    m = 100 - 25 + 25 * c.total() * n // length
                    grid.append((NO_ID if doc_id is None else doc_id, [(words[w], 1_000_000_000 * c[w] // (1000 * c[w] + 12 * m)) for w in hit]))
                if len(grid) == GRID_DOCS:
                    search(grid)
                    grid = []
        search(grid)
        for k, (scores, ids) in enumerate(best):
            if len(scores):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * len(ids), pa.int64()), pa.array([item_ids[k]] * len(ids), pa.int64()),
                     pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(scores, pa.int64())], names=["item", "item_id", "doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, top: int = 20, block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: every item's ``top`` best documents with a score above 0.

    Queries are handled in blocks of about ``block`` characters, each sent to all tasks, which bounds the broadcast; an item is
    never cut. One pass counts documents by query term; the next builds a K2-treap over each GRID_DOCS documents and the
    block's terms, and every item descends it. An item's best documents so far carry over from grid to grid of a task, so most later
    ranges are left closed. A task sends at most ``top`` rows per item; nothing else is shuffled.

    Every row of ``items`` is an item and every row of ``docs`` a document, repeated ids or not; ids are whole numbers, and a
    null document id ranks after others of its score. Null or empty texts have no terms and appear nowhere. Other columns are
    ignored; an empty table gives an empty result.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    q = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = parts_for(q.agg(F.sum(F.length("text"))).first()[0], block)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = []
    for i in range(blocks):
        rows = [(r[0], r[1].encode()) for r in q.where(part == i).collect()]
        if rows:
            rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            found.append(searched(d, rows, top).withColumn("block", F.lit(i)))
    if not found:
        return d.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return (reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= top)
            .select("item_id", "rank", "doc_id", "score"))
