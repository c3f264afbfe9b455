"""Ranked search against scores of all documents, and the treap's bounds against its cells."""

import math
import random
import re
from collections import Counter

import numpy as np

from maskbench.llm import search

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def plain(docs, items, top=20):
    bags = [(d, Counter(words(t))) for d, t in docs]
    n, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for d, b in bags:
            if b:
                m = 75 + 25 * b.total() * n // length
                s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t in words(text) if b[t])
                if s > 0:
                    found.append((-s, d is None, d or 0, d))
        found.sort(key=lambda x: x[:3])
        out += [(item, i + 1, f[3], -f[0]) for i, f in enumerate(found[:top])]
    return sorted(out, key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdÉé5") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    text = lambda k: " ".join(vocabulary[min(59, int(rng.expovariate(0.08)))] for _ in range(k))
    docs = [(i, text(rng.randint(0, 40))) for i in range(n)]
    docs += [(i, docs[i][1]) for i in range(0, 30, 3)] + [(n, None), (n + 1, ""), (None, docs[5][1]), (n + 2, text(30_000))]
    return docs, [(i, text(rng.randint(1, 25))) for i in range(15)] + [(90, None), (91, "zzz"), (None, "a b"), (3, "ab c c")]


def got(spark, docs, items, **more):
    return sorted(map(tuple, search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more).collect()), key=str)


def test_equals_scores_of_all(spark, monkeypatch):
    for seed, grid, opened in ((1, 4096, 128), (2, 16, 2)):
        monkeypatch.setattr(search, "GRID_DOCS", grid)
        monkeypatch.setattr(search, "OPENED", opened)
        docs, items = corpus(seed)
        assert got(spark, docs, items) == plain(docs, items)


def test_blocks_of_queries_change_nothing(spark):
    docs, items = corpus(3)
    assert got(spark, docs, items, block=100) == plain(docs, items)
    assert got(spark, docs, items, top=3) == plain(docs, items, 3)


def test_ties_take_the_smaller_ids(spark):
    docs = [(i, "same words here") for i in range(99, -1, -1)] + [(200, "other text")]
    rows = got(spark, docs, [(1, "same")])
    assert [r[2] for r in sorted(rows, key=lambda r: r[1])] == list(range(20))


def test_empty_tables_and_other_columns(spark):
    docs, items = corpus(4, 40)
    assert got(spark, [], items) == [] == got(spark, docs, [])
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], DOCS + ", score long, item long")
    q = spark.createDataFrame([(*r, 1, 2) for r in items], ITEMS + ", rank int, doc_id long")
    assert sorted(map(tuple, search.search(d, q).collect()), key=str) == plain(docs, items)


def test_cells_hold_the_maximum_below_them():
    rng = np.random.default_rng(0)
    grid = np.zeros((40, 70), np.int64)
    at = rng.choice(2800, 300, replace=False)
    grid.flat[at] = rng.integers(1, 1000, 300)
    rows, columns = np.nonzero(grid)
    t = search.Treap.of(rows, columns, grid[rows, columns])
    full = np.zeros((128, 128), np.int64)
    full[:40, :70] = grid
    for r in range(40):
        for c in range(70):
            cell = np.zeros(1, np.int64)
            for level in range(t.height):
                side = 128 >> level
                block = full[r // side * side:(r // side + 1) * side, c // side * side:(c // side + 1) * side]
                assert t.most[cell[0]] == block.max()
                shift = t.height - 1 - level
                cell = t.child(cell, np.array([(r >> shift & 1) * 2 + (c >> shift & 1)]))
            assert t.most[cell[0]] == grid[r, c]
