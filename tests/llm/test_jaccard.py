"""Jaccard join against all pairs on a small corpus with chains, copies and shared passages."""

import random

import numpy as np

from maskbench.llm import jaccard
from maskbench.llm.base import components, shingles


def plain(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    p = list(range(len(rows)))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                k = len(sets[i] & sets[j])
                if 100 * k >= 75 * (len(sets[i]) + len(sets[j]) - k):
                    a, b = find(i), find(j)
                    p[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted((-1 if d is None else d, len(sets[i]), -1 if least.get(find(i)) is None else least[find(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed, n=150):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    passage = " ".join(word() for _ in range(60))
    rows, base = [], [[word() for _ in range(rng.randint(1, 120))] for _ in range(12)]
    for i in range(n):
        b = list(rng.choice(base))
        kind = rng.randint(0, 4)
        if kind == 0:
            for _ in range(rng.randint(0, 6)):
                b[rng.randrange(len(b))] = word()
        elif kind == 1:
            b = b[:rng.randint(1, len(b))]
        elif kind == 2:
            b = [word() for _ in range(rng.randint(0, 40))] + passage.split()
        elif kind == 3:
            b = b + [word() for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(b)))
    return rows


def test_groups_equal_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).fillna(-1).collect()
        assert sorted(map(tuple, got)) == plain(rows)


def test_edges(spark):
    rows = [(None, "a b c"), (5, "A  B\tc"), (6, ""), (7, None), (8, " \n"), (None, None), (9, "one"), (9, "one"), (3, "two"), (10, "x " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as n", "3 as `a.b`")
    got = sorted(map(tuple, jaccard.near_groups(docs).fillna(-1).collect()))
    assert got == plain([(d, t) for d, t in rows]) or got == sorted(
        (-1 if d is None else d, n, c) for d, n, c in [(None, 1, 5), (5, 1, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (None, 0, -1), (9, 1, 9), (9, 1, 9), (3, 1, 3), (10, 1, 10)])
    assert jaccard.near_groups(docs.where("false")).count() == 0


def test_tiles_find_what_the_first_pairs_miss(spark, monkeypatch):
    """Without the first guesses the tiles alone give the same groups, also when cut small."""
    rows = corpus(3, 80)
    monkeypatch.setattr(jaccard, "TILE", 4)
    calls = []
    real = jaccard._verified

    def verified(pairs, *more):
        calls.append(1)
        return real(pairs.where("false") if len(calls) < 3 else pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", verified)
    got = jaccard.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(calls) == 3 and sorted(map(tuple, got)) == plain(rows)


def test_bound_is_never_below_the_overlap():
    rng = random.Random(5)
    for _ in range(200):
        a, b = (shingles(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))) for _ in range(2))
        u, v = jaccard.bitmap(a), jaccard.bitmap(b)
        w = min(len(u), len(v))
        assert jaccard.overlap_bound(jaccard.folded(u, w), len(a), jaccard.folded(v, w), len(b)) >= len(np.intersect1d(a, b))


def test_components_of_chains(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61))
    p = {x: x for e in edges for x in e}
    for _ in p:
        for a, b in edges:
            p[a] = p[b] = min(p[a], p[b])
    assert all(got.get(x, x) == c for x, c in p.items())


def plain_links(rows):
    """For every row, with how many other rows it links."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    link = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
    return [sum(bool(link(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def test_all_links_of_a_large_group(spark, monkeypatch):
    """Every link counts, also between sets that a chain has joined already, with copies and small squares."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    rng, rows = random.Random(6), corpus(4, 60)
    base = rows[0][1].split() + ["w%d" % i for i in range(60)]
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = f"x{i}"
        rows.append((1000 + i, " ".join(t)))
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1]), (3000, ""), (3001, None)]
    got = jaccard.near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_links for r in got} == dict(zip((d for d, _ in rows), plain_links(rows))) and len(got) == len(rows)
    assert max(r.n_links for r in got) > 40
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain(rows)


def test_a_large_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Candidates go with the number of sets, not with its square, and still every link is counted."""
    rng, rows = random.Random(8), []
    for i in range(90):
        t = ["w%d" % k for k in range(80)]
        t[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(t)))
    compared, real = [], jaccard._verified

    def verified(pairs, *more):
        pairs = jaccard.staged(pairs)
        compared.append(pairs.count())
        return real(pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", verified)
    got = jaccard.near_links(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.n_links for r in got} == dict(zip((d for d, _ in rows), plain_links(rows)))
    assert sum(r.n_links for r in got) > 40 * len(rows) and sum(compared) < 8 * len(rows)
