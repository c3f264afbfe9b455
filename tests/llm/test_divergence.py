"""Source divergence against plain dictionaries, with shared, one-sided and absent terms."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from maskbench.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def plain(rows, least, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))
        groups.add((lang, source))
        count[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        whole = Counter()
        for g in groups:
            if g[0] == lang:
                whole.update(count[g])

        def p(c):
            d = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // d for t in kept}

        mine, all_ = p(count[lang, source]), p(whole)
        pair = [(sum(abs(mine[t] - other[t]) for t in kept), s) for g, s in groups if g == lang and s != source for other in [p(count[lang, s])]]
        term = [(mine[t] - all_[t], t) for t in kept if count[lang, source][t] and mine[t] > all_[t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def got(spark, rows, least=3, top=5, schema=SCHEMA):
    return sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, schema), least, top).collect()))


def corpus(seed):
    rng = random.Random(seed)
    words = [rng.choice("aBcdéÉñz") + rng.choice("xyzÜ") * rng.randint(1, 3) for _ in range(40)]
    rows = [(i, rng.choice(["en", "de"]), rng.choice(["s0"] * 6 + ["s1", "s2", "s3", None]), " 1-".join(rng.choices(words, k=rng.randint(0, 30))))
            for i in range(150)]
    rows += [(None, None, None, None), (7, "en", "only", None), (8, "en", "s1", ""), (9, "xx", "s0", "lonely words"), (9, "xx", "s0", "lonely words")]
    return rows + [(200, "en", "s0", "very long " * 20_000)]


def test_equals_plain_version(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == plain(rows, 3, 5)


def test_pieces_of_arrays_add_up(spark, monkeypatch):
    """With arrays cut into many pieces and tables sent on early nothing changes."""
    monkeypatch.setattr(divergence, "PIECE", 4)
    monkeypatch.setattr(divergence, "HELD", 10)
    rows = corpus(3)
    assert got(spark, rows) == plain(rows, 3, 5)


def test_ties_rank_by_bytes_and_nothing_kept(spark):
    rows = [(i, "en", s, "b a é") for i in range(3) for s in ("y", "x", "é")]
    assert got(spark, rows) == plain(rows, 3, 5)
    assert all(r[4] == 0 for r in got(spark, rows, least=100))
    assert len(got(spark, rows, least=100)) == 6


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    more = [r + (1, 2, 3) for r in corpus(4)[:60]]
    assert got(spark, more, schema=SCHEMA + ", value long, item long, rank int") == plain([r[:4] for r in more], 3, 5)


def test_shares_are_exact_where_doubles_are_not():
    counts = np.array([10**12, 3, 0])
    size, terms = 7 * 10**12 + 3, 1000
    assert divergence.shares(counts, size, terms).tolist() == [1 + 10**9 * (int(c) + 5) // (size + 5 * terms) for c in counts]
