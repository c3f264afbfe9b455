"""Byte and word models against a plain dictionary version, and edge rows."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from maskbench.llm import lm_scoring

ORDER = lm_scoring.ORDER


def plain(rows, held):
    words, ctx = Counter(), [defaultdict(dict) for _ in range(ORDER + 1)]
    for (d, t), h in zip(rows, held):
        if not h:
            words.update((t or "").encode().lower().split())
            words[None] += 1
            b = b"\xfe" * ORDER + (t or "").encode() + b"\xff"
            for i in range(ORDER, len(b)):
                x = ctx[ORDER][b[i - ORDER:i]]
                x[b[i]] = x.get(b[i], 0) + 1
    for k in range(ORDER - 1, -1, -1):
        for c, seen in ctx[k + 1].items():
            x = ctx[k][c[1:]]
            for s in seen:
                x[s] = x.get(s, 0) + 1
    step = lambda n: n if n < 4 else min(10, n.bit_length() + 1)
    chance = {}
    for k in range(ORDER + 1):
        new, of = Counter(), Counter()
        for seen in ctx[k].values():
            n, d, once = sum(seen.values()), len(seen), sum(v == 1 for v in seen.values())
            if n > 1:
                new[step(n - 1), step(d - 1)] += once
                of[step(n - 1), step(d - 1)] += once
                of[step(n - 1), step(d)] += n - once
        chance |= {(k, *c): max(1e-6, min(0.98, (new[c] + 0.5) / (of[c] + 1))) for c in of}

    def dist(before):
        """log10 of the probability of every symbol."""
        out, p, gone = {}, 0.0, set()
        for k in range(ORDER, -1, -1):
            seen = {s: v for s, v in ctx[k].get(before[ORDER - k:], {}).items() if s not in gone}
            if seen:
                n = sum(seen.values())
                e = chance.get((k, step(n), step(len(seen))), len(seen) / (n + len(seen)))
                out |= {s: p + math.log10((1 - e) * v / n) for s, v in seen.items()}
                p += math.log10(e)
                gone |= set(seen)
        return out | {s: p - math.log10(255 - len(gone)) for s in range(256) if s not in gone and s != 0xFE}

    total, kinds = sum(words.values()), len(words)
    res = []
    for (d, t), h in zip(rows, held):
        w = [*(t or "").encode().lower().split(), None]
        b = b"\xfe" * ORDER + (t or "").encode() + b"\xff"
        s = sum(dist(b[i - ORDER:i])[b[i]] for i in range(ORDER, len(b)))
        res.append((d, h, len(w), sum(words[x] > 0 for x in w), total, sum(math.log10((words[x] + 1) / (total + kinds + 1)) for x in w), s))
    return res, dist


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-9, abs_tol=1e-9)


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SLICE", 700)
    rng = random.Random(4)
    parts = ["the", "an", "er", "Ing", "é", "o", "st", "\n", "  "]
    rows = [(i, " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, None), (3, ""), (4, rows[4][1]), (70, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as block", "3 as `a.b`")
    want, dist = plain(rows, [(r[0] or 0) % 3 == 2 for r in rows])
    got = lm_scoring.score(docs, F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 2, block=2000).collect()
    same(got, want)
    for before in (b"\xfe" * ORDER, b" the"[-ORDER:], b"zzzz"):
        assert math.isclose(sum(10 ** p for p in dist(before).values()), 1.0, rel_tol=1e-9)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, F.lit(True)).collect()}
    assert got[1]["train_tokens"] == 0 and got[1]["n_known"] == 0 and math.isclose(got[1]["score"], -3 * math.log10(255))
    assert math.isclose(got[2]["base_score"], 0.0)
    assert lm_scoring.score(docs.where("false"), F.lit(False)).count() == 0
