"""Quality classifier: held-out accuracy, held-out labels unread, edge rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from maskbench.llm import quality


def corpus(n=400):
    rng = np.random.default_rng(1)
    words = ["ma", "lo", "tiri", "sen", "dopa", "ku", "vira", "nesto"]
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(words, rng.integers(5, 60)))
        bad = i % 4 == 0
        kind = i % 3
        if bad:
            t = t.upper().replace(" ", "!! ") if kind == 0 else " | ".join(t.split()) if kind == 1 else " ".join([t.split()[0]] * 40)
        rows.append((i, t, int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).toPandas().set_index("doc_id")
    truth = {r[0]: r[2] for r in rows}
    held = got[got.held_out]
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got.held_out.items())
    assert np.mean([truth[i] == p for i, p in held.predicted.items()]) > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.3).astype(int) == got.predicted).all()
    # labels of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.classify(docs.repartition(3), turned).toPandas().set_index("doc_id")
    assert (again.score.sort_index() == got.score.sort_index()).all()


def test_edges(spark):
    rows = [(None, None, "x"), (1, "", "y"), (2, "a b c", None), (2, "a b c", None), (3, "word " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").withColumn("a.b", F.lit(1))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.classify(docs, none)
    assert got.columns == ["doc_id", "text", "a.b", "score", "held_out", "predicted"]
    assert [r["score"] for r in got.collect()] == [0.5] * 5
    odd = spark.createDataFrame([(2, 1), (2, None), (None, 1), (3, 7)], "doc_id long, quality int")
    assert quality.classify(docs, odd).count() == 5
    assert quality.classify(docs.where("false"), odd).count() == 0


def test_fit_is_the_optimum_of_the_definition(monkeypatch):
    """Log-count ratios from plain dictionaries, and the objective and margins of a plain solver.

    The descent reaches the optimum if it may go on; the rounds of the queries come within a fifth of it.
    """
    rows = [(set(quality.indicators(t, 12).tolist()), bool(q)) for _, t, q in corpus(90)]
    codes = [np.array(sorted(s), np.uint32) for s, _ in rows]
    good = np.array([q for _, q in rows])
    short = quality.fit_model(codes, good, np.ones(len(rows)), 12)
    monkeypatch.setattr(quality, "ROUNDS", 2000)
    m = quality.fit_model(codes, good, np.ones(len(rows)), 12)
    ratio, w = m.weights
    counts = {q: {} for q in (True, False)}
    for s, q in rows:
        for c in s:
            counts[q][c] = counts[q].get(c, 0) + 1
    size = {q: sum(g == q for _, g in rows) for q in (True, False)}
    for c in set().union(*(s for s, _ in rows)):
        want = np.log((counts[True].get(c, 0) + 1) / (size[True] + 2)) - np.log((counts[False].get(c, 0) + 1) / (size[False] + 2))
        assert abs(ratio[c] - want) < 1e-12
    x = np.zeros((len(rows), (1 << 12) + 1))
    for i, r in enumerate(codes):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, -1] = 1.0                                           # the bias is a weight like the others
    y, full = np.where(good, 1.0, -1.0), np.append(w, m.bias)
    cost = np.where(good, 1.0, good.sum() / (~good).sum())

    def objective(v):
        return v @ v / 2 + cost @ np.maximum(0, 1 - y * (x @ v))

    # a plain solver: projected gradient on the dual, far past convergence
    gram = (x * y[:, None]) @ (x * y[:, None]).T
    alpha, pace = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - pace * (gram @ alpha - 1), 0, cost)
    best = objective((alpha * y) @ x)
    assert abs(alpha.sum() - alpha @ gram @ alpha / 2 - best) < 1e-3 * best
    assert best - 1e-6 <= objective(full) <= best * 1.01
    assert objective(np.append(short.weights[1], short.bias)) <= best * 1.2
    margin, plain = y * (x @ full), y * (x @ ((alpha * y) @ x))
    assert np.abs(margin - plain).max() < 0.15


def test_score_at_the_bound(spark):
    """A score of exactly the bound counts as good."""
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int"), keep_above=0.5).first()
    assert got.score == 0.5 and got.predicted == 1
