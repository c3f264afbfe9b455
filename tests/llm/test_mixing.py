"""Mixing: targets by weight under caps, words near the targets, edge rows."""

from maskbench.llm import mixing


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def plain_targets(sizes, total=1.5, cap=2, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    goal, fixed = total * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        weight = sum(w[s] for s in free)
        share = {s: (goal - sum(fixed.values())) * w[s] / weight for s in free} if free else {}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_targets_and_words(spark):
    rows = [(i, None if i % 7 == 0 else f"s{i % 5}", "w " * (i % 13 + 1) * (40 if i % 5 == 1 else 1)) for i in range(700)]
    got = mixing.mix(docs_of(spark, rows)).toPandas()
    sizes = {None if s != s or s is None else s: int(g["size"].sum()) for s, g in got.groupby("source", dropna=False)}
    want = plain_targets(sizes)
    for s, g in got.groupby("source", dropna=False):
        key = None if s != s or s is None else s
        assert abs(g.target.iloc[0] - want[key]) < 1e-6 and g.source_size.iloc[0] == sizes[key]
        assert abs((g.copies * g["size"]).sum() - want[key]) <= g["size"].max() / 2 + 1e-6
    assert set(got.copies) <= {0, 1, 2} and len(got) == len(rows)
    again = mixing.mix(docs_of(spark, rows[::-1]).repartition(5)).toPandas()
    a, b = (x.sort_values("doc_id").copies.tolist() for x in (got, again))
    assert a == b


def test_edges(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    rows = [(None, None, None), (1, "a", ""), (1, "a", "x y"), (1, "a", "x y"), (2, "b", " \t\n"), (3, "b", "é z q")]
    got = mixing.mix(docs_of(spark, rows).selectExpr("*", "5 as size", "6 as copies", "1 as `a.b`", "7 as odds", "8 as rate", "9 as u"))
    assert got.columns == ["doc_id", "source", "text", "a.b", "odds", "rate", "u", "size", "source_size", "target", "copies"]
    out = got.toPandas()
    assert len(out) == 6 and out["size"].sum() == 6
    assert set(out["a.b"]) == {1} and set(out.odds) == {7} and set(out.rate) == {8} and set(out.u) == {9}
    assert mixing.repeated(got).count() == int(out.copies.sum())


def test_inclusion_is_unequal_and_calibrated(spark):
    """Over many seeds a document enters as often as its probability says; without ids every text has its own draw."""
    sizes = [(i * 37) % 50 + 1 for i in range(120)]
    docs = docs_of(spark, [(None, "a", f"t{i} " + "w " * (n - 1)) for i, n in enumerate(sizes)]).cache()
    seeds, taken = 12, [0] * 120
    for seed in range(seeds):
        for r in mixing.mix(docs, total=0.3, seed=str(seed)).select("text", "copies").collect():
            taken[int(r.text.split()[0][1:])] += r.copies
    mean = sum(sizes) / 120
    h = [n / (n + mean) for n in sizes]
    top = sum(a * b for a, b in zip(h, sizes)) / sum(sizes)
    want = [0.3 + (x - top) * 0.3 for x in h]
    short, long = ([i for i, n in enumerate(sizes) if keep(n)] for keep in (lambda n: n <= 12, lambda n: n >= 38))
    for group in (short, long):
        got, p = sum(taken[i] for i in group) / seeds / len(group), sum(want[i] for i in group) / len(group)
        assert abs(got - p) < 4 * (p * (1 - p) / seeds / len(group)) ** 0.5
    assert sum(taken[i] for i in long) / len(long) > 1.3 * sum(taken[i] for i in short) / len(short)
