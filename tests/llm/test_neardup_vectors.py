"""Cover trees against all pairs: clusters, copies, borderline and odd vectors."""

import numpy as np

from maskbench.llm import neardup_vectors as nv


def plain(ids, x, threshold=0.9):
    good = [i for i, v in enumerate(x) if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    s = np.zeros((len(good), len(good)), bool)
    for dim in {len(x[i]) for i in good}:
        at = np.array([k for k, i in enumerate(good) if len(x[i]) == dim])
        a = np.array([x[good[k]] for k in at], float)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        s[np.ix_(at, at)] = a @ a.T >= threshold
    np.fill_diagonal(s, False)
    label = list(range(len(x)))
    for _ in range(len(good)):
        old = list(label)
        for i, row in zip(good, s):
            for j in np.array(good)[row]:
                label[i] = label[j] = min(label[i], label[j])
        if old == label:
            break
    n = dict(zip(good, s.sum(1).tolist()))
    least = {}
    for i, l in enumerate(label):
        least[l] = min(least.get(l, ids[i]), ids[i])
    return sorted((ids[i], n.get(i, 0), least[label[i]], ids[i] == least[label[i]]) for i in range(len(x)))


def vectors():
    rng = np.random.default_rng(6)
    x = []
    for c in rng.normal(size=(25, 8)):
        for _ in range(rng.integers(1, 12)):
            x.append((c + rng.normal(size=8) * rng.choice([0.0, 0.05, 0.2, 0.35])).tolist())
    x += [(c * 10.0 ** float(e)).tolist() for c, e in zip(rng.normal(size=(4, 8)), (-200, 150, 0, 3))]
    x += [None, [0.0] * 8, [1.0] * 7, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7, [float("inf")] + [0.0] * 7, x[0], x[0]]
    return [1000 - i for i in range(len(x))], x


def test_against_all_pairs(spark):
    ids, x = vectors()
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "2 as n_links", "3 as `a.b`")
    for block in (4096, 20):
        got = sorted(map(tuple, nv.near_duplicates(df.repartition(4), block=block).collect()))
        assert got == plain(ids, x)


def test_lengths_and_a_hot_vector(spark):
    """Vectors of every length link with their like; copies by the hundred count each other and cost one node."""
    rng = np.random.default_rng(9)
    x = [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0, 1.0], [2.0, 2.0, 2.1], [-1.0, 0.0, 0.0], [], [0.0, -0.0], [3.0]] + [[0.0, 1.0, 2.0]] * 300
    x += [(np.array([0.0, 1.0, 2.0]) + rng.normal(size=3) * 0.6).tolist() for _ in range(60)] + [rng.normal(size=2).tolist() for _ in range(30)]
    x += [[-0.0, 1.0, 2.0]] * 5
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>")
    for block in (4096, 7):
        assert sorted(map(tuple, nv.near_duplicates(df, block=block).collect())) == plain(ids, x)


def test_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.1]), (4, [1.0, 0.1]), (None, [0.0, 1.0]), (None, None)], "vec_id int, embedding array<double>")
    got = sorted(map(tuple, nv.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 4, False), (None, 2, 4, False), (4, 2, 4, True), (None, 0, None, False), (None, 0, None, False)], key=repr)


def test_weights():
    """Links count the copies that a vector stands for, but not its own."""
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(1, 6)) + rng.normal(size=(40, 6)) * e for e in (0.02, 0.2, 1.0)])
    w = rng.integers(1, 9, len(x))
    s = nv._units(x) @ nv._units(x).T >= 0.9
    np.fill_diagonal(s, False)
    one = nv.Tree(x, *nv.cover_tree(nv._units(x)), w)
    n, m, _ = nv.traverse(one, one, True)
    assert (n + m == s @ w).all()


def test_traversal_alone(monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(6, 16))
    x = np.concatenate([base[rng.integers(0, 6, 300)] + rng.normal(size=(300, 16)) * 0.18, rng.normal(size=(50, 16))])
    u = nv._units(x)
    trees = [nv.Tree(p, *nv.cover_tree(nv._units(p))) for p in (x[:200], x[200:])]
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    n, m, edges = nv.traverse(trees[0], trees[1], False)
    assert (n == s[:200, 200:].sum(1)).all() and (m == s[200:, :200].sum(1)).all()
    assert all(s[i, j + 200] for e in edges for i, j in e)
    one = nv.Tree(x, *nv.cover_tree(u))
    n, m, _ = nv.traverse(one, one, True)
    assert (n + m == s.sum(1)).all()


def test_nested_radii():
    u = nv._units(np.random.default_rng(3).normal(size=(200, 3)))
    node, radius = nv.cover_tree(u)
    for k, reach in enumerate(nv.RADII):
        assert (nv._gap(u, u)[np.arange(200), node[:, k]] <= radius[:, k] + 1e-7).all() and (radius[:, k] <= reach).all()
        if k:
            assert set(node[:, k - 1]) <= set(node[:, k])


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nv.near_duplicates(df).count() == 0
    one = spark.createDataFrame([(5, None), (6, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, nv.near_duplicates(one).collect())) == [(5, 0, 5, True), (6, 0, 6, True)]
