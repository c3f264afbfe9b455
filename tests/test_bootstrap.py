"""Replicate vectors against a plain loop over replicates, with ties, hot values and many chunks."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from maskbench.operators import bootstrap, stats


def weight(seed, b, unit):
    digits = hashlib.md5(f"{seed}|{b // 8}|{unit}".encode()).hexdigest()[b % 8 * 4:b % 8 * 4 + 4]
    return sum(digits >= t for t in bootstrap.STEPS)


def ranks(v):
    return np.array([np.sum(v < a) + (np.sum(v == a) + 1) / 2 for a in v])


def plain(rows, n_boot, seed):
    """(key, b) to (n, rho) of rows (key, unit, x, y), every row repeated as often as its unit counts."""
    out = {}
    for key in {r[0] for r in rows}:
        for b in range(n_boot):
            d = [r for r in rows if r[0] == key for _ in range(weight(seed, b, r[1]))]
            if d:
                x, y = ranks(np.array([r[2] for r in d])), ranks(np.array([r[3] for r in d]))
                ok = len(d) >= 4 and x.std() > 0 and y.std() > 0
                out[key, b] = (len(d), np.corrcoef(x, y)[0, 1] if ok else None)
    return out


def rows_of(seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([0.0, 0.0, 1.0, round(rng.random(), 1), rng.random()])
    rows = [("a", f"u{rng.randrange(15)}", value(), value()) for _ in range(120)]
    rows += [("b", f"u{i}", float(i % 3), 1.0) for i in range(20)]
    return rows + [("c", "only", 1.0, 2.0), ("c", "only", 2.0, 1.0)] + rows[:10]


@pytest.mark.parametrize("chunk", [8, 16384])
def test_every_replicate_equals_the_plain_one(spark, monkeypatch, chunk):
    monkeypatch.setattr(bootstrap, "CHUNK_ROWS", chunk)
    rows, n_boot = rows_of(chunk), 30
    d = spark.createDataFrame(rows, "k string, unit string, x double, y double")
    got = {(r.k, r.b): (r.n, r.rho) for r in bootstrap.replicate_correlations(d, ["k"], ["unit"], "x", "y", n_boot, 5).collect() if r.n}
    want = plain(rows, n_boot, 5)
    assert got.keys() == want.keys()
    for at, (n, rho) in want.items():
        assert got[at][0] == n
        assert (got[at][1] is None) == (rho is None) and (rho is None or abs(got[at][1] - rho) < 1e-9)


def test_intervals_leave_out_missing_values_and_few_units(spark):
    rows = [(k, f"u{i}", float(i), float(i * 7 % 11)) for i in range(20) for k in ("many", "few") if k == "many" or i < 5]
    rows += [("many", "x", None, 1.0), ("many", "y", float("nan"), 1.0), (None, "u", 1.0, 1.0)]
    d = spark.createDataFrame(rows, "k string, unit string, x double, y double")
    found = bootstrap.unit_bootstrap_rho(d, ["k"], ["unit"], "x", "y", 300).collect()
    assert [r.k for r in found] == ["many"]
    rho = [v[1] for (_, _), v in plain([r for r in rows if r[0] == "many"][:20], 300, 0).items() if v[1] is not None]
    assert np.allclose([found[0].ci_lo, found[0].ci_hi], np.percentile(rho, [2.5, 97.5]))


def test_between_units_refuses_few_units(spark):
    rows = [(k, u, float(u), float(u * u + i)) for k, n in (("five", 5), ("four", 4)) for u in range(n) for i in range(3)]
    d = spark.createDataFrame(rows, "k string, unit long, x double, y double")
    found = stats.between_association(d, ["k"], ["unit"], "x", "y", n_perm=50).collect()
    assert [(r.k, r.n_units, round(r.rho, 9)) for r in found] == [("five", 5, 1.0)] and 0 < found[0].perm_p <= 1


def test_no_vectors_of_replicates_are_shuffled_between_rows(spark):
    """Rows meet as units and values: what a task sends on is one row per pair of slabs."""
    d = spark.createDataFrame(rows_of(1), "k string, unit string, x double, y double")
    sent = bootstrap.replicate_correlations(d, ["k"], ["unit"], "x", "y", 2000)
    assert "CoGroups" not in sent._jdf.queryExecution().executedPlan().toString()
    assert sent.count() == 3 * 2000


@pytest.mark.parametrize("few", [0, 512])
@pytest.mark.parametrize("rows_of_a_slab", [8, 1 << 18])
def test_every_path_and_slab_size_equals_the_plain_one(spark, monkeypatch, few, rows_of_a_slab):
    """Told value by value or tile by tile, with one slab or many, a hot value and a key whose narrow side is x."""
    for name, value in (("FEW_VALUES", few), ("FEW_ROWS", rows_of_a_slab), ("CHUNK_ROWS", rows_of_a_slab)):
        monkeypatch.setattr(bootstrap, name, value)
    rows, n_boot = rows_of(7), 30
    rows += [("x", f"u{i % 40}", float(i % 4), (i * 37 % 101) / 7) for i in range(90)]
    d = spark.createDataFrame(rows + [("x", "none", None, 1.0), ("x", "none", 1.0, float("nan"))], "k string, unit string, x double, y double")
    got = {(r.k, r.b): (r.n, r.rho) for r in bootstrap.replicate_correlations(d, ["k"], ["unit"], "x", "y", n_boot, 5).collect() if r.n}
    want = plain(rows, n_boot, 5)
    assert got.keys() == want.keys()
    for at, (n, rho) in want.items():
        assert got[at][0] == n and (got[at][1] is None) == (rho is None) and (rho is None or abs(got[at][1] - rho) < 1e-9)


def test_a_narrow_order_is_not_cut_into_tiles(spark, monkeypatch):
    """What is sent grows with the rows, not with rows times slabs of the other order."""
    def refused(*_):
        raise AssertionError("a key with few values in one order goes tile by tile")
    monkeypatch.setattr(bootstrap, "_correlations_by_slabs", refused)
    monkeypatch.setattr(bootstrap, "FEW_ROWS", 64)
    d = spark.range(2048).selectExpr("'k' AS k", "id AS unit", "double(id * 37 % 2039) AS x", "double(id % 5) AS y")
    assert bootstrap.replicate_correlations(d, ["k"], ["unit"], "x", "y", 16).count() == 16


def test_draws_are_those_of_hashlib():
    from maskbench.kernels.draws import Draws

    units = ["", "é|1", *["x" * n for n in range(0, 130, 3)], *[f"{i}|fog" for i in range(9000)]]
    for seed, k in ((0, 0), (7, 99), (-5, 249), (0, 1000)):
        digests = [hashlib.md5(f"{seed}|{k}|{u}".encode()).hexdigest() for u in units]
        want = [[sum(h[4 * j:4 * j + 4] >= t for t in bootstrap.STEPS) for h in digests] for j in range(8)]
        assert (Draws(pa.array(units), seed).block(k) == np.array(want)).all()


@pytest.mark.parametrize("whole", [0, 30, 1 << 18])
def test_rank_correlation_of_small_and_large_keys(spark, monkeypatch, whole):
    """Keys ranked by one task, in chunks, or some this way and some that; a NULL key has no row."""
    monkeypatch.setattr(bootstrap, "WHOLE_KEY", whole)
    rows = rows_of(3) + [(None, "u", 1.0, 2.0)] * 5 + [("b", "u", float("nan"), 1.0), ("b", "u", None, 1.0)]
    d = spark.createDataFrame(rows, "k string, unit string, x double, y double")
    got = {r.k: (r.n, r.rho) for r in bootstrap.rank_correlation(d, ["k"], "x", "y").collect()}
    for k in "abc":
        own = [(x, y) for key, _, x, y in rows_of(3) if key == k]
        x, y = (ranks(np.array(v)) for v in zip(*own))
        assert got[k][0] == len(own)
        assert got[k][1] is None if k != "a" else abs(got[k][1] - np.corrcoef(x, y)[0, 1]) < 1e-9
    assert got.keys() == set("abc")


def test_small_keys_are_shuffled_twice(spark):
    d = spark.range(100).selectExpr("id % 9 AS k", "double(id % 7) AS x", "double(id % 11) AS y")
    plan = bootstrap.rank_correlation(d, ["k"], "x", "y")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2
