"""Chunked order operations against pandas, with a key that owns most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskbench.functions.ordered import (hash_chunk, number_chunk, ordinal, quantiles, rank_table,
                                         running, value_chunk)
from maskbench.functions.keys import hash32, level_label, to_number
from maskbench.operators import bootstrap, gate, stats


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(1)
    n = 6000
    return pd.DataFrame({
        "k": np.where(rng.random(n) < 0.6, 0, rng.integers(1, 40, n)),
        "u": np.arange(n),
        "x": np.round(rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n), 4),
        "y": rng.integers(0, 7, n) / 7.0,
    })


@pytest.fixture(scope="module")
def df(spark, skewed):
    return spark.createDataFrame(skewed).repartition(8).cache()


def test_value_chunk_is_monotone(spark, skewed):
    v = sorted({*skewed.x, -1e9, 1e9, 0.0, -1e-12, 1e-12, 0.5, np.nextafter(0.5, 1)})
    d = spark.createDataFrame([(float(x),) for x in v], "x double")
    c = [r[0] for r in d.orderBy("x").select(value_chunk("x")).collect()]
    assert c == sorted(c) and len(set(c)) > 100


def test_running_sum_max_and_total(df, skewed):
    got = running(df, ["k"], ["u"], number_chunk("u", 500), {"s": F.col("y")}, {"m": F.col("x")},
                  totals=["s"]).toPandas().sort_values(["k", "u"])
    want = skewed.sort_values(["k", "u"])
    g = want.groupby("k")
    assert len(got) == len(skewed)
    np.testing.assert_allclose(got.s, g.y.cumsum())
    np.testing.assert_allclose(got.m, g.x.cummax())
    np.testing.assert_allclose(got.s_total, g.y.transform("sum"))


def test_ordinal(df, skewed):
    got = ordinal(df, ["k"], ["u"], number_chunk("u", 128), "p", "n").toPandas().sort_values(["k", "u"])
    g = skewed.sort_values(["k", "u"]).groupby("k")
    assert (got.p.values == g.cumcount().values).all()
    assert (got.n.values == g.u.transform("count").values).all()


@pytest.mark.parametrize("col", ["x", "y"])
def test_rank_and_quantiles(df, skewed, col):
    r = rank_table(df, ["k"], col).toPandas()
    r["rank"] = r.n_before + (r.n + 1) / 2
    want = skewed.assign(rank=skewed.groupby("k")[col].rank()).drop_duplicates(["k", col])
    m = r.merge(want[["k", col, "rank"]], on=["k", col], suffixes=("", "_w"))
    assert len(m) == len(r) == len(want)
    np.testing.assert_allclose(m["rank"], m.rank_w)
    q = quantiles(df, ["k"], col, {"a": 0.1, "b": 0.5, "c": 0.93}).toPandas().set_index("k").sort_index()
    w = skewed.groupby("k")[col].quantile([0.1, 0.5, 0.93]).unstack()
    np.testing.assert_allclose(q[["a", "b", "c"]].values, w.values)
    i = quantiles(df, ["k"], col, {"a": 0.25, "z": 1.0}, method="index").toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        v = sorted(g[col])
        assert i.a[k] == v[len(v) // 4] and i.z[k] == v[-1]


def test_results_do_not_depend_on_partitioning(df):
    a = bootstrap.bootstrap_ci(df.repartition(3), ["k"], ["u"], "y", 30).toPandas().sort_values("k")
    b = bootstrap.bootstrap_ci(df.repartition(13, "u"), ["k"], ["u"], "y", 30).toPandas().sort_values("k")
    np.testing.assert_allclose(a.values, b.values, rtol=1e-12)


def test_spearman_with_ties(df, skewed):
    got = bootstrap.rank_correlation(df, ["k"], "x", "y").toPandas().set_index("k").rho
    want = skewed.groupby("k")[["x", "y"]].apply(lambda g: g.rank().corr().iloc[0, 1])
    np.testing.assert_allclose(got.sort_index(), want.sort_index(), atol=1e-12)


def test_cliffs_delta_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 40) / 3.0, rng.integers(2, 12, 30) / 3.0
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    d = spark.createDataFrame(rows, "side string, v double").withColumn("k", F.lit(1))
    got = stats.cliffs_delta(d, ["k"], "side", "v", "a", "b").first().cliffs_delta
    assert got == pytest.approx(np.sign(b[:, None] - a[None, :]).mean())


def test_gate_equals_a_fold(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(f), float(rng.random()), int(f > 0 and (f % 5 == 0 or f == 1)))
            for i in range(6) for f in range(int(rng.integers(1, 400)))]
    d = spark.createDataFrame(rows, "inst int, frame int, vacuity double, is_keyframe int")
    for legacy in (False, True):
        got = {r.inst: (r.events, r.rejections, r.longest) for r in gate.gate_replay(
            d, ["inst"], [0.45], 2, legacy=legacy).collect()}
        for inst in range(6):
            consec = ev = rej = mx = 0
            for _, _, v, kf in [r for r in rows if r[0] == inst]:
                flag = bool(kf) and v >= 0.45
                if not legacy and not kf:
                    continue
                consec = consec + 1 if flag else 0
                rej += flag
                mx = max(mx, consec)
                if consec >= 2:
                    ev, consec = ev + 1, 0
            assert got.get(inst, (0, 0, 0)) == (ev, rej, mx)


def test_profile_closed_form_equals_the_fold(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for inst in range(3):
        w = np.full(5, 0.2)
        for k in range(int(rng.integers(1, 30))):
            e = np.where(rng.random(5) < 0.7, rng.random(5), 0.0) * (k % 4 != 3)
            rows += [(inst, k, o, float(v)) for o, v in enumerate(e)]
            if e.sum() > 0:
                w = 0.55 * w + 0.45 * e / e.sum()
        want[inst] = w
    d = spark.createDataFrame(rows, "inst int, frame int, op int, e double")
    got = gate.profile_weights(d, ["inst"], 5).toPandas().sort_values(["inst", "op"])
    for inst, w in want.items():
        np.testing.assert_allclose(got[got.inst == inst].w, w, atol=1e-12)


def test_numeric_coercion(spark):
    d = spark.createDataFrame([("3",), ("3.0",), ("3.50",), ("",), ("nan",), ("inf",), ("x",), (None,)], "t string")
    r = d.select(to_number("t").alias("v"), level_label("t").alias("l")).collect()
    assert [x.v for x in r] == [3.0, 3.0, 3.5, None, None, None, None, None]
    assert [x.l for x in r[:3]] == ["3", "3", "3.5"]


def test_missing_values_do_not_count(df):
    """Rows with NULL or NaN change nothing, whatever the size of the key."""
    nan = F.lit(float("nan"))
    for n in (12, 60, 400):
        d = df.where(F.col("u") < n).withColumn("c", F.col("u") % 20)
        more = d.unionByName(d.withColumn("y", F.when(F.col("u") % 2 == 0, nan)))
        for run in (lambda t: bootstrap.bootstrap_ci(t, ["k"], ["u"], "y", 25),
                    lambda t: bootstrap.bootstrap_ci(t, ["k"], ["u"], "y", 25, statistic="median"),
                    lambda t: bootstrap.unit_bootstrap_rho(t, ["k"], ["c"], "x", "y", 12)):
            a, b = (run(t).toPandas().sort_values("k") for t in (d, more))
            assert len(a) == len(b)
            np.testing.assert_allclose(a.values, b.values, atol=1e-9)


def test_few_clusters_are_refused(df):
    d = df.where("k = 0").withColumn("c", F.col("u") % 7)
    assert bootstrap.unit_bootstrap_rho(d, ["k"], ["c"], "x", "y", 12).count() == 0
    assert bootstrap.unit_bootstrap_rho(d, ["k"], ["c"], "x", "y", 12, min_units=7).count() == 1


def test_weights_have_mean_one(spark):
    w = bootstrap.multiplicities(spark.range(2000), ["id"], 20).agg(F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
    assert abs(w[0] / 40_000 - 1) < 0.03 and abs(w[1] / 40_000 - 2) < 0.1



def test_hash_matches_hashlib(spark):
    import hashlib

    got = spark.range(1).select(hash32(F.lit(7), F.lit("fog"), F.lit(3)).alias("h")).first().h
    assert got == int(hashlib.md5(b"7|fog|3").hexdigest()[:8], 16)
    assert spark.range(1).select(hash_chunk(F.lit(2**32 - 1)).alias("c")).first().c == 4095
