"""Planted inputs with known answers, each with a case that must fire and one that must not."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskbench.functions.tails import rank_correlation_p, signed_rank_p
from maskbench.operators import (bootstrap, collapse, denominator as dn, evidence, gaps, grid, guards,
                                 merge, stats, tables)


def frame_rows(spark, n=600, seqs=25, seed=0, score=None, mode="greedy"):
    rng = np.random.default_rng(seed)
    p = pd.DataFrame({m: rng.random(n) for m in ("iqa_a", "iqa_b")})
    p["jf_frame"] = rng.random(n) if score is None else score(p, rng)
    p["seq"] = [f"s{i % seqs}" for i in range(n)]
    p["frame"] = np.arange(n) // seqs
    p = p.assign(obj_id=1, mode=mode, degradation="fog", level=3.0, arm="")
    return spark.createDataFrame(p)


def table(df, min_rows=10):
    rows = stats.metric_rows(df, ["iqa_a", "iqa_b"], ["jf_frame"])
    return stats.correlation_table(rows, ["metric"], "x", "jf_frame", [], min_rows=min_rows
                                   ).toPandas().set_index("metric")


def test_independent_and_monotone_relations(spark):
    t = table(frame_rows(spark))
    assert (t.rho.abs() < 0.15).all() and (t.p > 0.01).all() and (t.usable == 0).all()
    t = table(frame_rows(spark, score=lambda p, r: 0.05 + 0.9 * p.iqa_a))
    assert t.rho["iqa_a"] > 0.9 and t.usable["iqa_a"] == 1 and abs(t.rho["iqa_b"]) < 0.15


def test_oracle_and_other_arms_do_not_enter(spark):
    d = frame_rows(spark)
    oracle = frame_rows(spark, 200, seed=1, score=lambda p, r: np.ones(200), mode="oracle_clean")
    other = frame_rows(spark, 200, seed=2, mode="method")
    clean = frame_rows(spark, 50, seed=3).withColumn("degradation", F.lit("clean"))
    both = d.unionByName(oracle).unionByName(other).unionByName(clean)
    assert grid.iqa_subset(both, "greedy").count() == d.count()
    assert grid.iqa_subset(both, "method").count() == 200
    with pytest.raises(ValueError):
        grid.iqa_subset(both, "oracle_clean")


def test_split_instances_leave_the_correlation_alone(spark):
    d = frame_rows(spark, score=lambda p, r: 0.3 + 0.2 * p.iqa_a + 0.5 * r.random(600))
    two = d.withColumn("jf_frame", F.col("jf_frame") + 0.05).unionByName(
        d.withColumn("obj_id", F.lit(2)).withColumn("jf_frame", F.col("jf_frame") - 0.05))
    c = collapse.collapse_instances_per_frame(two, metrics=["iqa_a", "iqa_b"])
    a, b = table(d), table(c)
    np.testing.assert_allclose(a.rho.sort_index(), b.rho.sort_index(), atol=1e-9)
    assert (b.n == 600).all()


def test_significant_is_not_usable(spark):
    t = table(frame_rows(spark, 2000, score=lambda p, r: 0.16 * p.iqa_a + 0.84 * r.random(2000)))
    assert t.p["iqa_a"] < 0.01 and t.usable["iqa_a"] == 0


def arms(spark):
    rows = []
    for s in range(6):
        rows += [(f"s{s}", 1, "method", "fog", 3.0, "", 0.50), (f"s{s}", 1, "greedy", "fog", 3.0, "", 0.30),
                 (f"s{s}", 1, "method", "fog", 3.0, "A0", 0.50), (f"s{s}", 1, "method", "fog", 3.0, "A1", 0.10)]
    return spark.createDataFrame(rows, "seq string, obj_id int, mode string, degradation string, level double, arm string, jf_frame double")


def test_arms_are_not_pooled(spark):
    from maskbench.functions.keys import is_main

    c = collapse.clip_scores(arms(spark))
    main = tables.pivot_with_deltas(c.where(is_main("arm")), ["greedy", "method"], "greedy").first()
    assert main.method == pytest.approx(0.5) and main.d_method == pytest.approx(0.2)
    abl = {r.arm: r for r in tables.ablation_table(c).collect()}
    assert set(abl) == {"A0", "A1"} and abl["A1"].delta_vs_ref == pytest.approx(-0.4)


def test_mean_of_means_over_objects(spark):
    rows = [("s0", o, m, "fog", 3.0, "", v) for m, vs in (("a", (0.6, 0.2)), ("b", (0.4, 0.3)))
            for o, v in enumerate(vs) for _ in range(3 if o else 1)]
    d = spark.createDataFrame(rows, "seq string, obj_id int, mode string, degradation string, level double, arm string, jf_frame double")
    c = collapse.clip_scores(d)
    p = stats.paired_values(c, ["seq"], "mode", "jf", "b", "a").first()
    assert (p.b, p.a, p.d) == (pytest.approx(0.40), pytest.approx(0.35), pytest.approx(0.05))


def clips(spark, values):
    """values: {(mode, degradation): score or list per clip}"""
    rows = [(f"s{i}", m, d, 3.0, "", float(v[i] if isinstance(v, list) else v))
            for (m, d), v in values.items() for i in range(4)]
    return spark.createDataFrame(rows, "seq string, mode string, degradation string, level double, arm string, jf double")


@pytest.mark.parametrize("member,shift,verdict", [(0.10, 0.10, "WIDENS"), (0.30, -0.10, "NARROWS"), (0.20, 0.0, "FLAT")])
def test_gap_shift_sign(spark, member, shift, verdict):
    c = clips(spark, {("memory", "C"): 0.7, ("base", "C"): 0.5, ("memory", "m"): 0.4 + member, ("base", "m"): 0.4})
    mem = gaps.member_table(spark, {"C": ("m",)})
    s = gaps.gap_shift(c, mem, "memory", "base").first()
    assert s.mean_shift == pytest.approx(shift) and s.consistent == 1 and s.n == 4
    v = gaps.widening_verdict(gaps.group_gap(c, "memory", "base"), mem).first()
    assert v.verdict == verdict


def test_holm(spark):
    p = [0.001, 0.01, 0.04, 0.20, 0.04]
    d = spark.createDataFrame([("f", i, x) for i, x in enumerate(p)], "f string, i int, p double")
    got = [r.holm_p for r in stats.holm(d, ["f"], "p").orderBy("i").collect()]
    np.testing.assert_allclose(got, [0.005, 0.04, 0.12, 0.20, 0.12])


@pytest.mark.parametrize("effect", [0.2, -0.2, 0.0])
def test_paired_report_direction(spark, effect):
    base = np.random.default_rng(0).uniform(0.3, 0.9, 12)
    rows = [("k", i, float(b), float(b + effect)) for i, b in enumerate(base)]
    p = spark.createDataFrame(rows, "k string, i int, a double, b double").withColumn(
        "d", F.round(F.col("b") - F.col("a"), 12))
    r = stats.paired_report(p, ["k"], ["i"], n_boot=200).first()
    if effect == 0:
        assert r.cliffs_delta == 0 and r.wilcoxon_p == 1.0 and r.mean_delta == 0 and r.n_nonzero == 0
    else:
        s = np.sign(effect)
        assert s * r.cliffs_delta > 0.3 and r.wilcoxon_p < 1e-3 and s * r.mean_delta == pytest.approx(0.2)
        assert min(s * r.ci_lo, s * r.ci_hi) > 0.15


def test_signed_rank_p_values():
    # every one of 2^5 sign patterns, counted by hand
    w = [sum(r for r, b in zip(range(1, 6), f"{m:05b}") if b == "1") for m in range(32)]
    for stat in (0, 3, 7):
        assert signed_rank_p(5, stat, 0.0, True) == pytest.approx(min(1, 2 * sum(x <= stat for x in w) / 32))
    assert signed_rank_p(0, 0, 0, False) == 1.0
    assert signed_rank_p(60, 200.0, 0.0, False) < 1e-4 < signed_rank_p(60, 880.0, 0.0, False)


def test_rank_correlation_p_is_student_t():
    # t distribution with 1 and 2 degrees of freedom in closed form
    assert rank_correlation_p(0.5, 3) == pytest.approx(1 - 2 / np.pi * np.arctan(0.5 / np.sqrt(0.75)))
    t = 0.5 * np.sqrt(2 / 0.75)
    assert rank_correlation_p(0.5, 4) == pytest.approx(1 - t / np.sqrt(2 + t * t))


def test_bootstrap_small_groups(spark):
    d = spark.createDataFrame([("one", 1, 0.4), ("none", 1, None), ("two", 1, 0.2), ("two", 2, 0.6)],
                              "k string, u int, v double")
    r = {x.k: x for x in bootstrap.bootstrap_ci(d, ["k"], ["u"], "v", 50).collect()}
    assert set(r) == {"one", "two"} and (r["one"].ci_lo, r["one"].ci_hi) == (0.4, 0.4)
    assert r["two"].ci_lo == pytest.approx(0.2) and r["two"].ci_hi == pytest.approx(0.6)


def test_auc_known_cases(spark):
    d = spark.createDataFrame([(i / 10, i >= 5) for i in range(10)], "s double, good boolean").withColumn("k", F.lit(1))
    assert stats.rank_auc(d, ["k"], "s", "good").first().auc == 1.0
    assert stats.rank_auc(d.withColumn("s", -F.col("s")), ["k"], "s", "good").first().auc == 0.0


def test_denominator_correction(spark):
    rows = spark.createDataFrame([("s", 1, 0.25, 100)], "seq string, obj_id int, jf double, n_frames int")
    pres = lambda n: spark.createDataFrame([("s", 1, 100, n)], "seq string, obj_id int, n_clip int, n_present int")
    r = dn.correct_denominator(rows, pres(50), ["jf"]).first()
    assert (r.jf, r.jf_raw, r.p1_scale) == (0.5, 0.25, 2.0)
    for bad in (pres(0), pres(101), pres(50).withColumn("obj_id", F.lit(9))):
        with pytest.raises(ValueError):
            dn.correct_denominator(rows, bad, ["jf"])


def test_within_and_between_signals(spark):
    rng = np.random.default_rng(5)
    rows = []
    for u in range(30):
        level = rng.normal() * 3
        for i in range(20):
            e = rng.normal()
            rows.append(("k", u, i, float(level), float(level + e), float(e + 10 * rng.normal() * 0 + rng.normal() * 0.05), float(e)))
    d = spark.createDataFrame(rows, "k string, u int, i int, level double, y double, within double, dev double")
    w = stats.within_association(d, ["k"], ["u"], "within", "dev").first()
    assert w.within_rho > 0.9 and w.share_positive == 1.0 and w.wilcoxon_p < 1e-5
    b = stats.between_association(d, ["k"], ["u"], "level", "y", n_perm=60).first()
    assert b.rho > 0.9 and b.perm_p < 0.05
    nb = stats.between_association(d, ["k"], ["u"], "dev", "level", n_perm=60).first()
    assert nb.perm_p > 0.02


def test_sign_flip_uses_a_real_statistic(spark):
    d = spark.createDataFrame([("a", i, 0.2 + 0.01 * i) for i in range(12)]
                              + [("z", i, 0.2 * (-1) ** i) for i in range(12)], "k string, i int, d double")
    r = {x.k: x.p for x in stats.sign_flip_test(d, ["k"], ["i"], "d", 400).collect()}
    assert r["a"] < 0.02 and r["z"] > 0.5


def test_sign_flip_sums_do_not_depend_on_the_partitions(spark):
    """Partial sums of several tasks and batches equal a plain loop; NULL, NaN and zero differences are left out."""
    import hashlib

    rows = [("ab"[i % 2], i, (0.1 * (i % 7) - 0.2)) for i in range(150)]
    odd = [("a", 900, None), ("a", 901, float("nan")), ("b", 902, 0.0), ("c", 903, None)]
    want = {}
    for k in "ab":
        mine = [(i, v) for a, i, v in rows if a == k and v != 0]
        stat, hits = abs(sum(v for _, v in mine)), 0
        bits = {i: [int(b) for blk in range(11) for b in format(int(hashlib.md5(f"3|{blk}|{i}".encode()).hexdigest(), 16), "0128b")] for i, _ in mine}
        for perm in range(1300):
            hits += abs(sum(-v if bits[i][perm] else v for i, v in mine)) >= stat - 1e-9
        want[k] = (len(mine), hits / 1300)
    d = spark.createDataFrame(rows + odd, "k string, i int, d double").repartition(5)
    got = {r.k: (r.n, r.p) for r in stats.sign_flip_test(d, ["k"], ["i"], "d", 1300, seed=3).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_duplicates_and_conflicts(spark):
    d = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), ("b", 1, 0.5), ("b", 1, 0.6), ("c", 1, None),
                               ("c", 1, None), ("e", 1, None), ("e", 1, 0.1)], "s string, f int, v double")
    assert merge.duplicate_report(d, ["s", "f"], ["v"]).first().asDict() == {
        "distinct_rows": 4, "agreed": 2, "conflicts": 2}
    with pytest.raises(ValueError):
        merge.merge_chunks(d, ["s", "f"], ["v"])
    assert merge.merge_chunks(d.where("s in ('a', 'c')"), ["s", "f"], ["v"]).count() == 2


def test_partial_cells_fire_only_on_short_cells(spark):
    rows = [("s", 1, "m", "fog", 3.0, f, 3) for f in range(2)] + [("t", 1, "m", "fog", 3.0, f, 3) for f in range(3)] + [
        ("v", 1, "m", "fog", 3.0, 0, 0)]
    d = spark.createDataFrame(rows, "seq string, obj_id int, mode string, degradation string, level double, frame int, n_frames int")
    inst = ["seq", "obj_id", "mode", "degradation", "level"]
    assert {r.seq for r in merge.partial_cells(d, inst).collect()} == {"s", "v"}
    assert {r.seq for r in merge.trim_partial(d, inst).collect()} == {"t"}


def test_guards_fire(spark):
    d = spark.createDataFrame([("k", 0.5, 0.5), ("k", 0.4, 0.4)], "k string, a double, b double")
    with pytest.raises(guards.GuardError):
        guards.require_none(guards.noop_arms(d, ["k"]), "arm without effect")
    guards.require_none(guards.noop_arms(d.withColumn("b", F.col("b") + 1e-12), ["k"]), "arm without effect")
    a = spark.createDataFrame([("x", 0.5)], "k string, jf double")
    assert guards.reference_drift(a, a.withColumn("jf", F.lit(0.5 + 5e-7)), ["k"], "jf").count() == 0
    assert guards.reference_drift(a, a.withColumn("jf", F.lit(0.51)), ["k"], "jf").count() == 1
    assert guards.reference_drift(a, a.where("false"), ["k"], "jf").count() == 1


def test_grid_guard(spark):
    cell = ["mode", "level"]
    want = spark.createDataFrame([("m", 1.0), ("m", 2.0), ("m", 3.0)], "mode string, level double")
    rows = spark.createDataFrame([("m", 1.0, "s", 1), ("m", 1.0, "s", 2), ("m", 2.0, "s", 1), ("m", 3.0, "s", 1),
                                  ("m", 3.0, "s", 1), ("m", 3.0, "s", 2)], "mode string, level double, seq string, obj_id int")
    v = {r.level: r.violation for r in guards.grid_violations(want, rows, cell, instances=2, sequences=1).collect()}
    assert v == {2.0: "wrong instance count", 3.0: "duplicate rows"}
    v = guards.grid_violations(want, rows.where("level < 3"), cell, instances=2).collect()
    assert {r.level for r in v} == {2.0, 3.0}


@pytest.mark.parametrize("size", [1, 300, 9000])
def test_series_digest(spark, size):
    """One definition at every size, and parts merge into the whole."""
    import hashlib

    from maskbench.functions.ordered import number_chunk

    some = [0.1, 1 / 3, 12345.678901234, 1e-7, 1.5e12, 0.0, -2.5e-5, 100.0]
    vals = [some[i % 8] * (1 + i // 8) for i in range(size)]
    words = [0] * 4
    for i, v in enumerate(vals):
        h = hashlib.md5(f"{i}|{v:.9g}".encode()).hexdigest()
        words = [(w + int(h[8 * j:8 * j + 8], 16)) % 2**32 for j, w in enumerate(words)]
    d = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate(vals)], "k string, i long, v double")
    got = guards.series_digest(d, ["k"], ["i"], number_chunk("i", 100), "v").first()
    assert got.n == size and got.digest == "".join(f"{w:08x}" for w in words)
    cut = size // 3
    parts = [guards.series_digest(d.where(c), ["k"], ["i"], number_chunk("i"), "v", start=s) for c, s in ((f"i >= {cut}", cut), (f"i < {cut}", 0))]
    assert guards.merge_digests(parts[0].unionByName(parts[1]), ["k"]).first() == got


def test_exact_signed_rank_p(spark):
    """The counted null equals all sign patterns, in Spark and in the SQL that the queries are checked by."""
    import itertools

    import duckdb

    from maskbench.plans.registry import sql_signed_p

    vals = {"a": [0.3, -0.1, 0.2, 0.55, -0.4, 0.7, 0.05], "t": [0.1, 0.1, -0.2, 0.3], "z": [0.0, 0.0], "o": [1.5]}
    rows = [(k, float(v)) for k, vs in vals.items() for v in vs]
    got = {r.k: r for r in stats.with_signed_rank_p(stats.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"])).collect()}
    r = [sorted(abs(x) for x in vals["a"]).index(abs(v)) + 1 for v in vals["a"]]
    w = min(sum(x for x, v in zip(r, vals["a"]) if v > 0), sum(x for x, v in zip(r, vals["a"]) if v < 0))
    below = sum(sum(x for x, s in zip(r, pattern) if s) <= w for pattern in itertools.product((0, 1), repeat=len(r)))
    assert got["a"].wilcoxon_p == pytest.approx(2 * below / 2 ** len(r)) and got["a"].p_method == "exact"
    assert (got["t"].p_method, got["z"].p_method, got["z"].wilcoxon_p, got["o"].wilcoxon_p) == ("normal", "none", 1.0, 1.0)
    table = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in rows) + ") x(k, d)"
    for k, p, m in duckdb.sql(f"SELECT k, wilcoxon_p, p_method FROM ({sql_signed_p(table, ['k'])})").fetchall():
        assert got[k].wilcoxon_p == pytest.approx(p, abs=1e-12) and got[k].p_method == m
    few = stats.with_signed_rank_p(stats.signed_rank(spark.createDataFrame(rows, "k string, d double"), ["k"]), exact_max_n=3)
    assert {x.k: x.p_method for x in few.collect()} == {"a": "normal", "t": "normal", "z": "none", "o": "exact"}


def test_pick_three_ties(spark):
    d = spark.createDataFrame([("k", s, 1, v) for s, v in (("a", 0.5), ("b", 0.5), ("c", 0.1), ("d", 0.0), ("e", 0.0))],
                              "k string, seq string, obj_id int, d double")
    r = {x.pick: (x.seq, x.delta) for x in evidence.pick_three(d, ["k"]).collect()}
    assert r == {"best": ("a", 0.5), "median": ("c", 0.1), "worst": ("e", 0.0)}


def test_arm_configuration_is_checked(spark):
    base = {"K": 5, "tau": 0.13}
    t = grid.resolve_arms(spark, base, {"A0": {}, "A1": {"K": 1}})
    assert {(r.arm, r.setting): r.value for r in t.collect()}[("A1", "K")] == 1.0
    with pytest.raises(KeyError):
        grid.resolve_arms(spark, base, {"A1": {"kk": 1}})
    with pytest.raises(ValueError):
        grid.resolve_arms(spark, {**base, "fuse": 0}, {"A1": {"fuse": 1}}, ignored=["fuse"])


def test_dirichlet_limits(spark):
    d = spark.createDataFrame([(k, o, s) for k, s in ((1, 1.0), (0, 0.0)) for o in range(3)], "k int, op int, score double")
    v = {r.k: r.vacuity for r in evidence.dirichlet(d, ["k"]).collect()}
    assert v[1] == pytest.approx(1 / 9, abs=1e-6) and v[0] == pytest.approx(1.0, abs=1e-6)




TOY_A0 = [0.61, 0.40, 0.75, 0.20, 0.55, 0.33]
TOY_A1 = [0.64, 0.38, 0.80, 0.26, 0.55, 0.41]


def test_ablation_report_reading(spark):
    rows = []
    for i, (a, b) in enumerate(zip(TOY_A0, TOY_A1)):
        rows += [(f"s{i}", "fog", "A0", a, 1.0), (f"s{i}", "fog", "A1", b, 2.0), (f"s{i}", "fog", "A2", a - 0.5, 1.0)]
    c = spark.createDataFrame(rows, "seq string, degradation string, arm string, jf double, n_encoder_calls double")
    r = {x.arm: x for x in tables.ablation_report(c, ["A1", "A2"], ["degradation"], n_boot=50).collect()}
    assert (r["A1"].wins, r["A1"].losses, r["A1"].n_nonzero) == (4, 1, 5)
    assert r["A1"].mean_delta == pytest.approx(0.2 / 6) and r["A1"].n_encoder_calls == 2.0
    # six clips: the least p is 2/64, doubled by Holm, so even a large loss is not significant
    assert r["A2"].wilcoxon_p == 0.03125 or r["A2"].n_nonzero == 6
    assert r["A2"].reading in ("non-negligible, not significant", "worse")
