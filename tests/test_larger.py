"""Steps that were mended for size: results stay those of the plain definitions."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskbench.functions import ordered
from maskbench.kernels import image, png, restore
from maskbench.functions.ordered import number_chunk, ordinal
from maskbench.operators import guards, merge, stats, tables
from maskbench.sources import labels


@pytest.fixture
def rows(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 60, n).astype(str)), "u": rng.permutation(n),
                        "x": np.round(rng.normal(size=n), 2), "y": np.where(rng.random(n) < 0.2, None, rng.random(n))})
    return pdf, spark.createDataFrame(pdf, "k string, u long, x double, y double").repartition(5)


def test_small_keys_are_not_cut_into_chunks(rows, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_ROWS", 100)
    pdf, df = rows
    d = df.withColumn("k", F.when(F.col("k") != "7", F.col("k")))
    got = ordinal(d, ["k"], ["u"], number_chunk("u", 64), "p", "n", small_keys=True)
    totals = got.where("p = 0").count()
    got = got.toPandas().sort_values("u")
    want = pdf.assign(k=pdf.k.where(pdf.k != "7")).sort_values("u")
    g = want.groupby("k", dropna=False)
    assert (got.p.values == g.cumcount().values).all() and (got.n.values == g.u.transform("size").values).all()
    assert totals == want.k.nunique(dropna=False)                     # a null key is a key
    marked = ordered.with_large(d, ["k"]).where("_large").select("k").distinct().toPandas().k.tolist()
    assert "hot" in marked and len(marked) < 5


def test_merged_rows_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    d = spark.createDataFrame([("a", 1, 0.5, "p"), ("a", 1, 0.5, "q"), ("b", 2, None, "p")], "s string, f int, v double, src string")
    d = d.withColumn("v", counted("v"))
    m = merge.merge_chunks(d, ["s", "f"], ["v"])
    assert m.columns == ["s", "f", "v", "src"] and sorted(map(tuple, m.select("s", "f", "v").collect())) == [("a", 1, 0.5), ("b", 2, None)]
    assert m.count() == 2 and seen.value == 3


def test_digest_of_rows_by_key(spark):
    values = [0.1, -0.0, 1234567.891, 1e-7, 3e12, None, float("nan"), 1 / 3]
    d = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)], "k string, i long, v double").repartition(3)
    text = lambda v: "NULL" if v is None else "0" if v == 0 else "" if v != v else "%.9g" % v
    word = np.sum([np.frombuffer(hashlib.md5(f"{i}|{text(v)}".encode()).digest(), ">u4").astype(np.int64) for i, v in enumerate(values)], axis=0) % (1 << 32)
    want = "".join(f"{w:08x}" for w in word)
    got = guards.series_digest(d.where("k = 'a'"), ["k"], ["i"], number_chunk("i", 3), "v")
    assert [tuple(r) for r in got.collect()] == [("a", len(values), want)]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [10, 100, 1 << 18])
def test_cell_summary_of_small_and_large_cells(rows, monkeypatch, limit):
    monkeypatch.setattr(ordered, "SMALL_ROWS", limit)
    pdf, df = rows
    got = tables.iqa_cell_summary(df, ["x", "y"], ["k"]).toPandas().set_index(["k", "metric"]).sort_index()
    long = pdf.melt(["k"], ["x", "y"], "metric", "v").dropna()
    long["v"] = long.v.astype(float)
    g = long.groupby(["k", "metric"]).v
    want = pd.DataFrame({"mean": g.mean(), "std": g.std(ddof=0), "n": g.size(), "p10": g.quantile(0.1), "p90": g.quantile(0.9)})
    assert (got.index == want.index).all()
    np.testing.assert_allclose(got[want.columns].astype(float), want.astype(float), atol=1e-12)


def test_permutations_between_units_meet_once(spark, monkeypatch):
    """Whole permutations in a task give what the chunked way gives, also with ties, gaps and long names."""
    rng = np.random.default_rng(8)
    rows = [(k, f"{u:03d}" + "z" * (60 if u % 5 == 0 else 0), None if k == "gap" and u % 4 == 0 else float(rng.integers(0, 6)), float(rng.integers(0, 9)))
            for k in ("all", "gap") for u in range(40)]
    d = spark.createDataFrame(rows, "k string, unit string, x double, y double")
    find = lambda: sorted(map(tuple, stats.between_association(d, ["k"], ["unit"], "x", "y", n_perm=60, seed=3).collect()))
    got = find()
    monkeypatch.setattr(stats, "WHOLE_PERMUTATION", 0)
    want = find()
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want] and len(got) == 2
    assert np.allclose([r[2] for r in got], [r[2] for r in want])


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_kernels_of_small_frames_against_plain_definitions(kind):
    rng = np.random.default_rng(2)
    for h, w in ((1, 1), (1, 32), (7, 5), (14, 32), (40, 9)):
        x = rng.integers(0, 256, (h, w, 3)).astype(kind) / kind(255)
        flat = x.reshape(-1, 3)
        assert (image.percentiles(flat, 1.0, 99.0) == np.percentile(flat, [1.0, 99.0], axis=0)).all()
        for r in (1, 7, 11):
            p = np.pad(x[..., 0], r, constant_values=np.inf)
            want = [[p[i:i + 2 * r + 1, j:j + 2 * r + 1].min() for j in range(w)] for i in range(h)]
            assert (image.local_min(x[..., 0], r) == np.array(want)).all()
    spare = restore.SPARE_BELOW
    assert (spare[:, -1] == np.arange(256)).all() and (np.diff(spare, axis=1) >= 0).all()


def test_rows_predicted_from_left_or_above_are_sums():
    rng = np.random.default_rng(3)
    for fixed in (True, False):
        kinds = np.repeat(rng.integers(0, 3, (1, 9)), 6, axis=0) if fixed else rng.integers(0, 3, (6, 9))
        rows = rng.integers(0, 256, (6, 4, 9, 3)).astype(np.uint8)
        mixed = np.concatenate([kinds, np.full((6, 1), 4)], axis=1)              # one image more that needs anti-diagonals
        want = png.unpredict(mixed, np.concatenate([rows, rows[:, :, :1]], axis=2))[:, :, :9]
        assert (png._unpredict_simple(kinds, rows) == want).all()


def test_colour_maps_are_read_once_for_several_labels(spark):
    rng = np.random.default_rng(4)
    shades = np.array([[0, 0, 0], [10, 0, 0], [0, 200, 0], [255, 255, 255]], np.uint8)
    frames = [shades[rng.integers(0, 4, (3 + i % 2, 5))] for i in range(6)]
    tree = spark.createDataFrame([("s", i, png.write_png(a, i % 3)) for i, a in enumerate(frames)], "seq string, number long, content binary")
    maps = labels.colour_maps(tree)
    assert "content" not in maps.columns and maps.count() == 6
    meta = spark.createDataFrame([('{"objects": {"": {"7": {"palette": [0, 200, 0]}}}}',)], "value string")
    for colours in (None, labels.meta_colours(meta)):
        a, b = (sorted(map(tuple, labels.colour_labels(d, colours).collect())) for d in (tree, maps))
        assert a == b and len(a) == 6
    key = frames[0].astype(int) @ [65536, 256, 1]
    first = maps.where("number = 0").first()
    assert first.colours == sorted(set(key.ravel().tolist()))
    assert np.array_equal(np.array(first.colours)[np.frombuffer(first.at, "<u2")], key.ravel())
