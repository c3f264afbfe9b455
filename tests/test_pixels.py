"""Properties of the pixel kernels and the jobs around them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from maskbench.kernels import degrade as D, flow as FL, mask as M, quality as Q, restore as R
from maskbench.kernels.image import as_bytes
from maskbench.operators import flow as fl, frames as fr, masks as mk

yy, xx = np.mgrid[0:72, 0:96]
IMG = np.stack([(yy * 3) % 256, (xx * 2) % 256, (yy + xx) % 256], -1).astype(np.uint8)


@pytest.mark.parametrize("name", [*D.SINGLES, *D.COMPOUNDS])
def test_degradations(name):
    a, b = D.degrade(IMG, name, 3, 1, 5), D.degrade(IMG, name, 3, 1, 5)
    assert (a == b).all() and a.min() >= 0 and a.max() <= 1 and a.shape == IMG.shape
    assert (D.degrade(IMG, name, 3, 1, 6) != a).any() and (D.degrade(IMG, name, 3, 2, 5) != a).any()
    scores = [Q.psnr(IMG, as_bytes(D.degrade(IMG, name, lv, 1, 5))) for lv in (1, 3, 5)]
    assert scores[0] > max(scores[1:])
    if name != "underwater":  # its backscatter converges to a constant
        assert scores[1] > scores[2]


def test_compound_members_keep_their_stream():
    one = np.random.default_rng(1 * 1_000_003 + 5 * 97 + D.name_hash("fog") % 9973)
    fogged = np.clip(D.fog(IMG / np.float32(255), 0.5, one), 0, 1)
    two = np.random.default_rng(1 * 1_000_003 + 5 * 97 + D.name_hash("sensor_noise") % 9973)
    want = np.clip(D.sensor_noise(fogged.astype(np.float32), 0.5, two), 0, 1)
    np.testing.assert_allclose(D.degrade(IMG, "C1_fog_noise", 3, 1, 5), want, atol=1e-6)


def test_severity_bounds_and_scaling():
    assert [D.scaled_severity(x) for x in (0, 1, 3, 5, 9)] == [0, 0, 0.5, 1, 1]


@pytest.mark.parametrize("name", R.NAMES)
def test_restoration(name):
    a = R.restore(IMG, name)
    assert a.shape == IMG.shape and a.dtype == np.float32 and 0 <= a.min() and a.max() <= 1
    assert (a == R.restore(IMG, name)).all()


def test_restoration_targets():
    foggy = D.degrade(IMG, "fog", 4, 1, 1)
    dark = lambda x: Q.no_reference(as_bytes(x))["iqa_dark_channel"]
    sharp = lambda x: Q.no_reference(as_bytes(x))["iqa_tenengrad"]
    assert dark(R.restore(foggy, "dcp")) < dark(foggy)
    soft = D.degrade(IMG, "motion_blur", 3, 1, 1)
    assert sharp(R.restore(soft, "unsharp")) > sharp(soft)
    assert len(R.NAMES) == 13


def test_lab_round_trip():
    x = IMG / 255.0
    np.testing.assert_allclose(R.from_lab(R.to_lab(x)), x, atol=2e-3)


def test_quality_identities():
    flat = np.full((20, 30, 3), 77, np.uint8)
    q = Q.panel(flat, flat)
    assert q["iqa_psnr"] == 99.0 and q["iqa_ssim"] == pytest.approx(1.0)
    assert q["iqa_laplacian_var"] == q["iqa_contrast"] == q["iqa_tenengrad"] == q["iqa_saturation"] == 0
    assert Q.ssim(IMG, IMG) == pytest.approx(1.0) and Q.ssim(IMG, IMG[::-1].copy()) < 0.9


def square(y, x, n=20, size=50):
    m = np.zeros((1, size, size), bool)
    m[0, y:y + n, x:x + n] = True
    return m


def test_mask_scores_on_squares():
    a, none = square(10, 10), np.zeros((1, 50, 50), bool)
    half = a.copy()
    half[0, :, 20:] = False
    assert M.region(a, a)[0] == 1 and M.region(a, half)[0] == 0.5 and M.region(a, none)[0] == 0
    assert M.region(none, none)[0] == M.boundary(none, none)[0] == 1 and M.boundary(a, none)[0] == 0
    assert 0.7 < M.boundary(a, square(11, 10))[0] < 1
    assert M.released_scores(a, square(11, 10))[1][0] > 0.7
    assert [v[0] for v in M.released_scores(none, none)] == [1, 1]
    assert [v[0] for v in M.released_scores(a, none)] == [0, 0]


def test_boundary_by_brute_force():
    rng = np.random.default_rng(0)
    m = rng.random((3, 9, 11)) < 0.6
    rim = M.rim(m)
    for k, y, x in np.ndindex(m.shape):
        nb = m[k, max(0, y - 1):y + 2, max(0, x - 1):x + 2]
        assert rim[k, y, x] == (m[k, y, x] and not nb.all())


def test_components_and_holes():
    m = np.ones((64, 64), bool)
    m[10:12, 10:12] = False
    m[12, 12] = False  # touches diagonally: one component of five
    m[30:60, 30:60] = False
    assert sorted(M.components(~m)[1][1:]) == [5, 900]
    f = M.fill_small_holes(m)
    assert f[10, 10] and f[12, 12] and not f[40, 40]
    rng = np.random.default_rng(1)
    r = rng.random((30, 40)) < 0.5
    labels, areas = M.components(r)
    assert areas[1:].sum() == r.sum() and (labels > 0).sum() == r.sum()
    for y, x in zip(*np.nonzero(r[:-1, :-1])):  # neighbours share a label
        for dy, dx in ((0, 1), (1, 0), (1, 1)):
            if r[y + dy, x + dx]:
                assert labels[y, x] == labels[y + dy, x + dx]


def test_pack_round_trip_and_boxes():
    rng = np.random.default_rng(2)
    m = rng.random((4, 7, 9)) < 0.3
    assert (M.unpack(M.pack(m), 7, 9) == m).all()
    assert M.boxes(square(10, 5))[0].tolist() == [5, 10, 24, 29]
    assert M.boxes(np.zeros((1, 6, 8), bool))[0].tolist() == [0, 0, 7, 5]


def test_flow_sign_and_chain():
    a, b = square(10, 10)[0], square(13, 12)[0]
    f = np.zeros((50, 50, 2), np.float32)
    f[..., 0], f[..., 1] = 2, 3
    assert (FL.warp(a, f) == b).all() and (FL.warp(a, -f) != b).any()
    np.testing.assert_allclose(FL.warp(a.astype(float), f, soft=True), b)
    assert FL.cycle_error(f, -f) == pytest.approx(0, abs=1e-6) and FL.cycle_error(f, f) > 5
    edge = square(0, 0)[0]
    assert FL.warp_inside(edge, f).sum() == 400 and FL.warp_inside(edge, -f).sum() < 400


def test_jobs_do_not_depend_on_partitioning(spark):
    rows = [(f"s{k % 3}", int(k // 3), 72, 96, bytearray(np.roll(IMG, k, 0).tobytes())) for k in range(9)]
    d = spark.createDataFrame(rows, "seq string, frame long, h int, w int, rgb binary")
    cond = [("clean", 1.0), ("rain", 3.0), ("C4_fog_blur_noise", 2.0)]

    def digest(df):
        return sorted((r.seq, r.frame, r.degradation, r.m, round(r.severity, 9)) for r in
                      fr.degraded_sequences(df, cond).select("seq", "frame", "degradation", "severity",
                                                             F.md5("rgb").alias("m")).collect())
    one = digest(d.coalesce(1))
    assert one == digest(d.repartition(5)) and len(one) == 27
    assert all(s == 1.0 for _, _, g, _, s in one if g == "clean")


def test_oracle_mode_sees_clean_frames(spark):
    d = spark.createDataFrame([("s", 0, 72, 96, bytearray(IMG.tobytes()))], "seq string, frame long, h int, w int, rgb binary")
    o = fr.observations_for_modes(fr.degraded_sequences(d, [("fog", 3.0)]), ["greedy", "oracle_clean"])
    q = {r["mode"]: r for r in fr.with_iqa(o, "clean_rgb").collect()}
    assert q["oracle_clean"].iqa_psnr == 99.0 > q["greedy"].iqa_psnr


def test_alignment_profile_peaks_at_zero(spark):
    rows, masks = [], []
    for t in range(12):
        img, m = np.full((40, 60, 3), 30, np.uint8), np.zeros((1, 40, 60), bool)
        img[10:25, 4 * t:4 * t + 12] = 220
        m[0, 10:25, 4 * t:4 * t + 12] = True
        rows.append(("v", t, 40, 60, bytearray(img.tobytes())))
        masks.append(("v", t, bytearray(M.pack(m)[0])))
    f = spark.createDataFrame(rows, "seq string, frame long, h int, w int, rgb binary")
    m = spark.createDataFrame(masks, "seq string, frame long, bits binary")
    p = {r.offset: r.mean_fit for r in fr.alignment_profile(f, m).collect()}
    assert max(p, key=p.get) == 0 and p[-1] > p[-3] and p[1] > p[3]
    assert fr.alignment_win_rate(f, m, 1, 0).first().win_rate == 1.0
    assert fr.alignment_win_rate(f, m, 1, 1).first().win_rate < 0.5


def test_propagation_follows_the_flow(spark):
    flow = np.zeros((50, 50, 2), np.float32)
    flow[..., 0] = 1
    ms = [("v", 1, t, 50, 50, bytearray(M.pack(square(10, 5 + t))[0]), 400) for t in range(8)]
    fs = [("v", t, bytearray(flow.tobytes())) for t in range(7)]
    m = spark.createDataFrame(ms, "seq string, obj_id int, frame long, h int, w int, bits binary, area long")
    f = spark.createDataFrame(fs, "seq string, frame long, flow binary")
    r = fl.chain_table(m, f, ["seq", "obj_id"]).first()
    assert r.n == 7 and r.iou_min == 1.0 and r.ratio_max == 1.0 and r.n_lost == 0
    a = fl.flow_direction_audit(m, f, ["seq", "obj_id"]).first()
    assert (a.pairs, a.wins, a.iou_plus) == (7, 7, 1.0) and a.iou_minus < a.iou_stay < 1


def test_a_long_clip_is_one_chain(spark):
    """200 frames equal a plain loop; a gap in the flow ends a chain; a clip without a start mask keeps its row."""
    rng = np.random.default_rng(1)
    flows = rng.integers(-1, 2, (200, 12, 12, 2)).astype(np.float32)
    masks = rng.random((201, 12, 12)) < 0.4
    masks[7] = False
    want, cur = [], masks[0]
    for t in range(200):
        cur = FL.warp(cur, flows[t])
        want.append((cur.sum() / masks[t + 1].sum() if masks[t + 1].any() else None, (cur & masks[t + 1]).sum() / max(1, (cur | masks[t + 1]).sum())))
    rows = [(s, 1, t, 12, 12, bytearray(M.pack(masks[t][None])[0]), int(masks[t].sum()))
            for s in ("long", "gap", "late") for t in range(201) if s != "late" or t > 3]
    m = spark.createDataFrame(rows, "seq string, obj_id int, frame long, h int, w int, bits binary, area long")
    f = spark.createDataFrame([(s, t, bytearray(flows[t].tobytes())) for s in ("long", "gap", "late", "none") for t in range(200) if s != "gap" or t != 50],
                              "seq string, frame long, flow binary")
    got = {r.seq: r for r in fl.chain_table(m, f, ["seq", "obj_id"]).collect()}
    r = got["long"]
    assert (r.n, r.n_lost) == (200, sum(i < 0.5 for _, i in want))
    ratios = [a for a, _ in want if a is not None]
    assert np.allclose([r.ratio_1, r.ratio_20, r.ratio_max, r.iou_1, r.iou_10, r.iou_20, r.iou_last, r.iou_min],
                       [want[0][0], want[19][0], max(ratios), want[0][1], want[9][1], want[19][1], want[-1][1], min(i for _, i in want)])
    assert got["gap"].n == 50 and got["gap"].iou_20 == r.iou_20
    assert got["late"].n == 0 and got["late"].iou_1 is None and got["late"].iou_min is None and set(got) == {"long", "gap", "late"}


def test_empty_frames_are_not_scored(spark):
    none, full = np.zeros((1, 8, 8), bool), np.zeros((1, 8, 8), bool)
    full[0, 2:6, 2:6] = True
    rows = [("s", t, 8, 8, bytearray(M.pack(m)[0])) for t, m in enumerate([full, none, none])]
    gts = [("s", t, bytearray(M.pack(m)[0])) for t, m in enumerate([full, none, full])]
    p = spark.createDataFrame(rows, "seq string, frame long, h int, w int, bits binary")
    g = spark.createDataFrame(gts, "seq string, frame long, bits binary")
    s = mk.score_frames(p, g, ["seq", "frame"])
    assert mk.sequence_scores(s, ["seq"]).first().asDict() == {"seq": "s", "j": 0.5, "f": 0.5, "jf": 0.5, "n_frames": 2}
    r = mk.score_frames(p, g, ["seq", "frame"], convention="released")
    assert mk.sequence_scores(r, ["seq"], skip_empty=False).first().j == pytest.approx(2 / 3)


@pytest.mark.parametrize("columns", [[(0, 32), (0, 7), None, None], [(0, 32), (0, 7), (1, 3), None], [(0, 32), (0, 1), (1, 2), None],
                                     [(0, 3_000_000_000), None], [(0, 1)], [None]])
def test_draws_of_rows_are_those_one_by_one(columns):
    for seed in range(20):
        one, all_at_once = np.random.default_rng(seed), np.random.default_rng(seed)
        one.random(5), all_at_once.random(5)
        want = [[one.random() if c is None else one.integers(*c) for c in columns] for _ in range(51)]
        assert (D.draw_rows(all_at_once, 51, columns) == np.array(want, float)).all()


def test_corruptions_draw_no_row_by_itself(monkeypatch):
    """One call per flake took most of a small frame's time."""
    class Counted(np.random.Generator):
        calls = 0

        def integers(self, *args, **kw):
            Counted.calls += 1
            return super().integers(*args, **kw)
    rng = Counted(np.random.PCG64(3))
    for f in (D.rain, D.snow):
        f(IMG / np.float32(255), 0.5, rng)
    assert Counted.calls == 0


@pytest.mark.parametrize("rule", ["edge", "mirror", "mirror101"])
@pytest.mark.parametrize("size", [3, 4, 11, 301])
def test_long_axes_keep_no_matrix_of_their_own(rule, size):
    from maskbench.kernels import image as I

    taps = tuple(np.arange(1.0, size + 1) / size)
    x = np.random.default_rng(0).random((517, 6, 3))
    dense = I.axis_filter.__wrapped__
    want = np.einsum("ij,jkc,lk->ilc", dense(517, taps, rule), x, dense(6, taps, rule))
    before = I.axis_filter.cache_info().currsize
    np.testing.assert_allclose(I.separable(x, taps, rule), want, rtol=1e-12)
    assert I.axis_filter.cache_info().currsize <= before + 1  # the short axis; a long one grew with its square
