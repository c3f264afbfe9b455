"""Mask, candidate, frame and flow queries over embeddings and documents."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.keys import sequence_seed
from ..kernels import degrade as D, restore as R
from ..operators import evidence, flow as fl, frames as fr, masks as mk, denominator as dn
from ..operators import grid
from ..schemas import IQA_METRICS
from . import views as V
from .registry import query, sql_hash

# ---- masks --------------------------------------------------------------------------------

_IOU = "CASE WHEN a + b - i = 0 THEN 1 ELSE i / (a + b - i) END"
_PAIR = """pr AS (SELECT p.vec_id, count(*) FILTER (p.is_on) AS a, count(*) FILTER (g.is_on) AS b, count(*) FILTER (p.is_on AND g.is_on) AS i
  FROM px p JOIN px g ON g.vec_id = p.vec_id + 1 AND g.y = p.y AND g.x = p.x GROUP BY p.vec_id)"""


@query("region_similarity", "SELECT vec_id, (" + _IOU + ")::DOUBLE AS j FROM (WITH " + _PAIR + " SELECT * FROM pr)", ["px"], "j")
def _(spark, sf):
    m, gt = V.mask_pairs(spark, sf)
    j = m.select("vec_id", "h", "w", F.col("bits").alias("p")).join(gt, "vec_id")
    return j.select("vec_id", mk.iou("p", "bits", "h", "w").alias("j"))


# Rim: set pixels with an unset 8-neighbour inside the frame; band: pixels within 1 of a rim.
_RIM = """rim AS (SELECT vec_id, y, x FROM mset m WHERE EXISTS (SELECT 1 FROM px n WHERE n.vec_id = m.vec_id AND NOT n.is_on AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1)),
 band AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM rim, range(-1, 2) a(dy), range(-1, 2) b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7)"""
_F = """fs AS (SELECT p.vec_id, CASE WHEN np = 0 AND ng = 0 THEN 1 WHEN np = 0 OR ng = 0 OR i = 0 THEN 0 ELSE 2 * (i / np) * (i / ng) / (i / np + i / ng) END AS f FROM
  (SELECT e.vec_id, count(band.y) AS np FROM embeddings e LEFT JOIN band USING (vec_id) GROUP BY 1) p JOIN
  (SELECT e.vec_id - 1 AS vec_id, count(band.y) AS ng FROM embeddings e LEFT JOIN band USING (vec_id) GROUP BY 1) g USING (vec_id) JOIN
  (SELECT e.vec_id, count(b.y) AS i FROM embeddings e LEFT JOIN (SELECT u.vec_id, u.y FROM band u JOIN band v ON v.vec_id = u.vec_id + 1 AND u.y = v.y AND u.x = v.x) b USING (vec_id) GROUP BY 1) q USING (vec_id))"""


@query("boundary_f", "SELECT vec_id, f::DOUBLE AS f FROM (WITH " + _RIM + ", " + _F + " SELECT * FROM fs)", ["mset"], "f")
def _(spark, sf):
    m, gt = V.mask_pairs(spark, sf)
    return mk.score_frames(m, gt, ["vec_id"], tol=1).select("vec_id", "f")


def _scored(spark, sf, convention="ours"):
    m, gt = V.mask_pairs(spark, sf)
    s = mk.score_frames(m, gt, ["vec_id"], tol=1, convention=convention)
    return s.withColumn("seq", F.floor(F.col("vec_id") / 16)).withColumn("frame", F.col("vec_id") % 16)


@query("frame_jf", "SELECT vec_id, j::DOUBLE AS j, f::DOUBLE AS f, ((j + f) / 2)::DOUBLE AS jf, a AS pred_area, b AS gt_area FROM (WITH " + _PAIR + ", " + _RIM + ", " + _F
       + f" SELECT vec_id, {_IOU} AS j, f, a, b FROM pr JOIN fs USING (vec_id))", ["mset"], "j f jf")
def _(spark, sf):
    return _scored(spark, sf).select("vec_id", "j", "f", "jf", "pred_area", "gt_area")


@query("sequence_scores", "SELECT seq, avg(j)::DOUBLE AS j, avg(f)::DOUBLE AS f, ((avg(j) + avg(f)) / 2)::DOUBLE AS jf, count(*) AS n_frames FROM (WITH " + _PAIR + ", " + _RIM + ", " + _F
       + f" SELECT vec_id // 16 AS seq, {_IOU} AS j, f FROM pr JOIN fs USING (vec_id) WHERE a > 0 OR b > 0) GROUP BY seq", ["mset"], "j f jf")
def _(spark, sf):
    return mk.sequence_scores(_scored(spark, sf), ["seq"])


@query("released_scores")
def _(spark, sf):
    return mk.sequence_scores(_scored(spark, sf, "released"), ["seq"], skip_empty=False)


@query("convention_table")
def _(spark, sf):
    m, gt = V.mask_pairs(spark, sf)
    m = m.select("seq", "frame", "h", "w", "bits")
    g = gt.select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("frame"), "bits")
    n = m.groupBy("seq").agg(F.count("*").alias("n_clip"))
    return mk.convention_table(m, g, ["seq", "frame"], ["seq"], n)


@query("mask_geometry", """SELECT vec_id, area, perimeter, greatest(0, x0 - 0.1 * (x1 - x0)) AS x0, greatest(0, y0 - 0.1 * (y1 - y0)) AS y0, least(7, x1 + 0.1 * (x1 - x0)) AS x1, least(7, y1 + 0.1 * (y1 - y0)) AS y1
FROM (WITH """ + _RIM + """ SELECT vec_id, count(*) AS area, min(x)::DOUBLE AS x0, max(x)::DOUBLE AS x1, min(y)::DOUBLE AS y0, max(y)::DOUBLE AS y1 FROM mset GROUP BY vec_id) JOIN
 (WITH """ + _RIM + " SELECT vec_id, count(*) AS perimeter FROM rim GROUP BY vec_id) USING (vec_id)", ["mset"], "x0 y0 x1 y1")
def _(spark, sf):
    m = V.masks8(spark, sf).withColumn("b", mk.bounding_box("bits", "h", "w", F.lit(0.1)))
    return m.select("vec_id", mk.area("bits", "h", "w").alias("area"),
                    mk.perimeter("bits", "h", "w").alias("perimeter"), "b.x0", "b.y0", "b.x1", "b.y1")


@query("box_expansion", """SELECT vec_id, greatest(0, cx - hw * 1.5) AS x0, greatest(0, cy - hh * 1.5) AS y0, least(7, cx + hw * 1.5) AS x1, least(7, cy + hh * 1.5) AS y1 FROM (
  SELECT vec_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(1, (max(x) - min(x)) / 2) AS hw, greatest(1, (max(y) - min(y)) / 2) AS hh FROM mset GROUP BY vec_id)""",
       ["mset"], "x0 y0 x1 y1")
def _(spark, sf):
    m = V.masks8(spark, sf).withColumn("b", mk.bounding_box("bits", "h", "w", F.lit(0.0)))
    e = mk.expand_box(F.col("b.x0"), F.col("b.y0"), F.col("b.x1"), F.col("b.y1"), 1.5, F.col("h"), F.col("w"))
    return m.select("vec_id", e.alias("e")).select("vec_id", "e.x0", "e.y0", "e.x1", "e.y1")


# every pixel's component is the smallest pixel that it reaches over its eight neighbours of the same kind
_REACH = """(WITH RECURSIVE reach(vec_id, is_on, seed, y, x) AS (SELECT vec_id, is_on, y * 8 + x, y, x FROM px UNION
  SELECT r.vec_id, r.is_on, r.seed, p.y, p.x FROM reach r JOIN px p ON p.vec_id = r.vec_id AND p.is_on = r.is_on AND p.y BETWEEN r.y - 1 AND r.y + 1
  AND p.x BETWEEN r.x - 1 AND r.x + 1 AND r.seed < p.y * 8 + p.x)
 SELECT vec_id, is_on, c, count(*) AS size FROM (SELECT vec_id, is_on, y, x, min(seed) AS c FROM reach GROUP BY ALL) GROUP BY ALL)"""


@query("mask_components", "SELECT vec_id, count(*) FILTER (is_on) AS n_components, coalesce(max(size) FILTER (is_on), 0) AS largest, "
       "coalesce(min(size) FILTER (is_on), 0) AS smallest, coalesce(sum(size) FILTER (is_on), 0)::BIGINT AS area, "
       "coalesce(sum(size) FILTER (is_on OR size <= 8), 0)::BIGINT AS area_filled FROM " + _REACH + " GROUP BY vec_id", ["px"])
def _(spark, sf):
    m = V.masks8(spark, sf).withColumn("c", mk.component_stats("bits", "h", "w")).withColumn(
        "filled", mk.fill_holes("bits", "h", "w", F.lit(8)))
    return m.select("vec_id", "c.n_components", "c.largest", "c.smallest", "area",
                    mk.area("filled", "h", "w").alias("area_filled"))


_LAB = "lab AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS frame, CASE WHEN v::DOUBLE > 0.1 THEN 2 WHEN v > 0 THEN 1 ELSE 0 END AS obj_id FROM px)"


def label_maps(spark, sf):
    """8x8 label maps: object 2 where the vector exceeds 0.1, object 1 where it is positive."""
    d = V.table(spark, sf, "embeddings")
    ids = F.transform("embedding", lambda x: F.when(x.cast("double") > 0.1, "02").when(
        x.cast("double") > 0, "01").otherwise("00"))
    return d.select(F.floor(F.col("vec_id") / 16).alias("seq"), (F.col("vec_id") % 16).alias("frame"),
                    F.lit(8).alias("h"), F.lit(8).alias("w"), F.unhex(F.array_join(ids, "")).alias("ids"))


@query("label_histogram", "SELECT seq, frame, obj_id, count(*) AS n_pixels FROM (WITH " + _LAB + " SELECT * FROM lab) GROUP BY ALL", ["px"])
def _(spark, sf):
    return mk.label_rows(label_maps(spark, sf))


@query("first_frame_objects", "SELECT DISTINCT seq, obj_id FROM (WITH " + _LAB + " SELECT * FROM lab) WHERE frame = 0 AND obj_id <> 0", ["px"])
def _(spark, sf):
    return grid.first_frame_objects(mk.label_rows(label_maps(spark, sf)))


@query("presence_counts", "SELECT seq, obj_id, any_value(n_clip) AS n_clip, count(DISTINCT frame) AS n_present FROM (WITH " + _LAB
       + ", n AS (SELECT vec_id // 16 AS seq, count(*) AS n_clip FROM embeddings GROUP BY 1), o AS (SELECT DISTINCT seq, obj_id FROM lab WHERE obj_id <> 0 UNION SELECT DISTINCT seq, 3 FROM lab) "
         "SELECT o.seq AS seq, o.obj_id AS obj_id, n_clip, frame FROM o LEFT JOIN lab ON o.seq = lab.seq AND o.obj_id = lab.obj_id JOIN n ON n.seq = o.seq) GROUP BY seq, obj_id", ["px"])
def _(spark, sf):
    rows = mk.label_rows(label_maps(spark, sf))
    clips = rows.groupBy("seq").agg(F.countDistinct("frame").alias("n_clip"))
    extra = clips.select("seq", F.lit(3).alias("obj_id"))
    return dn.presence_counts(rows, clips, extra)


@query("object_masks", "SELECT seq, frame, obj_id, count(*) FILTER (l = obj_id) AS area FROM (WITH " + _LAB.replace("AS obj_id FROM", "AS l FROM")
       + " SELECT seq, frame, l, t.o AS obj_id FROM lab, (VALUES (1), (2)) t(o)) GROUP BY ALL", ["px"])
def _(spark, sf):
    maps = label_maps(spark, sf)
    objs = maps.select("seq").distinct().select("seq", F.explode(F.array(F.lit(1), F.lit(2))).alias("obj_id"))
    return mk.object_masks(maps, objs).select("seq", "frame", "obj_id", "area")


# ---- candidates ---------------------------------------------------------------------------

_CAND = """cp AS (SELECT cand.seq, cand.frame, cand.op, px.y, px.x, px.is_on FROM cand JOIN px USING (vec_id)),
 anc AS (SELECT seq, frame, y, x, is_on FROM cp WHERE op = 0),
 ca AS (SELECT seq, frame, op, CASE WHEN count(*) FILTER (cp.is_on OR anc.is_on) = 0 THEN 1 ELSE count(*) FILTER (cp.is_on AND anc.is_on) / count(*) FILTER (cp.is_on OR anc.is_on) END AS a
   FROM cp JOIN anc USING (seq, frame, y, x) GROUP BY seq, frame, op),
 cc0 AS (SELECT seq, frame, p.op, q.op AS o, CASE WHEN count(*) FILTER (p.is_on OR q.is_on) = 0 THEN 1 ELSE count(*) FILTER (p.is_on AND q.is_on) / count(*) FILTER (p.is_on OR q.is_on) END AS v
   FROM cp p JOIN cp q USING (seq, frame, y, x) WHERE p.op <> q.op GROUP BY seq, frame, p.op, q.op),
 cc AS (SELECT seq, frame, op, avg(v) AS c FROM cc0 GROUP BY ALL),
 per AS (SELECT cand.seq, cand.frame, cand.op, count(r.y) AS p FROM cand LEFT JOIN (SELECT vec_id, y FROM mset m WHERE EXISTS (SELECT 1 FROM px n WHERE n.vec_id = m.vec_id AND NOT n.is_on
   AND abs(n.y - m.y) <= 1 AND abs(n.x - m.x) <= 1)) r USING (vec_id) GROUP BY ALL),
 cu AS (SELECT per.seq, per.frame, per.op, 1 - least(1, abs(per.p / greatest(q.p, 1) - 1)) AS u FROM per JOIN per q ON q.seq = per.seq AND q.frame = per.frame AND q.op = 0),
 ag AS (SELECT seq, frame, op, a::DOUBLE AS a, u::DOUBLE AS u, coalesce(c, a)::DOUBLE AS c, least(1, greatest(0, a * 0.45 / (1 + 1e-8) + coalesce(c, a) * 0.35 / (1 + 1e-8) + u * 0.2 / (1 + 1e-8)))::DOUBLE AS score
   FROM ca LEFT JOIN cc USING (seq, frame, op) JOIN cu USING (seq, frame, op)),
 de AS (SELECT *, 8 * pow(score, 2) + 1e-9 AS e FROM ag),
 db AS (SELECT *, sum(e + 1) OVER (PARTITION BY seq, frame) AS strength, e / (sum(e + 1) OVER (PARTITION BY seq, frame) + 1e-8) AS belief,
   count(*) OVER (PARTITION BY seq, frame) / (sum(e + 1) OVER (PARTITION BY seq, frame) + 1e-8) AS vacuity FROM de),
 tk AS (SELECT *, belief / (sum(belief) OVER (PARTITION BY seq, frame) + 1e-8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY seq, frame ORDER BY round(belief, 12) DESC, op) AS rank FROM db) WHERE rank <= 2)"""

FKEY = ["seq", "frame"]


def _agreement(spark, sf):
    return evidence.agreement(V.candidates8(spark, sf), V.anchors8(spark, sf), FKEY)


def _beliefs(spark, sf):
    return evidence.dirichlet(_agreement(spark, sf), FKEY)


@query("candidate_consensus", "SELECT seq, frame, op, c::DOUBLE AS c FROM (WITH " + _CAND + " SELECT * FROM cc)", ["cand", "mset"], "c")
def _(spark, sf):
    return evidence.consensus(V.candidates8(spark, sf), FKEY)


@query("agreement_scores", "SELECT * FROM (WITH " + _CAND + " SELECT seq, frame, op, a, u, c, score FROM ag)", ["cand", "mset"], "a u c score")
def _(spark, sf):
    return _agreement(spark, sf)


@query("dirichlet_evidence", "SELECT * FROM (WITH " + _CAND + " SELECT seq, frame, op, e, strength, belief, vacuity FROM db)", ["cand", "mset"], "e strength belief vacuity")
def _(spark, sf):
    return _beliefs(spark, sf).select(*FKEY, "op", "e", "strength", "belief", "vacuity")


@query("top_k_candidates", "SELECT * FROM (WITH " + _CAND + " SELECT seq, frame, op, CAST(rank AS INTEGER) AS rank, weight FROM tk)", ["cand", "mset"], "weight")
def _(spark, sf):
    return evidence.top_k(_beliefs(spark, sf), FKEY, 2).select(*FKEY, "op", "rank", "weight")


@query("fused_masks", "SELECT seq, frame, count(*) FILTER (v >= 0.5) AS area, any_value(k) AS n_fused FROM (WITH " + _CAND + """ SELECT seq, frame, y, x,
  round(sum(CASE WHEN is_on THEN weight ELSE 0 END), 9) AS v, count(*) AS k FROM cp JOIN tk USING (seq, frame, op) GROUP BY ALL) GROUP BY seq, frame""", ["cand", "mset"])
def _(spark, sf):
    top = evidence.top_k(_beliefs(spark, sf), FKEY, 2)
    c = V.candidates8(spark, sf).select(*FKEY, "op", "h", "w", "bits")
    fused = mk.fuse(top.join(c, [*FKEY, "op"]), FKEY)
    return fused.select(*FKEY, mk.area("bits", "h", "w").alias("area"), F.col("n_fused").cast("bigint").alias("n_fused"))


@query("oversized_candidate_groups", "SELECT seq, frame, count(*) AS n, count(DISTINCT op) AS n_ops FROM (SELECT seq, frame, op FROM cand UNION ALL SELECT seq, frame, op FROM cand WHERE seq % 3 = 0 AND op = 1) "
       "GROUP BY ALL HAVING count(*) > 13 OR count(*) <> count(DISTINCT op)", ["cand"])
def _(spark, sf):
    c = V.candidates8(spark, sf).select("seq", "frame", "op")
    return evidence.oversized_groups(c.unionByName(c.where("seq % 3 = 0 AND op = 1")), FKEY, len(R.NAMES))


@query("cosine_similarity", """SELECT a.vec_id, sum(x.v * y.v) / (sqrt(sum(x.v * x.v)) * sqrt(sum(y.v * y.v)) + 1e-8) AS cosine FROM embeddings a
JOIN (SELECT vec_id, y * 8 + x AS i, v::DOUBLE AS v FROM px) x USING (vec_id) JOIN (SELECT vec_id - 1 AS vec_id, y * 8 + x AS i, v::DOUBLE AS v FROM px) y ON y.vec_id = a.vec_id AND y.i = x.i GROUP BY a.vec_id""",
       ["px"], "cosine")
def _(spark, sf):
    d = V.table(spark, sf, "embeddings")
    nxt = d.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").cast("array<double>").alias("b"))
    return d.select("vec_id", F.col("embedding").cast("array<double>").alias("a")).join(nxt, "vec_id").select(
        "vec_id", evidence.cosine("a", "b").alias("cosine"))


@query("reanchor_choice", """SELECT seq, frame, -mx.nc AS candidate, mx.gain AS gain FROM (SELECT seq, frame, max(struct_pack(gain := gain, nc := -op)) AS mx FROM (
  SELECT seq, frame, op, round(0.6 * sim + 0.4 * least(a, greatest(1, r)) / greatest(a, greatest(1, r)), 12) AS gain FROM (
    SELECT cand.seq, cand.frame, cand.op, ((cand.vec_id * 37) % 101) / 101.0::DOUBLE AS sim, n.a AS a, m.a AS r FROM cand JOIN (SELECT vec_id, count(*) AS a FROM mset GROUP BY 1) n USING (vec_id)
    JOIN (SELECT cand.seq, cand.frame, count(*) AS a FROM cand JOIN mset USING (vec_id) WHERE op = 0 GROUP BY ALL) m ON m.seq = cand.seq AND m.frame = cand.frame)) GROUP BY ALL)""", ["cand", "mset"], "gain")
def _(spark, sf):
    c = V.candidates8(spark, sf)
    ref = V.anchors8(spark, sf).select(*FKEY, F.col("area").alias("ref_area"))
    c = c.join(ref, FKEY).withColumn("similarity", F.col("vec_id") * 37 % 101 / F.lit(101.0))
    return evidence.reanchor_choice(c.withColumnRenamed("op", "candidate"), FKEY)


@query("colour_descriptors")
def _(spark, sf):
    f = V.frames8(spark, sf)
    m = V.masks8(spark, sf).select(F.col("vec_id").alias("fid"), "bits")
    j = f.join(m, "fid").withColumn("d", mk.colour_descriptor("rgb", "bits", "h", "w"))
    nxt = j.select((F.col("fid") - 1).alias("fid"), F.col("d").alias("e"))
    return j.select("fid", "d").join(nxt, "fid").select("fid", evidence.cosine("d", "e").alias("similarity"))


# ---- pickers ------------------------------------------------------------------------------


@query("pick_three", """SELECT * FROM (WITH id AS (SELECT degradation, seq, obj_id, round(avg(jf) FILTER (mode = 'method') - avg(jf) FILTER (mode = 'base'), 12) AS d
  FROM rc GROUP BY ALL HAVING count(*) FILTER (mode = 'method') > 0 AND count(*) FILTER (mode = 'base') > 0),
 e AS (SELECT degradation, min(struct_pack(m := -d, seq := seq, obj_id := obj_id)) AS b, max(struct_pack(m := -d, seq := seq, obj_id := obj_id)) AS w FROM id GROUP BY degradation),
 q AS (SELECT degradation, list_sort(list(d))[count(*) // 2 + 1] AS med FROM id GROUP BY degradation),
 m AS (SELECT i.degradation, min(struct_pack(g := round(abs(i.d - q.med), 12), seq := i.seq, obj_id := i.obj_id, d := i.d)) AS m FROM id i JOIN e ON e.degradation = i.degradation
   JOIN q ON q.degradation = i.degradation WHERE NOT (i.seq = e.b.seq AND i.obj_id = e.b.obj_id) AND NOT (i.seq = e.w.seq AND i.obj_id = e.w.obj_id) GROUP BY i.degradation)
SELECT degradation, 'best' AS pick, b.seq AS seq, b.obj_id AS obj_id, -b.m AS delta FROM e UNION ALL
SELECT degradation, 'worst', w.seq, w.obj_id, -w.m FROM e UNION ALL SELECT degradation, 'median', m.m.seq, m.m.obj_id, m.m.d FROM m)""", ["rc"], "delta")
def _(spark, sf):
    c = V.cell_rows(spark, sf).groupBy("degradation", "seq", "obj_id").agg(
        (F.avg(F.when(F.col("mode") == "method", F.col("jf")))
         - F.avg(F.when(F.col("mode") == "base", F.col("jf")))).alias("d")).where(F.col("d").isNotNull())
    return evidence.pick_three(c, ["degradation"])


@query("frame_of_disagreement", """SELECT seq, obj_id, degradation, level, -b.nf AS frame, b.gap AS gap FROM (
  SELECT seq, obj_id, degradation, level, max(struct_pack(gap := round(abs(y - x), 12), nf := -frame)) AS b FROM (
  SELECT seq, obj_id, degradation, level, frame, max(jf_frame) FILTER (mode = 'base') AS x, max(jf_frame) FILTER (mode = 'memory') AS y FROM rf GROUP BY ALL)
  WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)""", ["rf"], "gap")
def _(spark, sf):
    keys = ["seq", "obj_id", "degradation", "level"]
    d = V.frame_rows(spark, sf).groupBy(*keys, "frame").agg(
        (F.max(F.when(F.col("mode") == "memory", F.col("jf_frame")))
         - F.max(F.when(F.col("mode") == "base", F.col("jf_frame")))).alias("d")).where(F.col("d").isNotNull())
    return evidence.frame_of_disagreement(d, keys)


@query("trajectory_choice", """SELECT degradation, b.seq AS seq, b.obj_id AS obj_id, b.n AS n_decisions FROM (SELECT degradation, max(struct_pack(n := n, seq := seq, obj_id := obj_id)) AS b FROM (
  SELECT degradation, seq, obj_id, CAST(sum(is_keyframe) AS BIGINT) AS n FROM rf GROUP BY ALL) WHERE n > 0 GROUP BY degradation)""", ["rf"])
def _(spark, sf):
    return evidence.trajectory_choice(V.frame_rows(spark, sf), ["seq", "obj_id"], within=["degradation"])


# ---- severity and seeds -------------------------------------------------------------------

_PI2 = repr(2 * math.pi)


@query("severity_schedule", f"""SELECT seq, level, avg(s) AS severity_mean, max(s) AS severity_max, min(s) AS severity_min, count(*) AS n FROM (
  SELECT seq, level, least(5, greatest(1, level * (1 + 0.3::DOUBLE * sin({_PI2}::DOUBLE * frame / greatest(8, n // 2)::DOUBLE + {sql_hash('seed', "'phase'")} / 4294967296.0::DOUBLE * {_PI2}::DOUBLE)))) AS s FROM (
    SELECT seq, frame, n, 0 + {sql_hash('seq')} % 100000 AS seed FROM (SELECT inst AS seq, frame, count(*) OVER (PARTITION BY inst) AS n FROM gf)), (VALUES (1.0::DOUBLE), (3.0::DOUBLE), (5.0::DOUBLE)) t(level))
GROUP BY seq, level""", ["gf"], "severity_mean severity_max severity_min")
def _(spark, sf):
    d = V.gate_frames(spark, sf).select(F.col("inst").alias("seq"), "frame")
    n = d.groupBy("seq").agg(F.count("*").alias("n"))
    d = d.join(n, "seq").select("*", sequence_seed("seq").alias("seed"),
                                F.explode(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0))).alias("level"))
    s = fr.severity_schedule("level", "frame", "n", "seed", phase="md5")
    return d.groupBy("seq", "level").agg(
        F.avg(s).alias("severity_mean"), F.max(s).alias("severity_max"),
        F.min(s).alias("severity_min"), F.count("*").alias("n"))


@query("severity_normalised", "SELECT p_size, avg((least(5, greatest(1, p_size / 8)) - 1) / 4) AS s, count(*) AS n FROM part GROUP BY p_size", floats="s")
def _(spark, sf):
    d = V.table(spark, sf, "part")
    return d.groupBy("p_size").agg(F.avg(fr.severity_scaled(F.col("p_size") / 8)).alias("s"),
                                   F.count("*").alias("n"))


@query("stable_seeds", f"""SELECT p_partkey, p_name, 7 + {sql_hash('p_name')} % 100000 AS seq_seed, (7 + {sql_hash('p_name')} % 100000) * 1000003 + p_partkey AS frame_seed FROM part""")
def _(spark, sf):
    d = V.table(spark, sf, "part").select("p_partkey", "p_name", sequence_seed("p_name", 7).alias("seq_seed"))
    return d.withColumn("frame_seed", fr.stream_seed("seq_seed", "p_partkey"))


# ---- corruption, restoration, quality -----------------------------------------------------


def _digest(df, keys):
    """Per group: frames, mean pixel and a digest sum, so that pixels are checked, not shipped."""
    px = F.conv(F.substring(F.md5("rgb"), 1, 8), 16, 10).cast("bigint")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.length("rgb")).alias("bytes"),
                                 (F.sum(px) % 1_000_000_007).alias("digest"))


def _degradation(name: str) -> None:
    @query(f"degrade_{name.lower()}")
    def _(spark, sf):
        d = fr.degrade_frames(V.text_frames(spark, sf), name, 3.0)
        return _digest(d, ["seq"])


for _name in [*D.SINGLES, *D.COMPOUNDS]:
    _degradation(_name)


@query("degraded_sequences")
def _(spark, sf):
    cond = [("clean", 1.0), ("fog", 2.0), ("C1_fog_noise", 3.0)]
    d = fr.degraded_sequences(V.text_frames(spark, sf), cond, stride=2)
    return d.groupBy("seq", "degradation", "level").agg(
        F.count("*").alias("n"), F.avg("severity").alias("severity_mean"),
        F.max("severity").alias("severity_max"),
        (F.sum(F.conv(F.substring(F.md5("rgb"), 1, 8), 16, 10).cast("bigint")) % 1_000_000_007).alias("digest"))


@query("restoration_bank")
def _(spark, sf):
    return _digest(fr.restore_frames(V.text_frames(spark, sf)), ["op", "op_name"])


@query("iqa_panel")
def _(spark, sf):
    d = V.text_frames(spark, sf).withColumn("clean", F.col("rgb"))
    d = fr.degrade_frames(d, "sensor_noise", 3.0)
    q = fr.with_iqa(d, "clean")
    return q.groupBy("seq").agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in IQA_METRICS])


_GRAY = """gy AS (SELECT fid, y, x, (299 * r + 587 * g + 114 * b + 500) // 1000 AS v, r, g, b FROM (SELECT fid, y, x, max(u) FILTER (ch = 0) AS r,
  max(u) FILTER (ch = 1) AS g, max(u) FILTER (ch = 2) AS b FROM fpx GROUP BY ALL))"""


@query("iqa_no_reference", "SELECT g.fid AS fid, iqa_contrast, iqa_entropy, iqa_dark_channel, iqa_saturation FROM (WITH " + _GRAY + """ SELECT fid, stddev_pop(v) AS iqa_contrast,
  avg(floor((greatest(r, g, b) - least(r, g, b)) * 255.0::DOUBLE / greatest(r, g, b, 1) + 0.5)) / 255 AS iqa_saturation, min(least(r, g, b)) / 255.0::DOUBLE AS iqa_dark_channel FROM gy GROUP BY fid) g JOIN
 (WITH """ + _GRAY + """ SELECT fid, -sum(p * log2(p)) AS iqa_entropy FROM (SELECT fid, v, count(*) / (64 + 1e-8::DOUBLE) AS p FROM gy GROUP BY fid, v) GROUP BY fid) e USING (fid)""",
       ["fpx"], "iqa_contrast iqa_entropy iqa_dark_channel iqa_saturation")
def _(spark, sf):
    q = fr.with_iqa(V.frames8(spark, sf))
    return q.select("fid", "iqa_contrast", "iqa_entropy", "iqa_dark_channel", "iqa_saturation")


@query("iqa_psnr", """SELECT a.fid AS fid, CASE WHEN avg((a.u - b.u) * (a.u - b.u)) = 0 THEN 99 ELSE 10 * log10(65025.0::DOUBLE / avg((a.u - b.u) * (a.u - b.u))) END AS iqa_psnr
FROM fpx a JOIN fpx b ON b.fid = a.fid + 1 AND a.ch = b.ch AND a.y = b.y AND a.x = b.x GROUP BY a.fid""", ["fpx"], "iqa_psnr")
def _(spark, sf):
    f = V.frames8(spark, sf)
    nxt = f.select((F.col("fid") - 1).alias("fid"), F.col("rgb").alias("clean"))
    return fr.with_iqa(f.join(nxt, "fid"), "clean").select("fid", "iqa_psnr")


@query("iqa_instance_join", "SELECT obj_id, count(*) AS n, avg(c) AS iqa_contrast FROM (WITH " + _GRAY + """ SELECT fid, stddev_pop(v) AS c FROM gy GROUP BY fid),
  (VALUES (1), (2)) t(obj_id) GROUP BY obj_id""", ["fpx"], "iqa_contrast")
def _(spark, sf):
    q = fr.with_iqa(V.frames8(spark, sf))
    inst = V.frames8(spark, sf).select("fid", F.explode(F.array(F.lit(1), F.lit(2))).alias("obj_id"))
    return fr.iqa_for_instances(inst, q, ["fid"]).groupBy("obj_id").agg(
        F.count("*").alias("n"), F.avg("iqa_contrast").alias("iqa_contrast"))


@query("resize_frames", "SELECT fid, avg(u2) AS mean FROM (SELECT fid, ch, y // 2 AS y, x // 2 AS x, floor(avg(u) + 0.5) AS u2 FROM fpx GROUP BY ALL) GROUP BY fid", ["fpx"], "mean")
def _(spark, sf):
    d = fr.resize_frames(V.frames8(spark, sf), 4, 4)
    hexs = F.sequence(F.lit(0), F.lit(47))
    vals = F.transform(hexs, lambda i: F.conv(F.substring(F.hex("rgb"), i * 2 + 1, F.lit(2)), 16, 10).cast("double"))
    return d.select("fid", (F.aggregate(vals, F.lit(0.0), lambda s, v: s + v) / 48).alias("mean"))


@query("resize_labels", "SELECT vec_id // 16 AS seq, vec_id % 16 AS frame, count(*) FILTER (v::DOUBLE > 0 AND v::DOUBLE <= 0.1) AS n1, count(*) FILTER (v::DOUBLE > 0.1) AS n2 FROM px WHERE y % 2 = 0 AND x % 2 = 0 GROUP BY ALL", ["px"])
def _(spark, sf):
    rows = mk.label_rows(fr.resize_labels(label_maps(spark, sf), 4, 4))
    n = lambda k: F.coalesce(F.sum(F.when(F.col("obj_id") == k, F.col("n_pixels"))), F.lit(0))
    return rows.groupBy("seq", "frame").agg(n(1).alias("n1"), n(2).alias("n2"))


def _bright_masks(spark, sf):
    """Masks of each 8x8 frame: its pixels with a positive first channel."""
    m = V.masks8(spark, sf).where("vec_id % 3 = 0").select(
        F.floor(F.col("vec_id") / 3).alias("fid"), "bits", "h", "w", "area")
    return m.select(F.floor(F.col("fid") / 16).cast("string").alias("seq"), (F.col("fid") % 16).alias("frame"),
                    F.lit(1).alias("obj_id"), "h", "w", "bits", "area")


@query("mask_alignment_profile")
def _(spark, sf):
    return fr.alignment_profile(V.frames8(spark, sf), _bright_masks(spark, sf))


@query("mask_alignment_control")
def _(spark, sf):
    f, m = V.frames8(spark, sf), _bright_masks(spark, sf)
    return fr.alignment_win_rate(f, m, 1, 0).unionByName(fr.alignment_win_rate(f, m, 1, 1))


# ---- supplied flow ------------------------------------------------------------------------


CLIP = 24  # frames of a clip here: long enough for the table's step 20


def flow_fields(spark, sf, sign: float = 1.0):
    """The flow of each 8x8 frame, read from its second and third channel: a step of -1, 0 or 1 in x and y per pixel."""
    word = {1.0: "0000803F", 0.0: "00000000", -1.0: "000080BF"}

    def step(v):
        v = v.cast("double")
        return F.when(v > 0.1, word[sign]).when(v < -0.1, word[-sign]).otherwise(word[0.0])
    pick = lambda k: F.max(F.when(F.col("vec_id") % 3 == k, F.col("embedding"))).alias(f"c{k}")
    f = V.table(spark, sf, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("fid")).agg(pick(1), pick(2), F.count("*").alias("k")).where("k = 3")
    words = F.zip_with("c1", "c2", lambda a, b: F.concat(step(a), step(b)))
    return f.select("fid", F.floor(F.col("fid") / CLIP).cast("string").alias("seq"), (F.col("fid") % CLIP).alias("frame"), F.lit(8).alias("h"),
                    F.lit(8).alias("w"), F.unhex(F.array_join(words, "")).alias("flow"))


def _tracked_masks(spark, sf):
    """Masks of the first channel in clips of CLIP frames; small ones count as missing."""
    m = V.masks8(spark, sf).where("vec_id % 3 = 0 and area >= 30").withColumn("fid", F.floor(F.col("vec_id") / 3))
    return m.select(F.floor(F.col("fid") / CLIP).cast("string").alias("seq"), (F.col("fid") % CLIP).alias("frame"), F.lit(1).alias("obj_id"),
                    "h", "w", "bits", "area")


# pixels of the masks, the pixel that each pixel's value comes from, and the masks carried from frame 0, pixel by pixel
_FLOW_SQL = f"""WITH RECURSIVE e AS (SELECT vec_id, vec_id // 3 AS fid, vec_id % 3 AS ch, embedding FROM embeddings),
v AS (SELECT fid, ch, t.i AS p, embedding[t.i + 1]::DOUBLE AS v FROM e, range(64) t(i)),
truth AS (SELECT (fid // {CLIP})::VARCHAR AS seq, fid % {CLIP} AS frame, p FROM v WHERE ch = 0 AND v > 0
          AND fid IN (SELECT fid FROM v WHERE ch = 0 AND v > 0 GROUP BY fid HAVING count(*) >= 30)),
size AS (SELECT seq, frame, count(*) AS area FROM truth GROUP BY ALL),
d AS (SELECT x.fid, x.p, CASE WHEN x.v > 0.1::DOUBLE THEN 1 WHEN x.v < -0.1::DOUBLE THEN -1 ELSE 0 END AS dx,
      CASE WHEN y.v > 0.1::DOUBLE THEN 1 WHEN y.v < -0.1::DOUBLE THEN -1 ELSE 0 END AS dy
      FROM v x JOIN v y ON x.fid = y.fid AND x.p = y.p AND x.ch = 1 AND y.ch = 2 WHERE x.fid IN (SELECT fid FROM e WHERE ch = 0)),
src AS (SELECT (fid // {CLIP})::VARCHAR AS seq, fid % {CLIP} AS frame, p,
        8 * greatest(0, least(7, p // 8 - dy)) + greatest(0, least(7, p % 8 - dx)) AS q,
        p // 8 - dy BETWEEN 0 AND 7 AND p % 8 - dx BETWEEN 0 AND 7 AS inside FROM d),
chain AS (SELECT seq, frame, p FROM truth WHERE frame = 0 UNION ALL
          SELECT s.seq, s.frame + 1, s.p FROM chain c JOIN src s ON s.seq = c.seq AND s.frame = c.frame AND s.q = c.p)"""


@query("flow_direction_audit")
def _(spark, sf):
    return fl.flow_direction_audit(_tracked_masks(spark, sf), flow_fields(spark, sf), ["seq", "obj_id"])


@query("flow_chain_table", _FLOW_SQL + """,
made AS (SELECT DISTINCT s.seq, s.frame + 1 AS frame FROM src s JOIN size z ON z.seq = s.seq AND z.frame = 0),
n AS (SELECT m.seq, m.frame, z.area, (SELECT count(*) FROM chain c WHERE c.seq = m.seq AND c.frame = m.frame) AS pred,
      (SELECT count(*) FROM chain c JOIN truth t USING (seq, frame, p) WHERE c.seq = m.seq AND c.frame = m.frame) AS common
      FROM made m JOIN size z USING (seq, frame)),
r AS (SELECT *, pred / area AS ratio, common / (pred + area - common) AS iou FROM n)
SELECT seq, 1 AS obj_id, count(r.frame) AS n, max(ratio) FILTER (frame = 1) AS ratio_1, max(ratio) FILTER (frame = 20) AS ratio_20,
  max(ratio) AS ratio_max, max(iou) FILTER (frame = 1) AS iou_1, max(iou) FILTER (frame = 10) AS iou_10, max(iou) FILTER (frame = 20) AS iou_20,
  arg_max(iou, frame) AS iou_last, min(iou) AS iou_min, count(*) FILTER (ratio > 3) AS n_inflated, count(*) FILTER (iou < 0.5) AS n_lost
FROM (SELECT DISTINCT seq FROM truth) LEFT JOIN r USING (seq) GROUP BY seq""",
       floats="ratio_1 ratio_20 ratio_max iou_1 iou_10 iou_20 iou_last iou_min")
def _(spark, sf):
    return fl.chain_table(_tracked_masks(spark, sf), flow_fields(spark, sf), ["seq", "obj_id"])


@query("flow_warp", _FLOW_SQL + """
SELECT s.seq, s.frame, any_value(area) AS area, count(t.p) AS area_warped, count(t.p) FILTER (inside) / any_value(area) AS inside
FROM src s JOIN size z ON z.seq = s.seq AND z.frame = s.frame LEFT JOIN truth t ON t.seq = s.seq AND t.frame = s.frame AND t.p = s.q GROUP BY s.seq, s.frame""",
       floats="inside")
def _(spark, sf):
    j = _tracked_masks(spark, sf).join(flow_fields(spark, sf).select("seq", "frame", "flow"), ["seq", "frame"])
    j = j.withColumn("warped", fl.warp_mask("bits", "flow", "h", "w", F.lit(1.0)))
    return j.select("seq", "frame", "area", mk.area("warped", "h", "w").alias("area_warped"),
                    fl.inside_fraction("bits", "flow", "h", "w").alias("inside"))


@query("flow_soft_chain", _FLOW_SQL + """
SELECT s.seq, count(DISTINCT s.frame) AS n, max(s.frame) + 1 AS last_frame, sum(CASE WHEN c.p IS NULL THEN 0 ELSE 1 END)::DOUBLE AS mass
FROM src s JOIN size z ON z.seq = s.seq AND z.frame = 0 LEFT JOIN chain c ON c.seq = s.seq AND c.frame = s.frame + 1 AND c.p = s.p GROUP BY s.seq""",
       floats="mass")
def _(spark, sf):
    word = lambda x: F.when(x.cast("double") > 0, "0000803F").otherwise("00000000")
    soft = V.table(spark, sf, "embeddings").where("vec_id % 3 = 0").select(
        F.floor(F.col("vec_id") / 3).alias("fid"), F.unhex(F.array_join(F.transform("embedding", word), "")).alias("soft"))
    m = _tracked_masks(spark, sf).drop("bits").join(soft.select(
        F.floor(F.col("fid") / CLIP).cast("string").alias("seq"), (F.col("fid") % CLIP).alias("frame"), "soft"), ["seq", "frame"])
    p = fl.propagate(m, flow_fields(spark, sf), ["seq", "obj_id"], soft=True)
    return p.groupBy("seq").agg(F.count("*").alias("n"), F.max("frame").alias("last_frame"), F.sum(fl.soft_mass("soft")).alias("mass"))


@query("flow_cycle_error")
def _(spark, sf):
    a = flow_fields(spark, sf)
    b = flow_fields(spark, sf, -1.0).select("fid", F.col("flow").alias("back"))
    return a.join(b, "fid").select("fid", fl.cycle_error("flow", "back", "h", "w").alias("error"))
