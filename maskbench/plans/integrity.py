"""Merging, guards, reconciliation and denominators over the result views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import number_chunk
from ..operators import collapse, denominator as dn, gaps, guards, merge, stats
from . import views as V
from .registry import query

KEY = ["seq", "obj_id", "mode", "degradation", "level", "frame"]

# Three overlapping chunks: rows of clips 0-39 %, 30-69 % and 60-99 % by order; the overlap
# agrees, except that half of its clips were scored differently in the last chunk.
_CHUNK_SQL = """ch AS (SELECT 'a' AS src, seq, obj_id, mode, degradation, level, frame, jf_frame FROM rf WHERE seq % 10 < 4 UNION ALL
 SELECT 'b', seq, obj_id, mode, degradation, level, frame, jf_frame FROM rf WHERE seq % 10 BETWEEN 3 AND 6 UNION ALL
 SELECT 'c', seq, obj_id, mode, degradation, level, frame, jf_frame + CASE WHEN seq % 20 = 16 THEN 0.25 ELSE 0 END FROM rf WHERE seq % 10 >= 6)"""


def chunks(spark, sf):
    d = V.frame_rows(spark, sf).select(*KEY, "jf_frame")
    part = F.col("seq") % 10
    shift = F.when(F.col("seq") % 20 == 16, 0.25).otherwise(0.0)
    return merge.union_chunks(
        [d.where(part < 4), d.where(part.between(3, 6)),
         d.where(part >= 6).withColumn("jf_frame", F.col("jf_frame") + shift)], ["a", "b", "c"])


@query("chunk_union", "SELECT src, count(*) AS n, avg(jf_frame) AS jf FROM (WITH " + _CHUNK_SQL + " SELECT * FROM ch) GROUP BY src", ["rf"], "jf")
def _(spark, sf):
    return chunks(spark, sf).groupBy("src").agg(F.count("*").alias("n"), F.avg("jf_frame").alias("jf"))


@query("duplicate_report", "SELECT count(*) AS distinct_rows, CAST(sum(CASE WHEN lo = hi THEN n - 1 ELSE 0 END) AS BIGINT) AS agreed, count(*) FILTER (lo <> hi) AS conflicts FROM (WITH "
       + _CHUNK_SQL + " SELECT seq, obj_id, mode, degradation, level, frame, count(*) AS n, min(jf_frame) AS lo, max(jf_frame) AS hi FROM ch GROUP BY ALL)", ["rf"])
def _(spark, sf):
    return merge.duplicate_report(chunks(spark, sf), KEY, ["jf_frame"])


@query("duplicate_conflicts", "SELECT seq, obj_id, mode, degradation, level, frame, count(*) AS n_rows FROM (WITH " + _CHUNK_SQL
       + " SELECT * FROM ch) GROUP BY ALL HAVING min(jf_frame) <> max(jf_frame)", ["rf"])
def _(spark, sf):
    return merge.conflicts(chunks(spark, sf), KEY, ["jf_frame"])


@query("merged_chunks", "SELECT mode, count(*) AS n, avg(jf_frame) AS jf FROM (WITH " + _CHUNK_SQL
       + " SELECT DISTINCT seq, obj_id, mode, degradation, level, frame, jf_frame FROM ch WHERE src <> 'c') GROUP BY mode", ["rf"], "jf")
def _(spark, sf):
    d = chunks(spark, sf).where(F.col("src") != "c").drop("src")
    m = merge.merge_chunks(d, KEY, ["jf_frame"])
    return m.groupBy("mode").agg(F.count("*").alias("n"), F.avg("jf_frame").alias("jf"))


# Killed sweep: the last frame of some cells is missing although the cell declares it.
_TORN_SQL = """dl AS (SELECT *, count(*) OVER (PARTITION BY seq, obj_id, mode, degradation, level) AS n_frames FROM rf),
 torn AS (SELECT * FROM dl WHERE NOT (seq % 9 = 0 AND level = 2 AND frame = n_frames - 1))"""


def torn_rows(spark, sf):
    d = V.frame_rows(spark, sf)
    inst = ["seq", "obj_id", "mode", "degradation", "level"]
    n = d.groupBy(*inst).agg(F.count("*").alias("n_frames"))
    d = d.join(n, inst)
    return d.where(~((F.col("seq") % 9 == 0) & (F.col("level") == 2)
                     & (F.col("frame") == F.col("n_frames") - 1)))


_BAD_SQL = ("SELECT seq, mode, degradation, level, count(*) AS n_bad_instances FROM (SELECT seq, obj_id, mode, degradation, level FROM torn GROUP BY ALL "
            "HAVING count(*) <> max(n_frames)) GROUP BY ALL")


@query("partial_cells", "SELECT * FROM (WITH " + _TORN_SQL + " " + _BAD_SQL + ")", ["rf"])
def _(spark, sf):
    return merge.partial_cells(torn_rows(spark, sf), ["seq", "obj_id", "mode", "degradation", "level"])


@query("trim_partial_cells", "SELECT mode, count(*) AS n, avg(jf_frame) AS jf FROM (WITH " + _TORN_SQL + " SELECT torn.* FROM torn ANTI JOIN (" + _BAD_SQL
       + ") USING (seq, mode, degradation, level)) GROUP BY mode", ["rf"], "jf")
def _(spark, sf):
    d = merge.trim_partial(torn_rows(spark, sf), ["seq", "obj_id", "mode", "degradation", "level"])
    return d.groupBy("mode").agg(F.count("*").alias("n"), F.avg("jf_frame").alias("jf"))


_CELL = "seq, obj_id, degradation, level"


@query("universe_difference", f"""SELECT {_CELL}, 'missing' AS side FROM (SELECT {_CELL} FROM rc WHERE mode = 'base' EXCEPT SELECT {_CELL} FROM rc WHERE mode = 'memory')
UNION ALL SELECT {_CELL}, 'extra' FROM (SELECT {_CELL} FROM rc WHERE mode = 'memory' EXCEPT SELECT {_CELL} FROM rc WHERE mode = 'base')""", ["rc"])
def _(spark, sf):
    c = V.cell_rows(spark, sf)
    return merge.set_difference(c.where(F.col("mode") == "base"), c.where(F.col("mode") == "memory"),
                                ["seq", "obj_id", "degradation", "level"])


def published(spark, sf):
    """Stand-in for a shipped table: some cells are missing, some differ in the sixth digit."""
    c = V.cell_rows(spark, sf).where(F.col("seq") % 13 != 5)
    return c.withColumn("jf", F.col("jf") + F.when(F.col("seq") % 11 == 3, 2e-6).otherwise(0.0))


_PUB = "pub AS (SELECT * REPLACE (jf + CASE WHEN seq % 11 = 3 THEN 2e-6 ELSE 0 END AS jf) FROM rc WHERE seq % 13 <> 5)"


@query("reconciliation", "SELECT mode, degradation, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS matched, count(*) FILTER (b IS NULL) AS only_recomputed, "
       "count(*) FILTER (a IS NULL) AS only_published, max(abs(a - b)) AS max_diff_jf, max(abs(na - nb)) AS max_diff_n_frames FROM (WITH " + _PUB
       + " SELECT mode, degradation, x.jf AS a, pub.jf AS b, x.n_frames AS na, pub.n_frames AS nb FROM (SELECT * FROM rc WHERE seq % 7 <> 2) x FULL JOIN pub "
         "USING (seq, obj_id, mode, degradation, level)) GROUP BY ALL", ["rc"], "max_diff_jf")
def _(spark, sf):
    mine = V.cell_rows(spark, sf).where(F.col("seq") % 7 != 2)
    return merge.reconcile(mine, published(spark, sf), ["seq", "obj_id", "mode", "degradation", "level"],
                           ["jf", "n_frames"], ["mode", "degradation"])


# ---- guards -------------------------------------------------------------------------------


@query("grid_completeness", """SELECT seq, mode, degradation, level, coalesce(n_rows, 0) AS n_rows, coalesce(n_instances, 0) AS n_instances, coalesce(n_sequences, 0) AS n_sequences,
  CASE WHEN n_rows IS NULL THEN 'missing cell' ELSE 'wrong instance count' END AS violation FROM
 (SELECT seq, mode, degradation, level FROM (SELECT DISTINCT seq FROM rows_raw), (VALUES ('clean'), ('fog'), ('noise'), ('fog_noise'), ('blur')) d(degradation),
  (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) l(level), (VALUES ('base'), ('method'), ('memory')) m(mode)) LEFT JOIN
 (SELECT seq, mode, degradation, level, count(*) AS n_rows, count(DISTINCT obj_id) AS n_instances, count(DISTINCT seq) AS n_sequences FROM rc GROUP BY ALL)
 USING (seq, mode, degradation, level) WHERE n_rows IS NULL OR n_instances <> 2""", ["rc"])
def _(spark, sf):
    from ..operators.grid import cell_grid
    c = V.cell_rows(spark, sf)
    g = cell_grid(c.select("seq").distinct(), V.DEGRADATIONS, V.LEVELS, V.MODES)
    v = guards.grid_violations(g.select("seq", "mode", "degradation", "level"), c.withColumn("clip", F.col("seq")),
                               ["seq", "mode", "degradation", "level"], instances=2, seq="clip")
    return v


@query("structural_audit", """SELECT mode, count(*) AS rows, count(DISTINCT (seq, obj_id, degradation, level)) AS distinct_keys, count(DISTINCT level) AS levels,
  count(DISTINCT degradation) AS degradations, count(*) FILTER (NOT (jf BETWEEN 0 AND 1)) AS bad_range,
  count(*) FILTER (degradation = 'clean' AND abs(severity_mean - 1) >= 1e-9) AS bad_severity, count(*) FILTER (degradation = 'clean' AND n_predict_failures > 0) AS clean_failures
FROM rc GROUP BY mode""", ["rc"])
def _(spark, sf):
    return guards.structural_audit(V.cell_rows(spark, sf))


@query("arm_universe", f"SELECT seq, obj_id, degradation, level, count(DISTINCT mode) AS n_arms FROM rc GROUP BY {_CELL} HAVING count(DISTINCT mode) < 3", ["rc"])
def _(spark, sf):
    return guards.universe_differences(V.cell_rows(spark, sf), "mode", V.MODES,
                                       ["seq", "obj_id", "degradation", "level"])


# Arms A5 and A6 of the fog phase are replaced by copies of A0: settings that never took effect.
_NOOP = """fx AS (SELECT degradation, seq, obj_id, arm, jf FROM abl_cells WHERE NOT (degradation = 'fog' AND arm IN ('A5', 'A6')) UNION ALL
  SELECT degradation, seq, obj_id, t.arm, jf FROM abl_cells, (VALUES ('A5'), ('A6')) t(arm) WHERE degradation = 'fog' AND abl_cells.arm = 'A0'),
 p AS (SELECT y.degradation, y.arm AS method, x.jf AS a, y.jf AS b FROM fx x JOIN fx y USING (degradation, seq, obj_id) WHERE x.arm = 'A0' AND y.arm <> 'A0')"""


def _arm_pairs(spark, sf):
    c = V.ablation_cells(spark, sf).select("degradation", "seq", "obj_id", "arm", "jf")
    copy = c.where("degradation = 'fog' AND arm = 'A0'").drop("arm").withColumn(
        "arm", F.explode(F.array(F.lit("A5"), F.lit("A6")))).select(*c.columns)
    c = c.where("NOT (degradation = 'fog' AND arm IN ('A5', 'A6'))").unionByName(copy)
    return stats.paired_values(c, ["degradation", "seq", "obj_id"], "arm", "jf", "A0",
                               [f"A{i}" for i in range(1, 7)])


@query("noop_arms", "SELECT degradation, method, count(*) AS n, count(*) FILTER (a <> b) AS n_changed, max(abs(a - b)) AS max_change FROM (WITH " + _NOOP
       + " SELECT * FROM p) GROUP BY ALL HAVING count(*) FILTER (a <> b) = 0", ["abl_cells"], "max_change")
def _(spark, sf):
    return guards.noop_arms(_arm_pairs(spark, sf), ["degradation", "method"])


@query("arm_effect", "SELECT degradation, method, count(*) AS n, count(*) FILTER (a <> b) AS n_changed, max(abs(a - b)) AS max_change FROM (WITH " + _NOOP
       + " SELECT * FROM p) GROUP BY ALL", ["abl_cells"], "max_change")
def _(spark, sf):
    return guards.arm_effect(_arm_pairs(spark, sf), ["degradation", "method"])


@query("reference_drift", "SELECT seq, obj_id, mode, degradation, level, rc.jf AS got, pub.jf AS want, abs(rc.jf - pub.jf) AS diff FROM rc LEFT JOIN "
       "(WITH " + _PUB + " SELECT * FROM pub) pub USING (seq, obj_id, mode, degradation, level) WHERE pub.jf IS NULL OR abs(rc.jf - pub.jf) > 1e-6",
       ["rc"], "got want diff")
def _(spark, sf):
    return guards.reference_drift(V.cell_rows(spark, sf), published(spark, sf),
                                  ["seq", "obj_id", "mode", "degradation", "level"], "jf")


@query("replay_fingerprint", """SELECT seq, degradation, level, CASE WHEN m1.seq IS NOT NULL AND m2.seq IS NOT NULL THEN greatest(abs(m1.m - m2.m), abs(m1.x - m2.x)) END AS max_diff FROM
 (SELECT seq, degradation, level, max(severity_mean) AS m, max(severity_max) AS x FROM rc WHERE mode = 'base' GROUP BY ALL) m1 FULL JOIN
 (SELECT seq, degradation, level, max(severity_mean) AS m, max(severity_max) AS x FROM rc WHERE mode = 'method' GROUP BY ALL) m2 USING (seq, degradation, level)
WHERE m1.seq IS NULL OR m2.seq IS NULL OR greatest(abs(m1.m - m2.m), abs(m1.x - m2.x)) > 1e-5""", ["rc"], "max_diff")
def _(spark, sf):
    def cells(m):
        return V.cell_rows(spark, sf).where(F.col("mode") == m).groupBy("seq", "degradation", "level").agg(
            F.max("severity_mean").alias("severity_mean"), F.max("severity_max").alias("severity_max"))
    return guards.replay_drift(cells("base"), cells("method"), ["seq", "degradation", "level"])


@query("collapse_cross_check", "SELECT mode, degradation, level, va, vb FROM (SELECT mode, degradation, level, avg(jf) AS va FROM cl GROUP BY ALL) JOIN "
       "(SELECT mode, degradation, level, avg(jf) AS vb FROM rc GROUP BY ALL) USING (mode, degradation, level) WHERE abs(va - vb) > 1e-12", ["cl"], "va vb")
def _(spark, sf):
    keys = ["mode", "degradation", "level"]
    a = collapse.group_mean(V.clip_rows(spark, sf), keys).withColumnRenamed("jf_mean", "jf")
    b = collapse.group_mean(V.cell_rows(spark, sf), keys).withColumnRenamed("jf_mean", "jf")
    return guards.collapse_disagreement(a, b, keys)


@query("gap_blocks_identical", """SELECT x.s AS s1, y.s AS s2, max(abs(x.gap - y.gap)) AS max_diff FROM (WITH c AS (SELECT degradation, level, mode, jf FROM cl UNION ALL
  SELECT degradation, level, 'copy', jf FROM cl WHERE mode = 'base'), g AS (SELECT degradation, level, t.s AS s, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = t.s) AS gap
  FROM c, (VALUES ('base'), ('copy'), ('method')) t(s) GROUP BY ALL) SELECT * FROM g) x JOIN (WITH c AS (SELECT degradation, level, mode, jf FROM cl UNION ALL
  SELECT degradation, level, 'copy', jf FROM cl WHERE mode = 'base'), g AS (SELECT degradation, level, t.s AS s, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = t.s) AS gap
  FROM c, (VALUES ('base'), ('copy'), ('method')) t(s) GROUP BY ALL) SELECT * FROM g) y ON x.degradation = y.degradation AND x.level = y.level AND x.s < y.s
GROUP BY ALL HAVING round(max(abs(x.gap - y.gap)), 12) = 0""", ["cl"], "max_diff")
def _(spark, sf):
    c = V.clip_rows(spark, sf).select("degradation", "level", "mode", "jf")
    copy = c.where(F.col("mode") == "base").withColumn("mode", F.lit("copy"))
    g = gaps.severity_gaps(c.unionByName(copy), "memory", ["base", "copy", "method"])
    return gaps.gap_blocks_identical(g.withColumn("gap", F.round("gap", 12)))


def _digest_sql(keys: str, part: str, order: str, value: str, table: str) -> str:
    word = lambda j: f"printf('%08x', (sum(CAST('0x' || substr(h, {8 * j + 1}, 8) AS BIGINT)) % 4294967296)::BIGINT)"
    return (f"SELECT {keys}, count(*) AS n, {' || '.join(word(j) for j in range(4))} AS digest FROM (SELECT *, md5(concat_ws('|', row_number() OVER "
            f"(PARTITION BY {part} ORDER BY {order}) - 1, printf('%.9g', {value}))) AS h FROM {table}) GROUP BY {part}")


@query("series_digest", _digest_sql("o_orderstatus AS status, o_custkey", "o_orderstatus, o_custkey", "o_orderkey", "o_totalprice", "orders"))
def _(spark, sf):
    d = V.table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")
    return guards.series_digest(d, ["status", "o_custkey"], ["o_orderkey"], number_chunk("o_orderkey"), "o_totalprice")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


@query("series_digest_blocks", _digest_sql("l_returnflag AS flag", "l_returnflag", ", ".join(_LINE_ORDER), "l_quantity", "lineitem"))
def _(spark, sf):
    d = V.table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return guards.series_digest(d, ["flag"], _LINE_ORDER, number_chunk("l_orderkey"), "l_quantity")


@query("profile_checks", """SELECT "check", subject, value FROM (
 SELECT 'mixed conditions' AS "check", '' AS subject, (count(DISTINCT degradation) * count(DISTINCT level))::DOUBLE AS value FROM prof HAVING count(DISTINCT degradation) > 1 OR count(DISTINCT level) > 1
 UNION ALL SELECT DISTINCT 'clip length', CAST(seq AS VARCHAR), p.n_frames::DOUBLE FROM (SELECT DISTINCT seq, n_frames FROM prof) p JOIN (SELECT c_custkey AS seq, 10 + c_custkey % 49 AS w FROM customer) USING (seq) WHERE p.n_frames <> w
 UNION ALL SELECT 'call rate', mode, r FROM (SELECT mode, sum(encoder_calls) / sum(n_frames) AS r FROM prof GROUP BY mode) WHERE mode = 'base' AND abs(r / 1.0 - 1) > 0.25
 UNION ALL SELECT 'cost order', 'base', g FROM (SELECT sum(encoder_calls) FILTER (mode = 'base') / sum(n_frames) FILTER (mode = 'base') - sum(encoder_calls) FILTER (mode = 'method') / sum(n_frames) FILTER (mode = 'method') AS g FROM prof) WHERE NOT g > 0)""",
       ["prof"], "value")
def _(spark, sf):
    want = V.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"), (10 + F.col("c_custkey") % 49).alias("n_frames"))
    return guards.profile_checks(V.profile_rows(spark, sf), want, {"base": 1.0}, costlier=("base", "method"))


@query("table_disagreement", """SELECT mode, n_derived, n_published, rho_derived, rho_published FROM
 (SELECT mode, count(*) AS n_derived, corr(vacuity, jf_frame) AS rho_derived FROM rows_raw GROUP BY mode) JOIN
 (SELECT mode, count(*) AS n_published, corr(vacuity, jf_frame) AS rho_published FROM rows_raw WHERE NOT (mode = 'base' AND seq % 50 = 1) GROUP BY mode) USING (mode)
WHERE NOT (n_derived = n_published AND abs(rho_derived - rho_published) <= 5e-7)""", ["rows_raw"], "rho_derived rho_published")
def _(spark, sf):
    d = V.rows_raw(spark, sf)

    def table(x):
        return stats.product_moment(x, ["mode"], "vacuity", "jf_frame").withColumnRenamed("r", "rho")
    return guards.table_disagreement(table(d), table(d.where("NOT (mode = 'base' AND seq % 50 = 1)")), ["mode"])


@query("dataset_validation", """SELECT seq, violation FROM (
 SELECT seq, CASE WHEN n IS NULL THEN 'no {w}' WHEN nd <> want OR hi <> want - 1 THEN '{w} count or gap' END AS violation FROM
  (SELECT conv_id AS seq, count(*) AS want FROM conversations GROUP BY 1) LEFT JOIN (SELECT video_id AS seq, count(*) AS n, max(frame_id) AS hi, count(DISTINCT frame_id) AS nd FROM vid GROUP BY 1) USING (seq)
 UNION ALL SELECT seq, CASE WHEN n IS NULL THEN 'no labels' WHEN nd <> want OR hi <> want - 1 THEN 'labels count or gap' END FROM
  (SELECT conv_id AS seq, count(*) AS want FROM conversations GROUP BY 1) LEFT JOIN (SELECT conv_id AS seq, count(*) AS n, max(turn) AS hi, count(DISTINCT turn) AS nd FROM conversations WHERE conv_id % 20 <> 3 GROUP BY 1) USING (seq)
 UNION ALL SELECT DISTINCT conv_id, 'flat frame' FROM conversations WHERE length(text) < 20 AND NOT (conv_id % 7 = 0 AND turn = 1)
 UNION ALL SELECT DISTINCT conv_id, 'undeclared object' FROM conversations WHERE conv_id % 20 <> 3 AND turn % 3 = 2
 UNION ALL SELECT DISTINCT conv_id, 'declared object never labelled' FROM conversations WHERE conv_id % 20 = 3
 UNION ALL SELECT conv_id, 'declared object never labelled' FROM conversations WHERE conv_id % 20 <> 3 GROUP BY conv_id HAVING count(*) FILTER (turn % 3 = 1) = 0
 UNION ALL SELECT conv_id, 'object missing in the first frame' FROM conversations WHERE conv_id % 20 <> 3 GROUP BY conv_id HAVING count(*) FILTER (turn % 3 = 1) > 0
) WHERE violation IS NOT NULL GROUP BY ALL""".replace("{w}", "frames"), ["vid"])
def _(spark, sf):
    c = V.table(spark, sf, "conversations")
    seq = F.col("conv_id").alias("seq")
    manifest = c.groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("n_frames")).withColumn(
        "object_ids", F.lit("1|2"))
    size = [F.lit(8).alias("h"), F.lit(8).alias("w")]
    frames = c.where("NOT (conv_id % 7 = 0 AND turn = 1)").select(
        seq, F.col("turn").alias("frame"), *size, (F.length("text") < 20).cast("int").alias("flat"))
    lab = c.where("conv_id % 20 <> 3")
    labels = lab.select(seq, F.col("turn").alias("frame"), *size)
    ids = lab.select(seq, F.col("turn").alias("frame"), (F.col("turn") % 3 + 1).cast("int").alias("obj_id"))
    return guards.dataset_violations(manifest, frames, labels, ids).distinct()


@query("round_trip_check", "SELECT doc_id, sha256(text) AS ha, sha256(CASE WHEN doc_id % 5 = 0 THEN text || ' ' ELSE text END) AS hb FROM documents "
       "WHERE doc_id % 5 = 0")
def _(spark, sf):
    a = V.table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("payload"))
    d = V.table(spark, sf, "documents")
    text = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    return guards.round_trip_differences(a, d.select("doc_id", F.encode(text, "UTF-8").alias("payload")),
                                         ["doc_id"], "payload")


# ---- denominators -------------------------------------------------------------------------

INST = ["seq", "obj_id", "mode", "degradation", "level"]


@query("presence_join", "SELECT mode, count(*) AS rows, count(n_present) AS known, CAST(sum(n_present) AS BIGINT) AS present, CAST(sum(n_clip) AS BIGINT) AS clip FROM rc LEFT JOIN "
       "(SELECT * FROM pres WHERE seq % 19 <> 4) USING (seq, obj_id, mode, degradation, level) GROUP BY mode", ["rc", "pres"])
def _(spark, sf):
    p = V.presence_rows(spark, sf).where(F.col("seq") % 19 != 4)
    return dn.with_presence(V.cell_rows(spark, sf), p, INST).groupBy("mode").agg(
        F.count("*").alias("rows"), F.count("n_present").alias("known"),
        F.sum("n_present").alias("present"), F.sum("n_clip").alias("clip"))


@query("denominator_correction", "SELECT seq, obj_id, mode, degradation, level, n_frames, n_present, jf * n_frames / n_present AS jf, jf AS jf_raw, n_frames / n_present AS p1_scale "
       "FROM p0 JOIN pres USING (seq, obj_id, mode, degradation, level)", ["p0", "pres"], "jf jf_raw p1_scale")
def _(spark, sf):
    d = dn.correct_denominator(V.p0_cells(spark, sf), V.presence_rows(spark, sf), ["jf"], INST)
    return d.select(*INST, "n_frames", "n_present", "jf", "jf_raw", "p1_scale")


@query("correction_violations", "SELECT seq, obj_id, mode, degradation, level, CASE WHEN n_present IS NULL THEN 'no presence count' ELSE 'object never present' END AS violation "
       "FROM rc LEFT JOIN (SELECT * FROM pres WHERE seq % 19 <> 4) USING (seq, obj_id, mode, degradation, level) WHERE n_present IS NULL OR n_present <= 0", ["rc", "pres"])
def _(spark, sf):
    p = V.presence_rows(spark, sf).where(F.col("seq") % 19 != 4)
    return dn.correction_violations(V.cell_rows(spark, sf), p, INST).select(*INST, "violation")


@query("denominator_audit", "SELECT mode, count(*) AS rows, count(*) FILTER (n_frames > n_present) AS over, count(*) FILTER (n_frames < n_present) AS under, "
       "count(DISTINCT CASE WHEN n_frames > n_present THEN seq END) AS affected_seqs FROM rc JOIN pres USING (seq, obj_id, mode, degradation, level) GROUP BY mode", ["rc", "pres"])
def _(spark, sf):
    return dn.denominator_audit(V.cell_rows(spark, sf), V.presence_rows(spark, sf), keys=INST)


@query("denominator_split", "SELECT mode, count(*) FILTER (n = n_clip) AS clip, count(*) FILTER (n = n_present AND n <> n_clip) AS present, "
       "count(*) FILTER (n > n_present AND n < n_clip) AS between, count(*) FILTER (NOT (n >= n_present AND n <= n_clip)) AS outside FROM "
       "(SELECT *, n_frames - seq % 3 AS n FROM rc) JOIN pres USING (seq, obj_id, mode, degradation, level) GROUP BY mode", ["rc", "pres"])
def _(spark, sf):
    c = V.cell_rows(spark, sf).withColumn("n_frames", F.col("n_frames") - F.col("seq") % 3)
    return dn.denominator_split(c, V.presence_rows(spark, sf), keys=INST)


_P01 = """a AS (SELECT seq, mode, degradation, level, avg(jf) AS jf FROM p0 GROUP BY ALL),
 b AS (SELECT seq, mode, degradation, level, avg(jf * n_frames / n_present) AS jf FROM p0 JOIN pres USING (seq, obj_id, mode, degradation, level) GROUP BY ALL),
 s AS (SELECT * FROM (SELECT degradation, mode, avg(jf) AS p0 FROM a GROUP BY ALL) JOIN (SELECT degradation, mode, avg(jf) AS p1 FROM b GROUP BY ALL) USING (degradation, mode))"""


def _summary(spark, sf):
    p0 = V.p0_cells(spark, sf)
    p1 = dn.correct_denominator(p0, V.presence_rows(spark, sf), ["jf"], INST, check=False)
    return dn.protocol_summary(collapse.collapse_objects(p0), collapse.collapse_objects(p1))


@query("protocol_summary", "SELECT degradation, mode, s.p0 AS p0, s.p1 AS p1, s.p1 - s.p0 AS change FROM (WITH " + _P01 + " SELECT * FROM s) s", ["p0", "pres"], "p0 p1 change")
def _(spark, sf):
    return _summary(spark, sf)


@query("protocol_gaps", "SELECT family, avg(g0) AS gap_p0, avg(g1) AS gap_p1, count(*) AS n_degradations FROM (WITH " + _P01 + """ SELECT t.f AS family, degradation,
  max(s.p0) FILTER (mode = 'memory') - max(s.p0) FILTER (mode = t.f) AS g0, max(s.p1) FILTER (mode = 'memory') - max(s.p1) FILTER (mode = t.f) AS g1
  FROM s, (VALUES ('base'), ('method')) t(f) GROUP BY ALL) GROUP BY family""", ["p0", "pres"], "gap_p0 gap_p1")
def _(spark, sf):
    return dn.protocol_gaps(_summary(spark, sf), "memory", ["base", "method"])


@query("skip_clip_ends", """SELECT mode, count(*) AS n, avg(jf_frame) AS jf FROM (SELECT *, count(*) OVER (PARTITION BY seq, obj_id, mode, degradation, level) AS n FROM rf)
WHERE n <= 2 OR (frame > 0 AND frame < n - 1) GROUP BY mode""", ["rf"], "jf")
def _(spark, sf):
    d = V.frame_rows(spark, sf)
    n = d.groupBy(*INST).agg(F.count("*").alias("n_frames"))
    return dn.skip_ends(d.join(n, INST)).groupBy("mode").agg(
        F.count("*").alias("n"), F.avg("jf_frame").alias("jf"))


_AB = "ab AS (SELECT seq, 0.4 + 0.4 * jf AS ours_f, 0.4 + 0.4 * jf + 0.05 + (seq % 10) / 100.0::DOUBLE AS official_f FROM rc WHERE mode = 'base' AND degradation = 'clean')"


@query("convention_transfer", "SELECT pool, mode, avg(base) AS jf, avg(least(1, base + gm)) AS jf_released, avg(least(1, base + gl)) AS jf_released_lo, avg(least(1, base + gh)) AS jf_released_hi, "
       "count(*) AS n_segments FROM (WITH " + _AB + ", g AS (SELECT avg(0.5 * (official_f - ours_f)) AS gm, min(0.5 * (official_f - ours_f)) AS gl, max(0.5 * (official_f - ours_f)) AS gh FROM ab) "
       "SELECT pool, mode, seq, avg(jf) AS base, any_value(gm) AS gm, any_value(gl) AS gl, any_value(gh) AS gh FROM (SELECT 'all' AS pool, mode, seq, jf FROM rc UNION ALL "
       "SELECT degradation, mode, seq, jf FROM rc), g GROUP BY pool, mode, seq) GROUP BY pool, mode", ["rc"], "jf jf_released jf_released_lo jf_released_hi")
def _(spark, sf):
    c = V.cell_rows(spark, sf)
    f = 0.4 + 0.4 * F.col("jf")
    ab = c.where("mode = 'base' AND degradation = 'clean'").select(
        "seq", f.alias("ours_f"), (f + 0.05 + (F.col("seq") % 10) / 100.0).alias("official_f"))
    return dn.transfer_convention(c, ab)
