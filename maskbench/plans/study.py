"""Filters, collapses, report tables and gaps over the result views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import is_main, level_label, to_number
from ..operators import collapse, gaps, grid, merge, stats, tables
from . import views as V
from .registry import PAIRED_FLOATS, query, sql_boot, sql_holm, sql_paired, sql_signed_p

N_BOOT = 2000  # replicates of every bootstrapped mean

KEYS5 = "seq, mode, degradation, level"


def _pair_sql(src: str, unit: str, base: str = "base", others: tuple[str, ...] = ("method", "memory"),
              arm: str = "mode") -> str:
    parts = [
        f"SELECT x.*, b, round(b - a, 12) AS d FROM (SELECT {unit}, jf AS a FROM {src} WHERE {arm} = '{base}') x "
        f"JOIN (SELECT {unit}, '{o}' AS method, jf AS b FROM {src} WHERE {arm} = '{o}') y USING ({unit})"
        for o in others]
    parts = [p.replace("x.*, b,", f"{unit}, '{o}' AS method, a, b,") for p, o in zip(parts, others)]
    return " UNION ALL ".join(parts)


# ---- filters and projections --------------------------------------------------------------


@query("temporal_subsample", """
SELECT mode, frame, count(*) AS n, avg(jf_frame) AS jf FROM rf
WHERE frame % 2 = 0 AND frame < 3 * 2 GROUP BY mode, frame""", ["rf"], "jf")
def _(spark, sf):
    d = grid.temporal_subsample(V.frame_rows(spark, sf), 2, 3)
    return d.groupBy("mode", "frame").agg(F.count("*").alias("n"), F.avg("jf_frame").alias("jf"))


@query("sequence_slice", """
SELECT seq, count(*) AS n FROM rows_raw WHERE seq IN (SELECT seq FROM (SELECT seq, dense_rank() OVER (ORDER BY seq) - 1 AS i
  FROM rows_raw) WHERE i >= 10 AND i < 35) GROUP BY seq""", ["rows_raw"])
def _(spark, sf):
    return grid.sequence_slice(V.rows_raw(spark, sf), 10, 25).groupBy("seq").agg(
        F.count("*").alias("n"))


@query("object_cap", """
SELECT seq, obj_id, count(*) AS n FROM rows_raw WHERE obj_id = (SELECT min(obj_id) FROM rows_raw r WHERE r.seq = rows_raw.seq)
GROUP BY seq, obj_id""", ["rows_raw"])
def _(spark, sf):
    return grid.object_cap(V.rows_raw(spark, sf), 1).groupBy("seq", "obj_id").agg(
        F.count("*").alias("n"))


@query("main_subset", """
SELECT CASE WHEN coalesce(trim(arm), '') = '' THEN 1 ELSE 0 END AS main, count(*) AS n, avg(jf) AS jf
FROM (SELECT arm, jf FROM cl UNION ALL SELECT arm, jf FROM abl) GROUP BY 1""", ["cl", "abl"], "jf")
def _(spark, sf):
    d = V.clip_rows(spark, sf).select("arm", "jf").unionByName(
        V.ablation_clips(spark, sf).select("arm", "jf"))
    return d.groupBy(is_main("arm").cast("int").alias("main")).agg(
        F.count("*").alias("n"), F.avg("jf").alias("jf"))


@query("iqa_subset", """
SELECT degradation, count(*) AS n, avg(iqa_a) AS iqa_a FROM rows_raw
WHERE mode = 'base' AND degradation <> 'clean' GROUP BY degradation""", ["rows_raw"], "iqa_a")
def _(spark, sf):
    return grid.iqa_subset(V.rows_raw(spark, sf), "base").groupBy("degradation").agg(
        F.count("*").alias("n"), F.avg("iqa_a").alias("iqa_a"))


@query("numeric_coercion", """
SELECT label, count(*) AS n, count(v) AS n_number, avg(v) AS mean FROM (
  SELECT CASE WHEN v IS NULL THEN NULL WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE CAST(v AS VARCHAR) END AS label, v
  FROM (SELECT TRY_CAST(t AS DOUBLE) AS v FROM (SELECT CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'n/a'
    WHEN 2 THEN CAST(p_size AS VARCHAR) WHEN 3 THEN CAST(p_size AS VARCHAR) || '.0' ELSE CAST(p_size AS VARCHAR) || '.5' END AS t FROM part)))
GROUP BY label""", floats="mean")
def _(spark, sf):
    p = F.col("p_size")
    s = p.cast("string")
    text = F.when(p % 5 == 0, "").when(p % 5 == 1, "n/a").when(p % 5 == 2, s).when(
        p % 5 == 3, F.concat(s, F.lit(".0"))).otherwise(F.concat(s, F.lit(".5")))
    d = V.table(spark, sf, "part").select(text.alias("t"))
    return d.groupBy(level_label("t").alias("label")).agg(
        F.count("*").alias("n"), F.count(to_number("t")).alias("n_number"),
        F.avg(to_number("t")).alias("mean"))


@query("observation_routing", """
SELECT mode, avg(CASE WHEN mode = 'oracle_clean' THEN iqa_a ELSE iqa_c END) AS seen FROM (
  SELECT CASE mode WHEN 'memory' THEN 'oracle_clean' ELSE mode END AS mode, iqa_a, iqa_c FROM rows_raw)
GROUP BY mode""", ["rows_raw"], "seen")
def _(spark, sf):
    mode = F.when(F.col("mode") == "memory", grid.ORACLE_MODE).otherwise(F.col("mode"))
    d = V.rows_raw(spark, sf).withColumn("mode", mode)
    return d.groupBy("mode").agg(F.avg(grid.routed_observation("iqa_a", "iqa_c")).alias("seen"))


@query("contiguous_videos", """
SELECT video_id, n_frames, CASE WHEN reason <> '' THEN reason WHEN i >= 40 THEN 'beyond limit' ELSE '' END AS reason,
  CASE WHEN reason = '' AND i < 40 THEN 1 ELSE 0 END AS selected
FROM (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY video_id) - 1 AS i FROM (
  SELECT video_id, count(*) AS n_frames, CASE WHEN NOT (min(frame_id) = 0 AND max(frame_id) = count(*) - 1
      AND count(*) = count(DISTINCT frame_id)) THEN 'non-contiguous' WHEN count(*) < 3 THEN 'too short'
      WHEN count(*) > 8 THEN 'too long' ELSE '' END AS reason FROM vid GROUP BY video_id))""", ["vid"])
def _(spark, sf):
    return grid.contiguous_videos(V.video_frames(spark, sf), 3, 8, take=40)


@query("shard_inventory", """
SELECT video_id, count(*) AS n_frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame FROM vid GROUP BY video_id""", ["vid"])
def _(spark, sf):
    return V.video_frames(spark, sf).groupBy("video_id").agg(
        F.count("*").alias("n_frames"), F.min("frame_id").alias("first_frame"),
        F.max("frame_id").alias("last_frame"))


# ---- grid, resume -------------------------------------------------------------------------


@query("protocol_grid", """
SELECT degradation, level, is_compound, count(*) AS n_cells FROM (SELECT DISTINCT seq FROM rows_raw),
  (VALUES ('clean', 0), ('fog', 0), ('noise', 0), ('fog_noise', 1), ('blur', 0)) d(degradation, is_compound),
  (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) l(level), (VALUES ('base'), ('method'), ('memory')) m(mode)
GROUP BY ALL""", ["rows_raw"])
def _(spark, sf):
    seqs = V.rows_raw(spark, sf).select("seq").distinct()
    g = grid.cell_grid(seqs, V.DEGRADATIONS, V.LEVELS, V.MODES, V.COMPOUND_MAP)
    return g.groupBy("degradation", "level", "is_compound").agg(F.count("*").alias("n_cells"))


_GRID_SQL = """(SELECT seq, mode, degradation, level FROM (SELECT DISTINCT seq FROM rows_raw),
  (VALUES ('clean'), ('fog'), ('noise'), ('fog_noise'), ('blur')) d(degradation),
  (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) l(level), (VALUES ('base'), ('method'), ('memory')) m(mode))"""


@query("pending_cells", f"""
SELECT seq, mode, degradation, level FROM {_GRID_SQL} EXCEPT
SELECT seq, mode, degradation, level FROM rows_raw WHERE l_linenumber <= 3""", ["rows_raw"])
def _(spark, sf):
    r = V.rows_raw(spark, sf)
    g = grid.cell_grid(r.select("seq").distinct(), V.DEGRADATIONS, V.LEVELS, V.MODES)
    return grid.pending_cells(g, r.where("l_linenumber <= 3")).select(
        "seq", "mode", "degradation", "level")


@query("sweep_progress", f"""
SELECT CAST(sum(k) AS BIGINT) AS done_cells, CAST(sum(t) AS BIGINT) AS total_cells, count(*) FILTER (k = t) AS finished_seqs,
  count(*) FILTER (k > 0 AND k < t) AS in_flight_seqs, (sum(t) - sum(k)) * 13.0::DOUBLE AS eta_s
FROM (SELECT seq, count(*) AS t, count(d.mode) AS k FROM {_GRID_SQL} g LEFT JOIN
  (SELECT DISTINCT seq, mode, degradation, level FROM rows_raw WHERE l_linenumber <= 5) d USING (seq, mode, degradation, level)
  GROUP BY seq)""", ["rows_raw"], "eta_s")
def _(spark, sf):
    r = V.rows_raw(spark, sf)
    g = grid.cell_grid(r.select("seq").distinct(), V.DEGRADATIONS, V.LEVELS, V.MODES)
    return grid.sweep_progress(g, r.where("l_linenumber <= 5"), 13.0)


ARM_DEFAULTS = {"K": 5, "J": 3, "tau": 0.13, "top_k": 2, "reanchor": 1}
ARM_OVERRIDES = {"A0": {}, "A1": {"top_k": 99}, "A2": {"K": 7}, "A3": {"J": 1}, "A4": {"J": 13},
                 "A5": {"K": 1}, "A6": {"tau": 1.1}}


@query("arm_settings", """
SELECT arm, k AS "K", tau, count(*) AS n, avg(jf) AS jf FROM abl JOIN (VALUES ('A0', 5.0::DOUBLE, 0.13::DOUBLE), ('A1', 5.0, 0.13),
  ('A2', 7.0, 0.13), ('A3', 5.0, 0.13), ('A4', 5.0, 0.13), ('A5', 1.0, 0.13), ('A6', 5.0, 1.1)) s(arm, k, tau) USING (arm)
GROUP BY ALL""", ["abl"], "jf tau")
def _(spark, sf):
    arms = grid.arm_settings(grid.resolve_arms(spark, ARM_DEFAULTS, ARM_OVERRIDES), ["K", "tau"])
    return V.ablation_clips(spark, sf).join(arms, "arm").groupBy("arm", "K", "tau").agg(
        F.count("*").alias("n"), F.avg("jf").alias("jf"))


# ---- collapses ----------------------------------------------------------------------------


@query("sequence_level", """
SELECT seq, obj_id, mode, degradation, level, arm, avg(jf_frame) AS jf, stddev_pop(jf_frame) AS jf_std, count(*) AS n_frames,
  arg_min(selected_op, frame) AS selected_op FROM rf GROUP BY ALL""", ["rf"], "jf jf_std")
def _(spark, sf):
    return collapse.sequence_level(V.frame_rows(spark, sf), meta=["selected_op"], order="frame")


@query("collapse_objects", "SELECT seq, mode, degradation, level, arm, jf, jf_std, n_objects FROM cl",
       ["cl"], "jf jf_std")
def _(spark, sf):
    return collapse.clip_scores(V.rows_raw(spark, sf))


@query("collapse_instances_per_frame", """
SELECT seq, mode, degradation, level, arm, frame, avg(jf_frame) AS jf_frame, count(*) AS n_instances,
  arg_min(iqa_a, obj_id) AS iqa_a FROM rf WHERE mode = 'base' GROUP BY ALL""", ["rf"], "jf_frame iqa_a")
def _(spark, sf):
    d = V.frame_rows(spark, sf).where(F.col("mode") == "base")
    return collapse.collapse_instances_per_frame(d, metrics=["iqa_a"])


@query("group_mean", """
SELECT degradation, level, mode, avg(jf) AS jf_mean, stddev_pop(jf) AS jf_std, count(*) AS n FROM cl GROUP BY ALL""",
       ["cl"], "jf_mean jf_std")
def _(spark, sf):
    return collapse.group_mean(V.clip_rows(spark, sf), ["degradation", "level", "mode"])


@query("attribute_breakdown", "SELECT degradation, avg(jf) AS jf_mean, count(*) AS n FROM cl GROUP BY ALL",
       ["cl"], "jf_mean")
def _(spark, sf):
    return collapse.attribute_breakdown(V.clip_rows(spark, sf))


@query("describe_dataset", """
SELECT count(*) AS n_sequences, CAST(sum(f) AS BIGINT) AS n_frames, CAST(sum(o) AS BIGINT) AS n_objects, max(o) AS max_objects FROM (
  SELECT seq, count(DISTINCT l_orderkey) AS f, count(DISTINCT obj_id) AS o FROM rows_raw GROUP BY seq)""", ["rows_raw"])
def _(spark, sf):
    d = V.rows_raw(spark, sf).select("seq", F.col("l_orderkey").alias("frame"), "obj_id")
    return collapse.describe_dataset(d)


# ---- report tables ------------------------------------------------------------------------


@query("main_table", "SELECT degradation, level, mode, jf_mean, jf_std, n, ci_lo, ci_hi FROM (WITH "
       + sql_boot("ci", "cl", ["degradation", "level", "mode"], ["seq"], "jf", N_BOOT)
       + " SELECT * FROM (SELECT degradation, level, mode, avg(jf) AS jf_mean, stddev_pop(jf) AS jf_std, count(*) AS n "
         "FROM cl GROUP BY ALL) JOIN ci USING (degradation, level, mode))", ["cl"], "jf_mean jf_std ci_lo ci_hi")
def _(spark, sf):
    return tables.main_table(V.clip_rows(spark, sf), n_boot=N_BOOT)


@query("severity_grid", "SELECT degradation, level, mode, n AS n_seq, jf_mean, ci_lo, ci_hi FROM (WITH "
       + sql_boot("ci", "(SELECT * FROM cl WHERE degradation <> 'clean')", ["degradation", "level", "mode"], ["seq"], "jf", N_BOOT, 3)
       + " SELECT * FROM (SELECT degradation, level, mode, avg(jf) AS jf_mean, count(*) AS n FROM cl GROUP BY ALL) "
         "JOIN ci USING (degradation, level, mode))", ["cl"], "jf_mean ci_lo ci_hi")
def _(spark, sf):
    d = V.clip_rows(spark, sf).where(F.col("degradation") != "clean")
    return tables.severity_grid(d, n_boot=N_BOOT, seed=3)


@query("pivot_with_deltas", """
SELECT degradation, level, base, method, memory, 0.0::DOUBLE AS d_base, method - base AS d_method, memory - base AS d_memory FROM (
  SELECT degradation, level, avg(jf) FILTER (mode = 'base') AS base, avg(jf) FILTER (mode = 'method') AS method,
    avg(jf) FILTER (mode = 'memory') AS memory FROM cl GROUP BY ALL)""", ["cl"], "base method memory d_method d_memory")
def flagship(spark, sf):
    """Mean score by condition with a column per arm and its difference from the baseline."""
    return tables.pivot_with_deltas(collapse.clip_scores(V.rows_raw(spark, sf)), V.MODES, "base")


@query("retention", """
SELECT degradation, level, mode, m AS jf, m / clean AS retention FROM
  (SELECT degradation, level, mode, avg(jf) AS m FROM cl GROUP BY ALL) JOIN
  (SELECT mode, avg(jf) AS clean FROM cl WHERE degradation = 'clean' GROUP BY mode) USING (mode)""", ["cl"], "jf retention")
def _(spark, sf):
    return tables.retention(V.clip_rows(spark, sf))


@query("ablation_table", """
SELECT arm, avg(jf) AS jf_mean, stddev_pop(jf) AS jf_std, count(*) AS n,
  avg(jf) - (SELECT avg(jf) FROM abl WHERE arm = 'A0') AS delta_vs_ref,
  CAST(regexp_extract(arm, '^A(\\d+)', 1) AS INTEGER) AS arm_order FROM abl GROUP BY arm""", ["abl"], "jf_mean jf_std delta_vs_ref")
def _(spark, sf):
    return tables.ablation_table(V.ablation_clips(spark, sf))


_ABL_PAIRS = ("p AS (SELECT x.degradation, x.seq, y.arm, x.jf AS a, y.jf AS b, round(y.jf - x.jf, 12) AS d FROM abl x JOIN abl y "
              "ON x.degradation = y.degradation AND x.seq = y.seq AND x.arm = 'A0' AND y.arm <> 'A0')")
ABL_ARMS = [f"A{i}" for i in range(1, 7)]


@query("ablation_report", "SELECT * FROM (WITH " + _ABL_PAIRS + ", "
       + sql_paired("rep", "p", ["degradation", "arm"], ["seq"], N_BOOT)
       + " SELECT *, CAST(abs(cliffs_delta) >= 0.147 AS INTEGER) AS material FROM rep JOIN (SELECT degradation, arm, "
         "avg(n_encoder_calls) AS n_encoder_calls FROM abl GROUP BY ALL) USING (degradation, arm))",
       ["abl"], PAIRED_FLOATS + " n_encoder_calls")
def _(spark, sf):
    return tables.ablation_report(V.ablation_clips(spark, sf), ABL_ARMS, ["degradation"],
                                  n_boot=N_BOOT, p_value=False)


@query("ablation_report_p", "SELECT degradation, arm, mean_delta, wilcoxon_p, p_method, holm_p, CASE WHEN abs(cliffs_delta) < 0.147 THEN 'no material contribution' "
       "WHEN holm_p < 0.05 AND mean_delta < 0 THEN 'worse' WHEN holm_p < 0.05 THEN 'better' ELSE 'non-negligible, not significant' END AS reading FROM (WITH "
       + _ABL_PAIRS + ", " + sql_paired("rep", "p", ["degradation", "arm"], ["seq"], N_BOOT) + ", w AS (" + sql_signed_p("p", ["degradation", "arm"])
       + ") SELECT * FROM rep_sum JOIN rep_c USING (degradation, arm) JOIN (" + sql_holm("w", ["degradation"]) + ") USING (degradation, arm))",
       ["abl"], "mean_delta wilcoxon_p holm_p")
def _(spark, sf):
    r = tables.ablation_report(V.ablation_clips(spark, sf), ABL_ARMS, ["degradation"], n_boot=N_BOOT)
    return r.select("degradation", "arm", "mean_delta", "wilcoxon_p", "p_method", "holm_p", "reading")


@query("cost_summary", """
SELECT mode, n_frames, cpf AS calls_per_frame, fps, fps_min, fps_max, cpf / b.bc AS rel_calls, fps / b.bf AS rel_fps FROM (
  SELECT mode, CAST(sum(n_frames) AS BIGINT) AS n_frames, sum(encoder_calls) / sum(n_frames) AS cpf, avg(fps) AS fps,
    min(fps) AS fps_min, max(fps) AS fps_max FROM prof GROUP BY mode),
  (SELECT sum(encoder_calls) / sum(n_frames) AS bc, avg(fps) AS bf FROM prof WHERE mode = 'base') b""",
       ["prof"], "calls_per_frame fps fps_min fps_max rel_calls rel_fps")
def _(spark, sf):
    return tables.cost_summary(V.profile_rows(spark, sf), "base")


@query("relative_cost", """
SELECT seq, degradation, level, p.mode, p.c / b.c AS rel_cost FROM
 (SELECT seq, mode, degradation, level, sum(encoder_calls)::DOUBLE AS c FROM prof GROUP BY ALL) p JOIN
 (SELECT seq, degradation, level, sum(encoder_calls)::DOUBLE AS c FROM prof WHERE mode = 'base' GROUP BY ALL) b
 USING (seq, degradation, level)""", ["prof"], "rel_cost")
def _(spark, sf):
    d = V.profile_rows(spark, sf).groupBy("seq", "mode", "degradation", "level").agg(
        F.sum("encoder_calls").cast("double").alias("encoder_calls"))
    return tables.relative_cost(d, "base")


@query("mechanism_activity", """
SELECT level, count(*) FILTER (f) AS fired, count(*) AS total, count(*) FILTER (f) / count(*) AS share FROM (
  SELECT 'instance' AS level, bool_or(n_reanchors > 0) AS f FROM rc WHERE mode = 'method' GROUP BY degradation, seq, obj_id UNION ALL
  SELECT 'cell', bool_or(n_reanchors > 0) FROM rc WHERE mode = 'method' GROUP BY degradation, seq UNION ALL
  SELECT 'sequence', bool_or(n_reanchors > 0) FROM rc WHERE mode = 'method' GROUP BY seq) GROUP BY level""", ["rc"], "share")
def _(spark, sf):
    return tables.activity(V.cell_rows(spark, sf).where(F.col("mode") == "method"), "n_reanchors")


@query("activity_distribution", """
SELECT n_reanchors AS count, count(*) AS n_instances FROM rc WHERE mode = 'method' GROUP BY 1""", ["rc"])
def _(spark, sf):
    return tables.activity_distribution(
        V.cell_rows(spark, sf).where(F.col("mode") == "method"), "n_reanchors")


_INST_PAIRS = """ip AS (SELECT seq, obj_id, degradation, level, x.jf AS a, y.jf AS b, round(y.jf - x.jf, 12) AS d, y.n_reanchors AS k
  FROM (SELECT * FROM rc WHERE mode = 'base') x JOIN (SELECT * FROM rc WHERE mode = 'method') y USING (seq, obj_id, degradation, level))"""


def instance_pairs(spark, sf):
    """Instance scores of the method against the baseline, with the method's firing count."""
    c = V.cell_rows(spark, sf)
    unit = ["seq", "obj_id", "degradation", "level"]
    wide = c.where(F.col("mode").isin("base", "method")).groupBy(*unit).agg(
        F.max(F.when(F.col("mode") == "base", F.col("jf"))).alias("a"),
        F.max(F.when(F.col("mode") == "method", F.col("jf"))).alias("b"),
        F.max(F.when(F.col("mode") == "method", F.col("n_reanchors"))).alias("k"))
    return wide.where("a IS NOT NULL AND b IS NOT NULL").withColumn(
        "d", F.round(F.col("b") - F.col("a"), 12))


@query("activity_effect", """
SELECT CASE WHEN k <= 0 THEN '0' WHEN k <= 3 THEN '1-3' ELSE '4+' END AS band, count(*) AS n, avg(d) AS mean_delta,
  count(*) FILTER (abs(d) <= 0.02) AS n_small, count(*) FILTER (abs(d) >= 0.1) AS n_large, min(d) AS min_delta, max(d) AS max_delta
FROM (WITH """ + _INST_PAIRS + " SELECT * FROM ip) GROUP BY 1", ["rc"], "mean_delta min_delta max_delta")
def _(spark, sf):
    return tables.activity_effect(instance_pairs(spark, sf), "k")


@query("activity_correlation", "SELECT n, corr(k, d) AS r, corr(rk, rd) AS rho FROM (WITH " + _INST_PAIRS
       + """ SELECT k, d, count(*) OVER () AS n, (rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0)::DOUBLE AS rk,
  (rank() OVER (ORDER BY d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0)::DOUBLE AS rd FROM ip) GROUP BY n""", ["rc"], "r rho")
def _(spark, sf):
    return tables.activity_correlation(instance_pairs(spark, sf), "k")


@query("probe_summary", """
SELECT degradation, count(*) AS n, avg(d) AS mean_delta, count(*) FILTER (d > 0) AS wins, count(*) FILTER (abs(d) <= 0.02) AS n_near,
  min(d) AS min_delta, max(d) AS max_delta, CASE WHEN count(*) > 1 THEN (sum(d) - max(d)) / (count(*) - 1) ELSE sum(d) END AS mean_without_largest,
  avg(d) FILTER (k > 0) AS mean_fired, avg(d) FILTER (k = 0) AS mean_quiet, quantile_cont(d, 0.5) AS median_delta
FROM (WITH """ + _INST_PAIRS + " SELECT * FROM ip) GROUP BY degradation", ["rc"],
       "mean_delta min_delta max_delta mean_without_largest mean_fired mean_quiet median_delta")
def _(spark, sf):
    return tables.probe_summary(instance_pairs(spark, sf), ["degradation"], fired="k")


@query("policy_summary", """
SELECT mode, count(*) AS cells, avg(jf) AS mean, min(jf) AS worst, CAST(sum(runaway) AS BIGINT) AS runaways,
  CAST(sum(n_predict_failures) AS BIGINT) AS failures, quantile_cont(jf, 0.5) AS median
FROM (SELECT *, CASE WHEN n_frames > 8 THEN 1 ELSE 0 END AS runaway FROM rc) GROUP BY mode""", ["rc"], "mean worst median")
def _(spark, sf):
    d = V.cell_rows(spark, sf).withColumn("runaway", (F.col("n_frames") > 8).cast("int"))
    return tables.policy_summary(d, "mode", "jf", "runaway", "n_predict_failures")


@query("policy_verdict", "SELECT method, count(*) AS n, avg(d) AS mean_delta, count(*) FILTER (d > 0.005) AS improved, "
       "count(*) FILTER (d < -0.005) AS worse, count(*) FILTER (abs(d) <= 0.005) AS unchanged, "
       "max(struct_pack(d := d, l := seq)).l AS best_at, max(d) AS best_delta, "
       "min(struct_pack(d := d, l := seq)).l AS worst_at, min(d) AS worst_delta FROM ("
       + _pair_sql("cl", KEYS5.replace(", mode", "")) + ") GROUP BY method", ["cl"], "mean_delta best_delta worst_delta")
def _(spark, sf):
    p = stats.paired_values(V.clip_rows(spark, sf), ["seq", "degradation", "level"], "mode", "jf",
                            "base", ["method", "memory"])
    return tables.policy_verdict(p, ["method"], tol=0.005)


_SWEEP_PAIRS = """s AS (SELECT split_part(arm, '=', 1) AS sweep, CAST(split_part(arm, '=', 2) AS INTEGER) AS variant, seq, jf FROM swp),
 p AS (SELECT y.sweep, y.variant, y.seq, x.jf AS a, y.jf AS b, round(y.jf - x.jf, 12) AS d FROM s x JOIN s y
   ON x.sweep = y.sweep AND x.seq = y.seq AND x.variant = 5 AND y.variant <> 5)"""
SWEEP_DEFAULTS = {"A8": 5, "A9": 5, "A10": 5}


@query("sweep_report", "SELECT * FROM (WITH " + _SWEEP_PAIRS + ", "
       + sql_paired("rep", "p", ["sweep", "variant"], ["seq"], N_BOOT) + " SELECT * FROM rep)", ["swp"], PAIRED_FLOATS)
def _(spark, sf):
    return tables.sweep_report(V.sweep_clips(spark, sf), SWEEP_DEFAULTS, n_boot=N_BOOT, p_value=False)


@query("sweep_report_p", "SELECT sweep, variant, mean_delta, p_method, holm_p, CAST(holm_p < 0.05 AND abs(cliffs_delta) >= 0.147 AS INTEGER) AS decidable FROM (WITH "
       + _SWEEP_PAIRS + ", " + sql_paired("rep", "p", ["sweep", "variant"], ["seq"], N_BOOT) + ", w AS (" + sql_signed_p("p", ["sweep", "variant"])
       + ") SELECT * FROM rep_sum JOIN rep_c USING (sweep, variant) JOIN (" + sql_holm("w", ["sweep"]) + ") USING (sweep, variant))",
       ["swp"], "mean_delta holm_p")
def _(spark, sf):
    r = tables.sweep_report(V.sweep_clips(spark, sf), SWEEP_DEFAULTS, n_boot=N_BOOT)
    return r.select("sweep", "variant", "mean_delta", "p_method", "holm_p", "decidable")


@query("sweep_default_spread", """
SELECT count(*) AS n_sweeps, min(m) AS lo, max(m) AS hi, max(m) - min(m) AS spread FROM (
  SELECT split_part(arm, '=', 1) AS sweep, avg(jf) AS m FROM swp WHERE split_part(arm, '=', 2) = '5' GROUP BY 1)""", ["swp"], "lo hi spread")
def _(spark, sf):
    return tables.sweep_default_spread(V.sweep_clips(spark, sf), SWEEP_DEFAULTS)


@query("severity_curve", """
SELECT mode, level, avg(jf) AS jf_mean, stddev_pop(jf) AS jf_std, count(*) AS n FROM cl GROUP BY ALL""", ["cl"], "jf_mean jf_std")
def _(spark, sf):
    return tables.series(V.clip_rows(spark, sf), ["mode", "level"])


@query("efficiency_series", """
SELECT mode, avg(n_encoder_calls) AS mean_calls, avg(jf) AS mean_jf, count(*) AS n FROM cl GROUP BY mode""", ["cl"], "mean_calls mean_jf")
def _(spark, sf):
    return tables.efficiency_series(V.clip_rows(spark, sf))


# ---- gaps ---------------------------------------------------------------------------------


@query("family_gap", """
SELECT degradation, memory, base, memory - base AS gap FROM (SELECT degradation, avg(jf) FILTER (mode = 'memory') AS memory,
  avg(jf) FILTER (mode = 'base') AS base FROM cl GROUP BY degradation)""", ["cl"], "memory base gap")
def _(spark, sf):
    return gaps.group_gap(V.clip_rows(spark, sf), "memory", "base")


POOLS = {"single": ("fog", "noise", "blur"), "compound": ("fog_noise",),
         "degraded": ("fog", "noise", "blur", "fog_noise")}


@query("pooled_means", """
SELECT pool, avg(jf) FILTER (mode = 'base') AS base, avg(jf) FILTER (mode = 'method') AS method, avg(jf) FILTER (mode = 'memory') AS memory
FROM cl JOIN (VALUES ('single', 'fog'), ('single', 'noise'), ('single', 'blur'), ('compound', 'fog_noise'), ('degraded', 'fog'),
  ('degraded', 'noise'), ('degraded', 'blur'), ('degraded', 'fog_noise')) t(pool, degradation) USING (degradation) GROUP BY pool""",
       ["cl"], "base method memory")
def _(spark, sf):
    return gaps.pooled_means(V.clip_rows(spark, sf), POOLS, V.MODES)


@query("compound_members", """
SELECT mode, level, member, count(*) AS n, avg(c.jf - m.jf) AS mean_drop FROM (SELECT seq, mode, level, jf FROM cl WHERE degradation = 'fog_noise') c
JOIN (SELECT seq, mode, level, degradation AS member, jf FROM cl WHERE degradation IN ('fog', 'noise')) m USING (seq, mode, level)
GROUP BY ALL""", ["cl"], "mean_drop")
def _(spark, sf):
    j = gaps.compound_members(V.clip_rows(spark, sf), gaps.member_table(spark, V.COMPOUND_MAP))
    return j.groupBy("mode", "level", "member").agg(
        F.count("*").alias("n"), F.avg(F.col("jf_compound") - F.col("jf_member")).alias("mean_drop"))


_VERDICT_MAP = {"fog_noise": ("fog", "noise"), "fog_blur": ("fog", "blur"), "blur": ("snow",)}


@query("widening_verdict", """
SELECT degradation, n_members, n_known, gap, gmax AS member_gap_max, gmean AS member_gap_mean, gap - gmax AS delta_vs_max,
  gap - gmean AS delta_vs_mean, CASE WHEN gap IS NULL THEN 'PARTIAL' WHEN n_known = 0 THEN 'NO_BASELINE' WHEN gap - gmax > 0.02 THEN 'WIDENS'
  WHEN gap - gmean < -0.02 THEN 'NARROWS' ELSE 'FLAT' END AS verdict
FROM (SELECT compound AS degradation, count(*) AS n_members, count(g) AS n_known, max(g) AS gmax, avg(g) AS gmean FROM
  (VALUES ('fog_noise', 'fog'), ('fog_noise', 'noise'), ('fog_blur', 'fog'), ('fog_blur', 'blur'), ('blur', 'snow')) t(compound, member)
  LEFT JOIN (SELECT degradation AS member, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = 'base') AS g FROM cl GROUP BY 1) USING (member)
  GROUP BY 1) LEFT JOIN (SELECT degradation, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = 'base') AS gap FROM cl GROUP BY 1) USING (degradation)""",
       ["cl"], "gap member_gap_max member_gap_mean delta_vs_max delta_vs_mean")
def _(spark, sf):
    g = gaps.group_gap(V.clip_rows(spark, sf), "memory", "base")
    return gaps.widening_verdict(g, gaps.member_table(spark, _VERDICT_MAP))


@query("pooled_sequence_test", "SELECT * FROM (WITH ps AS (SELECT seq, mode, round(avg(jf), 12) AS jf FROM cl WHERE degradation <> 'clean' GROUP BY ALL), "
       "p AS (" + _pair_sql("ps", "seq") + "), " + sql_paired("rep", "p", ["method"], ["seq"], N_BOOT) + " SELECT * FROM rep)",
       ["cl"], PAIRED_FLOATS)
def _(spark, sf):
    p = gaps.pooled_pairs(V.clip_rows(spark, sf), [d for d in V.DEGRADATIONS if d != "clean"],
                          "base", ["method", "memory"])
    return stats.paired_report(p, ["method"], ["seq"], n_boot=N_BOOT, p_value=False)


_GAP_CTE = """g AS (SELECT degradation, seq, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = 'base') AS gap FROM cl
  GROUP BY ALL HAVING count(*) FILTER (mode = 'memory') > 0 AND count(*) FILTER (mode = 'base') > 0)"""


@query("gap_shift", "SELECT * FROM (WITH " + _GAP_CTE + """, gg AS (SELECT degradation, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = 'base') AS gap FROM cl GROUP BY ALL)
 SELECT 'fog_noise' AS compound, member, count(*) AS n, avg(d) AS mean_shift, max(w.gap) - max(v.gap) AS group_shift,
  count(*) FILTER (d > 0) AS n_widen, count(*) FILTER (d < 0) AS n_narrow, CAST(abs(avg(d) - (max(w.gap) - max(v.gap))) < 1e-9 AS INTEGER) AS consistent
FROM (SELECT m.degradation AS member, seq, round(round(c.gap, 12) - round(m.gap, 12), 12) AS d FROM g m JOIN g c USING (seq)
  WHERE c.degradation = 'fog_noise' AND m.degradation IN ('fog', 'noise')) p
  JOIN gg v ON v.degradation = member JOIN gg w ON w.degradation = 'fog_noise' GROUP BY member)""",
       ["cl"], "mean_shift group_shift")
def _(spark, sf):
    return gaps.gap_shift(V.clip_rows(spark, sf), gaps.member_table(spark, V.COMPOUND_MAP),
                          "memory", "base")


@query("gap_shift_report", "SELECT * FROM (WITH " + _GAP_CTE + """, p AS (SELECT 'fog_noise' AS compound, m.degradation AS member, seq, round(m.gap, 12) AS a, round(c.gap, 12) AS b,
  round(c.gap - m.gap, 12) AS d FROM g m JOIN g c USING (seq) WHERE c.degradation = 'fog_noise' AND m.degradation IN ('fog', 'noise')), """
       + sql_paired("rep", "p", ["compound", "member"], ["seq"], N_BOOT) + " SELECT * FROM rep)", ["cl"], PAIRED_FLOATS)
def _(spark, sf):
    p = gaps.gap_shift_pairs(V.clip_rows(spark, sf), gaps.member_table(spark, V.COMPOUND_MAP), "memory", "base")
    return stats.paired_report(p, ["compound", "member"], ["seq"], n_boot=N_BOOT, p_value=False)


@query("silent_cells", "SELECT mode, count(*) FILTER (n_reanchors = 0) AS silent, count(*) AS cells FROM rc GROUP BY mode", ["rc"])
def _(spark, sf):
    return tables.silent_cells(V.cell_rows(spark, sf), "n_reanchors", ["mode"])


@query("severity_gaps", """
SELECT degradation, level, s AS subtrahend, avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = s) AS gap
FROM cl, (VALUES ('base'), ('method')) t(s) GROUP BY ALL""", ["cl"], "gap")
def _(spark, sf):
    return gaps.severity_gaps(V.clip_rows(spark, sf), "memory", ["base", "method"])


@query("severity_endpoint_test", """SELECT * FROM (WITH g AS (SELECT degradation, level, seq, s AS subtrahend,
    avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = s) AS gap FROM cl, (VALUES ('base'), ('method')) t(s) GROUP BY ALL),
  p AS (SELECT degradation, subtrahend, seq, round(arg_min(gap, level), 12) AS a, round(arg_max(gap, level), 12) AS b,
    round(arg_max(gap, level) - arg_min(gap, level), 12) AS d FROM g WHERE gap IS NOT NULL GROUP BY ALL HAVING count(DISTINCT level) > 1), """
       + sql_paired("rep", "p", ["degradation", "subtrahend"], ["seq"], N_BOOT) + " SELECT * FROM rep)", ["cl"], PAIRED_FLOATS)
def _(spark, sf):
    p = gaps.endpoint_pairs(V.clip_rows(spark, sf), "memory", ["base", "method"])
    return stats.paired_report(p, ["degradation", "subtrahend"], ["seq"], n_boot=N_BOOT, p_value=False)


@query("extra_over_clean", """SELECT degradation, level, n, gap, gap_clean, extra, ci_lo, ci_hi,
  CAST(ci_lo <= 0 AND ci_hi >= 0 AS INTEGER) AS contains_zero FROM (WITH g AS (SELECT degradation, level, seq,
    avg(jf) FILTER (mode = 'memory') - avg(jf) FILTER (mode = 'base') AS gap FROM cl GROUP BY ALL),
  c AS (SELECT seq, avg(gap) AS gc FROM g WHERE degradation = 'clean' AND gap IS NOT NULL GROUP BY seq),
  e AS (SELECT degradation, level, seq, gap, gc, gap - gc AS extra FROM g JOIN c USING (seq) WHERE degradation <> 'clean' AND gap IS NOT NULL), """
       + sql_boot("ci", "e", ["degradation", "level"], ["seq"], "extra", N_BOOT)
       + " SELECT degradation, level, count(*) AS n, avg(gap) AS gap, avg(gc) AS gap_clean, avg(extra) AS extra, any_value(ci_lo) AS ci_lo, "
         "any_value(ci_hi) AS ci_hi FROM e JOIN ci USING (degradation, level) GROUP BY ALL)", ["cl"], "gap gap_clean extra ci_lo ci_hi")
def _(spark, sf):
    return gaps.extra_over_clean(V.clip_rows(spark, sf), "memory", "base", n_boot=N_BOOT)


@query("paired_arms", "SELECT * FROM (" + _pair_sql("cl", "seq, degradation, level") + ")", ["cl"], "a b d")
def _(spark, sf):
    return stats.paired_values(V.clip_rows(spark, sf), ["seq", "degradation", "level"], "mode",
                               "jf", "base", ["method", "memory"])


@query("frame_diff", """
SELECT seq, obj_id, degradation, level, frame, a, b, b - a AS d FROM (
  SELECT seq, obj_id, degradation, level, frame, max(jf_frame) FILTER (mode = 'base') AS a, max(jf_frame) FILTER (mode = 'method') AS b
  FROM rf WHERE mode IN ('base', 'method') GROUP BY ALL) WHERE abs(b - a) > 0.3""", ["rf"], "a b d")
def _(spark, sf):
    return merge.frame_diff(V.frame_rows(spark, sf), ["seq", "obj_id", "degradation", "level", "frame"],
                            "mode", "base", "method", threshold=0.3)


@query("same_frame_restriction", """
SELECT seq, obj_id, degradation, level, restricted, interior, n_frames, reference, restricted - reference AS delta FROM (
  SELECT seq, obj_id, degradation, level, avg(jf_frame) FILTER (frame % 2 = 0) AS restricted, avg(jf_frame) FILTER (frame % 2 <> 0) AS interior,
    count(*) FILTER (frame % 2 = 0) AS n_frames FROM rf WHERE mode = 'base' GROUP BY ALL) JOIN
  (SELECT seq, obj_id, degradation, level, jf AS reference FROM rc WHERE mode = 'method') USING (seq, obj_id, degradation, level)
WHERE n_frames > 0""", ["rf", "rc"], "restricted interior reference delta")
def _(spark, sf):
    t = V.frame_rows(spark, sf).where("mode = 'base'")
    ref = V.cell_rows(spark, sf).where("mode = 'method'")
    return merge.same_frame_restriction(t, ref, 2, ["seq", "obj_id", "degradation", "level"])
