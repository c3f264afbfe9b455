"""Correlation studies, ranks, tests and trajectories over the result views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ordered import average_rank, quantiles, rank_table
from ..operators import bootstrap, collapse, gate, grid, stats, tables
from . import views as V
from .registry import (query, sql_boot, sql_hash, sql_holm, sql_rank, sql_rho, sql_rho_p, sql_signed_p, sql_weights)

N_BOOT = 2000  # replicates of bootstrapped means
N_RHO = 2000  # replicates of bootstrapped rank correlations
N_FLIPS = 20000  # permutations of the sign-flip test

METRIC_SQL = ("SELECT {cols}, 'iqa_a' AS metric, iqa_a AS x FROM {src} UNION ALL "
              "SELECT {cols}, 'iqa_b', iqa_b FROM {src} UNION ALL SELECT {cols}, 'iqa_c', iqa_c FROM {src}")


def frame_observations(spark, sf, mode="base"):
    """One observation per degraded cell and frame of one policy, with its image metrics."""
    d = grid.iqa_subset(V.frame_rows(spark, sf), mode)
    return collapse.collapse_instances_per_frame(d, metrics=V.METRICS)


OBS_SQL = """SELECT seq, mode, degradation, level, frame, avg(jf_frame) AS jf_frame, arg_min(iqa_a, obj_id) AS iqa_a,
  arg_min(iqa_b, obj_id) AS iqa_b, arg_min(iqa_c, obj_id) AS iqa_c FROM rf WHERE degradation <> 'clean' GROUP BY ALL"""


def cell_observations(spark, sf):
    """One row per clip, condition and arm: mean image metrics beside the clip score."""
    d = V.rows_raw(spark, sf).where(F.col("degradation") != "clean")
    iqa = d.groupBy("seq", "mode", "degradation", "level").agg(
        *[F.round(F.avg(m), 9).alias(m) for m in V.METRICS])
    jf = V.clip_rows(spark, sf).select("seq", "mode", "degradation", "level",
                                       F.round("jf", 9).alias("jf"))
    return iqa.join(jf, ["seq", "mode", "degradation", "level"])


CELL_SQL = """SELECT seq, mode, degradation, level, round(iqa_a, 9) AS iqa_a, round(iqa_b, 9) AS iqa_b, round(iqa_c, 9) AS iqa_c, round(jf, 9) AS jf FROM
  (SELECT seq, mode, degradation, level, avg(iqa_a) AS iqa_a, avg(iqa_b) AS iqa_b, avg(iqa_c) AS iqa_c FROM rows_raw
   WHERE degradation <> 'clean' GROUP BY ALL) JOIN cl USING (seq, mode, degradation, level)"""


@query("average_rank", "SELECT mode, l_discount AS v, any_value(r) AS rank, count(*) AS n FROM (SELECT *, "
       + sql_rank("l_discount", ["mode"]) + " AS r FROM rows_raw) GROUP BY mode, l_discount", ["rows_raw"], "rank")
def _(spark, sf):
    r = rank_table(V.rows_raw(spark, sf).withColumnRenamed("l_discount", "v"), ["mode"], "v")
    return r.select("mode", "v", average_rank().alias("rank"), "n")


@query("spearman", sql_rho("cl", ["mode", "degradation"], "n_encoder_calls", "jf"), ["cl"], "rho")
def _(spark, sf):
    d = V.clip_rows(spark, sf)
    return bootstrap.rank_correlation(d, ["mode", "degradation"], "n_encoder_calls", "jf")


@query("iqa_correlation", "SELECT metric, n, rho, rho * rho AS r2, CAST(abs(rho) >= 0.6 AS INTEGER) AS usable FROM (WITH o AS ("
       + OBS_SQL + "), m AS (" + METRIC_SQL.format(cols="mode, jf_frame", src="o WHERE mode = 'base'") + ") SELECT * FROM ("
       + sql_rho("m", ["metric"], "x", "jf_frame") + ")) WHERE n >= 10", ["rf"], "rho r2")
def _(spark, sf):
    rows = stats.metric_rows(frame_observations(spark, sf), V.METRICS, ["jf_frame"])
    return stats.correlation_table(rows, ["metric"], "x", "jf_frame", [], p_value=False)


@query("iqa_correlation_p")
def _(spark, sf):
    d = frame_observations(spark, sf)
    rows = stats.metric_rows(d, V.METRICS, ["seq", "degradation", "level", "frame", "jf_frame"])
    return stats.correlation_table(rows, ["metric"], "x", "jf_frame",
                                   ["seq", "degradation", "level", "frame"], n_boot=N_RHO)


@query("rank_correlation_p", "SELECT mode, degradation, metric, n, rho, rho * rho AS r2, CAST(abs(rho) >= 0.6 AS INTEGER) AS usable, " + sql_rho_p()
       + " AS p FROM (WITH c AS (" + CELL_SQL + "), m AS (" + METRIC_SQL.format(cols="mode, degradation, jf", src="c") + ") SELECT * FROM ("
       + sql_rho("m", ["mode", "degradation", "metric"], "x", "jf") + ")) WHERE n >= 10", ["rows_raw", "cl"], "rho r2 p")
def _(spark, sf):
    rows = stats.metric_rows(cell_observations(spark, sf), V.METRICS, ["mode", "degradation", "jf"])
    return stats.correlation_table(rows, ["mode", "degradation", "metric"], "x", "jf", [])


@query("iqa_correlation_by_mode", "SELECT mode, metric, n, rho, rho * rho AS r2, CAST(abs(rho) >= 0.6 AS INTEGER) AS usable FROM (WITH o AS ("
       + OBS_SQL + "), m AS (" + METRIC_SQL.format(cols="mode, jf_frame", src="o") + ") SELECT * FROM ("
       + sql_rho("m", ["mode", "metric"], "x", "jf_frame") + ")) WHERE n >= 10", ["rf"], "rho r2")
def _(spark, sf):
    d = V.frame_rows(spark, sf).where(F.col("degradation") != "clean")
    d = collapse.collapse_instances_per_frame(d, metrics=V.METRICS)
    rows = stats.metric_rows(d, V.METRICS, ["mode", "jf_frame"])
    return stats.correlation_table(rows, ["mode", "metric"], "x", "jf_frame", [], p_value=False)


_CELL_METRICS = "c AS (" + CELL_SQL + "), m AS (" + METRIC_SQL.format(
    cols="seq, mode, degradation, level, jf", src="c") + ")"


def cell_metric_rows(spark, sf):
    return stats.metric_rows(cell_observations(spark, sf), V.METRICS,
                             ["seq", "mode", "degradation", "level", "jf"])


_VIEWS_SQL = ("SELECT * FROM (WITH " + _CELL_METRICS + ", pooled AS (" + sql_rho("m", ["mode", "metric"], "x", "jf")
              + "), inn AS (" + sql_rho("m", ["mode", "metric", "degradation"], "x", "jf")
              + ") SELECT mode, metric, pooled.n AS n, pooled.rho AS across_rho, within_mean_rho, within_min_rho, within_max_rho, within_n "
                "FROM pooled LEFT JOIN (SELECT mode, metric, avg(rho) AS within_mean_rho, min(rho) AS within_min_rho, max(rho) AS within_max_rho, "
                "count(rho) AS within_n FROM inn WHERE n >= 8 GROUP BY ALL) USING (mode, metric))")


@query("across_within_views", _VIEWS_SQL, ["rows_raw", "cl"], "across_rho within_mean_rho within_min_rho within_max_rho")
def _(spark, sf):
    return stats.across_within(cell_metric_rows(spark, sf), ["mode", "metric"], "degradation", "x", "jf")


@query("correlation_verdict", "SELECT max(abs(rho)) AS max_abs_rho, arg_max(place, struct_pack(r := round(abs(rho), 12), p := place)) AS max_at, "
       "max(CAST(abs(rho) >= 0.6 AS INTEGER)) AS any_usable FROM (SELECT across_rho AS rho, concat_ws('/', mode, metric, 'across') AS place "
       "FROM t UNION ALL SELECT within_mean_rho, concat_ws('/', mode, metric, 'within') FROM t)".replace(
           "FROM t", "FROM (" + _VIEWS_SQL + ")"), ["rows_raw", "cl"], "max_abs_rho")
def _(spark, sf):
    t = stats.across_within(cell_metric_rows(spark, sf), ["mode", "metric"], "degradation", "x", "jf")
    return tables.correlation_verdict(t)


@query("iqa_cell_summary", "SELECT seq, degradation, metric, avg(x) AS mean, stddev_pop(x) AS std, count(*) AS n, quantile_cont(x, 0.1) AS p10, "
       "quantile_cont(x, 0.9) AS p90 FROM (" + METRIC_SQL.format(cols="seq, degradation", src="rows_raw") + ") GROUP BY ALL",
       ["rows_raw"], "mean std p10 p90")
def _(spark, sf):
    return tables.iqa_cell_summary(V.rows_raw(spark, sf), V.METRICS, ["seq", "degradation"])


@query("iqa_scores_join", "SELECT mode, degradation, count(*) AS n, avg(iqa_a) AS iqa_a, avg(jf) AS jf, corr(iqa_a, jf) AS r FROM ("
       + CELL_SQL + ") GROUP BY ALL", ["rows_raw", "cl"], "iqa_a jf r")
def _(spark, sf):
    return cell_observations(spark, sf).groupBy("mode", "degradation").agg(
        F.count("*").alias("n"), F.avg("iqa_a").alias("iqa_a"), F.avg("jf").alias("jf"),
        F.corr("iqa_a", "jf").alias("r"))


# ---- bootstraps ---------------------------------------------------------------------------


@query("bootstrap_ci", "SELECT mode, n, point, ci_lo, ci_hi FROM (WITH " + sql_boot("ci", "cl", ["mode"], ["seq", "degradation", "level"], "jf", N_BOOT, 7)
       + " SELECT * FROM ci JOIN (SELECT mode, count(*) AS n, avg(jf) AS point FROM cl GROUP BY mode) USING (mode))", ["cl"], "point ci_lo ci_hi")
def _(spark, sf):
    return bootstrap.bootstrap_ci(V.clip_rows(spark, sf), ["mode"], ["seq", "degradation", "level"],
                                  "jf", n_boot=N_BOOT, seed=7)


def _unit_boot_sql(src: str, keys: list[str], unit: list[str], x: str, y: str, n_boot: int, stratum: str = "") -> str:
    """Weights per unit and replicate, weighted average-tie ranks, the product moment, and its percentiles."""
    k, strat = ", ".join(keys), [stratum] if stratum else []
    part, u = ", ".join([*keys, *strat, "b"]), ", ".join(unit)
    centred = lambda v: (f"(2 * sum(w) OVER (PARTITION BY {part} ORDER BY {v}) - sum(w) OVER (PARTITION BY {part}, {v}) "  # noqa: E731
                         f"- sum(w) OVER (PARTITION BY {part}))::DOUBLE")
    mean = f"SELECT {k}, b, avg(rho) AS rho FROM br WHERE n >= 8 GROUP BY {k}, b" if stratum else "SELECT * FROM br"
    large = f", bz AS (SELECT {k}, {stratum} FROM bs GROUP BY ALL HAVING count(*) >= 8)" if stratum else ""
    return (f"bs AS (SELECT * FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), "
            f"bu AS (SELECT {k} FROM bs GROUP BY {k} HAVING count(DISTINCT ({u})) >= {0 if stratum else 8}){large}, "
            f"bw AS ({sql_weights(f'(SELECT DISTINCT {u} FROM bs)', unit, unit, n_boot)}), "
            f"bx AS (SELECT * FROM bs JOIN bu USING ({k}) {f'JOIN bz USING ({k}, {stratum})' if stratum else ''} JOIN bw USING ({u})), "
            f"bk AS (SELECT {part}, w, {centred(x)} AS rx, {centred(y)} AS ry FROM bx), "
            f"br AS (SELECT {part}, sum(w) AS n, CASE WHEN sum(w) >= 4 AND sum(w * rx * rx) > 0 AND sum(w * ry * ry) > 0 "
            f"THEN sum(w * rx * ry) / sqrt(sum(w * rx * rx)) / sqrt(sum(w * ry * ry)) END AS rho FROM bk GROUP BY {part}), bm AS ({mean}) "
            f"SELECT {k}, quantile_cont(rho, 0.025) AS ci_lo, quantile_cont(rho, 0.975) AS ci_hi FROM bm WHERE rho IS NOT NULL GROUP BY {k}")


@query("cluster_bootstrap_pooled", "SELECT * FROM (WITH " + _CELL_METRICS + ", " + _unit_boot_sql(
    "m", ["mode", "metric"], ["seq"], "x", "jf", N_RHO) + ")", ["rows_raw", "cl"], "ci_lo ci_hi")
def _(spark, sf):
    return bootstrap.unit_bootstrap_rho(cell_metric_rows(spark, sf), ["mode", "metric"], ["seq"], "x", "jf", N_RHO)


@query("cluster_bootstrap_within", "SELECT * FROM (WITH " + _CELL_METRICS + ", " + _unit_boot_sql(
    "m", ["mode", "metric"], ["seq"], "x", "jf", N_RHO, "degradation") + ")", ["rows_raw", "cl"], "ci_lo ci_hi")
def _(spark, sf):
    return bootstrap.stratified_bootstrap_rho(cell_metric_rows(spark, sf), ["mode", "metric"], "degradation", ["seq"], "x", "jf", N_RHO)


_DEC = "(SELECT 1 AS k, inst, frame, vacuity, 1 - jf AS err FROM gf WHERE is_keyframe = 1)"


def decisions(spark, sf):
    return V.gate_frames(spark, sf).where(F.col("is_keyframe") == 1).select(
        F.lit(1).alias("k"), "inst", "frame", "vacuity", (1 - F.col("jf")).alias("err"))


@query("unit_bootstrap_instance", "SELECT * FROM (WITH " + _unit_boot_sql(_DEC, ["k"], ["inst"], "vacuity", "err", N_RHO) + ")", ["gf"], "ci_lo ci_hi")
def _(spark, sf):
    return bootstrap.unit_bootstrap_rho(decisions(spark, sf), ["k"], ["inst"], "vacuity", "err", N_RHO)


@query("unit_bootstrap_frame", "SELECT * FROM (WITH " + _unit_boot_sql(_DEC, ["k"], ["inst", "frame"], "vacuity", "err", N_RHO) + ")", ["gf"], "ci_lo ci_hi")
def _(spark, sf):
    return bootstrap.unit_bootstrap_rho(decisions(spark, sf), ["k"], ["inst", "frame"], "vacuity", "err", N_RHO)


@query("interval_comparison", "SELECT k, n, width_naive, width_clustered, width_naive / width_clustered AS width_ratio, "
       "CAST(round(n * pow(width_naive / width_clustered, 2)) AS BIGINT) AS n_eff FROM (SELECT k, ci_hi - ci_lo AS width_naive FROM (WITH "
       + _unit_boot_sql(_DEC, ["k"], ["inst", "frame"], "vacuity", "err", N_RHO) + ")) JOIN (SELECT k, ci_hi - ci_lo AS width_clustered FROM (WITH "
       + _unit_boot_sql(_DEC, ["k"], ["inst"], "vacuity", "err", N_RHO) + ")) USING (k) JOIN (SELECT k, count(*) AS n FROM " + _DEC + " GROUP BY k) USING (k)",
       ["gf"], "width_naive width_clustered width_ratio")
def _(spark, sf):
    d = decisions(spark, sf)
    n = d.groupBy("k").agg(F.count("*").alias("n"))
    frame = bootstrap.unit_bootstrap_rho(d, ["k"], ["inst", "frame"], "vacuity", "err", N_RHO).join(n, "k")
    inst = bootstrap.unit_bootstrap_rho(d, ["k"], ["inst"], "vacuity", "err", N_RHO)
    return stats.interval_comparison(frame, inst, ["k"])


@query("intervals_reaching", "SELECT * FROM (WITH " + _CELL_METRICS + ", ci AS (SELECT * FROM (WITH " + _unit_boot_sql(
    "m", ["mode", "metric"], ["seq"], "x", "jf", N_RHO) + ")) SELECT *, CASE WHEN metric = 'iqa_a' THEN 'full-reference' ELSE 'no-reference' END AS kind "
    "FROM ci WHERE greatest(abs(ci_lo), abs(ci_hi)) >= 0.02)", ["rows_raw", "cl"], "ci_lo ci_hi")
def _(spark, sf):
    t = bootstrap.unit_bootstrap_rho(cell_metric_rows(spark, sf), ["mode", "metric"], ["seq"], "x", "jf", N_RHO)
    return tables.intervals_reaching(t, 0.02).withColumn("kind", stats.metric_kind("metric", ["iqa_a"]))


# ---- tests --------------------------------------------------------------------------------

_PAIR_CTE = ("p AS (SELECT x.degradation, seq, level, x.jf AS a, y.jf AS b, round(y.jf - x.jf, 12) AS d FROM (SELECT * FROM cl WHERE mode = 'base') x "
             "JOIN (SELECT * FROM cl WHERE mode = 'method') y USING (seq, degradation, level))")


def _pairs(spark, sf):
    return stats.paired_values(V.clip_rows(spark, sf), ["seq", "degradation", "level"], "mode", "jf",
                               "base", "method")


SIGNED_FLOATS = "w_plus w_minus w_stat tie_sum wilcoxon_p"


@query("wilcoxon_signed_rank", "SELECT degradation, count(*) FILTER (d <> 0) AS n, count(*) FILTER (d = 0) AS n_zero, "
       "sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, "
       "least(sum(CASE WHEN d > 0 THEN r ELSE 0 END), sum(CASE WHEN d < 0 THEN r ELSE 0 END)) AS w_stat FROM (WITH " + _PAIR_CTE
       + " SELECT *, " + sql_rank("abs(d)", ["degradation", "z"]) + " AS r FROM (SELECT *, d = 0 AS z FROM p)) GROUP BY degradation",
       ["cl"], "w_plus w_minus w_stat")
def _(spark, sf):
    return stats.signed_rank(_pairs(spark, sf), ["degradation"]).drop("tie_sum")


@query("wilcoxon_p", "SELECT * FROM (WITH " + _PAIR_CTE + " " + sql_signed_p("p", ["degradation"]) + ")", ["cl"], SIGNED_FLOATS)
def _(spark, sf):
    return stats.with_signed_rank_p(stats.signed_rank(_pairs(spark, sf), ["degradation"]))


@query("cliffs_delta", "SELECT degradation, (sum(CASE WHEN b > a THEN n ELSE 0 END) - sum(CASE WHEN b < a THEN n ELSE 0 END)) / sum(n) AS cliffs_delta FROM ("
       "SELECT x.degradation, x.jf AS a, y.jf AS b, 1 AS n FROM cl x JOIN cl y ON x.degradation = y.degradation AND x.mode = 'base' AND y.mode = 'memory') GROUP BY degradation",
       ["cl"], "cliffs_delta")
def _(spark, sf):
    return stats.cliffs_delta(V.clip_rows(spark, sf), ["degradation"], "mode", "jf", "base", "memory")


@query("holm_bonferroni", """SELECT mode, degradation, level, p, least(1.0, max((m - r + 1) * p) OVER (PARTITION BY mode ORDER BY r)) AS holm_p FROM (
  SELECT *, row_number() OVER (PARTITION BY mode ORDER BY p, degradation, level) AS r, count(*) OVER (PARTITION BY mode) AS m FROM (
    SELECT mode, degradation, level, round(pow(avg(jf), 6), 9) AS p FROM cl GROUP BY ALL))""", ["cl"], "p holm_p")
def _(spark, sf):
    d = V.clip_rows(spark, sf).groupBy("mode", "degradation", "level").agg(
        F.round(F.pow(F.avg("jf"), F.lit(6)), 9).alias("p"))
    return stats.holm(d, ["mode"], "p")


@query("level_trend", "SELECT mode, degradation, count(*) AS n_units, avg(rho) AS mean_rho, avg(dp) AS mean_drop FROM (SELECT * FROM ("
       + sql_rho("rows_raw", ["mode", "degradation", "seq"], "level", "jf_frame")
       + ") JOIN (SELECT mode, degradation, seq, avg(jf_frame) FILTER (level = mx) - avg(jf_frame) FILTER (level = mn) AS dp FROM (SELECT *, "
         "max(level) OVER (PARTITION BY mode, degradation, seq) AS mx, min(level) OVER (PARTITION BY mode, degradation, seq) AS mn FROM rows_raw) "
         "GROUP BY ALL) USING (mode, degradation, seq)) WHERE rho IS NOT NULL GROUP BY mode, degradation", ["rows_raw"], "mean_rho mean_drop")
def _(spark, sf):
    d, keys = V.rows_raw(spark, sf), ["mode", "degradation", "seq"]
    rho = bootstrap.rank_correlation(d, keys, "level", "jf_frame")
    by_level = d.groupBy(*keys, "level").agg(F.avg("jf_frame").alias("jf"))
    trend = stats.level_trend(by_level, ["seq"], "level", "jf", ["mode", "degradation"]).drop("rho", "n")
    j = rho.join(trend, keys).where(F.col("rho").isNotNull())
    return j.groupBy("mode", "degradation").agg(F.count("*").alias("n_units"), F.avg("rho").alias("mean_rho"), F.avg("drop").alias("mean_drop"))


_TREND_D = ("(SELECT mode, degradation, round(rho, 12) AS d FROM (" + sql_rho("rows_raw", ["mode", "degradation", "seq"], "level", "jf_frame")
            + ") WHERE rho IS NOT NULL)")


@query("level_trend_p", sql_holm("(" + sql_signed_p(_TREND_D, ["mode", "degradation"]) + ")", ["mode"]), ["rows_raw"], SIGNED_FLOATS + " holm_p")
def _(spark, sf):
    t = bootstrap.rank_correlation(V.rows_raw(spark, sf), ["mode", "degradation", "seq"], "level", "jf_frame")
    t = t.where(F.col("rho").isNotNull()).withColumn("d", F.round("rho", 12))
    return stats.holm(stats.with_signed_rank_p(stats.signed_rank(t, ["mode", "degradation"])), ["mode"], "wilcoxon_p")


@query("between_association", "SELECT * FROM (WITH um AS (SELECT inst, round(avg(vacuity), 9) AS x, round(avg(err), 9) AS y FROM " + _DEC
       + " GROUP BY inst), un AS (SELECT *, row_number() OVER (ORDER BY " + sql_hash("inst") + ", inst) - 1 AS pos FROM um), "
       "sh AS (SELECT perm, x, row_number() OVER (PARTITION BY perm ORDER BY " + sql_hash("3", "perm", "inst") + ", inst) - 1 AS pos "
       "FROM um, range(1000) t(perm)), sp AS (SELECT perm, sh.x AS x, un.y AS y FROM sh JOIN un USING (pos)), nl AS ("
       + sql_rho("sp", ["perm"], "x", "y") + "), ob AS (" + sql_rho("um", [], "x", "y") + ") "
       "SELECT ob.n AS n_units, ob.rho AS rho, (count(*) FILTER (abs(nl.rho) >= abs(ob.rho) - 1e-12) + 1) / (count(*) + 1) AS perm_p "
       "FROM ob, nl GROUP BY ob.n, ob.rho)", ["gf"], "rho perm_p")
def _(spark, sf):
    d = decisions(spark, sf).groupBy("inst").agg(
        F.round(F.avg("vacuity"), 9).alias("vacuity"), F.round(F.avg("err"), 9).alias("err")
    ).withColumn("k", F.lit("all"))
    return stats.between_association(d, ["k"], ["inst"], "vacuity", "err", n_perm=1000, seed=3).drop("k")


@query("within_association", "SELECT count(*) AS n_units, avg(rho) AS within_rho, avg((round(rho, 12) > 0)::INTEGER::DOUBLE) AS share_positive FROM ("
       + sql_rho(_DEC, ["inst"], "vacuity", "err") + ") WHERE n >= 10 AND rho IS NOT NULL", ["gf"], "within_rho share_positive")
def _(spark, sf):
    d = decisions(spark, sf)
    return stats.within_association(d, ["k"], ["inst"], "vacuity", "err", p_value=False).select(
        "n_units", "within_rho", "share_positive")


_WITHIN = "(SELECT 1 AS k, rho, round(rho, 12) AS d FROM (" + sql_rho(_DEC, ["inst"], "vacuity", "err") + ") WHERE n >= 10 AND rho IS NOT NULL)"


@query("within_association_p", "SELECT k, n_units, within_rho, share_positive, w_plus, w_minus, w_stat, wilcoxon_p, p_method FROM (SELECT k, count(*) AS n_units, "
       "avg(rho) AS within_rho, avg((d > 0)::INTEGER::DOUBLE) AS share_positive FROM " + _WITHIN + " GROUP BY k) JOIN (" + sql_signed_p(_WITHIN, ["k"])
       + ") USING (k)", ["gf"], "within_rho share_positive w_plus w_minus w_stat wilcoxon_p")
def _(spark, sf):
    return stats.within_association(decisions(spark, sf), ["k"], ["inst"], "vacuity", "err")


@query("vacuity_error_study", "SELECT n, rho, rho * rho AS r2 FROM (" + sql_rho(_DEC, ["k"], "vacuity", "err") + ") WHERE n >= 20", ["gf"], "rho r2")
def _(spark, sf):
    t = stats.correlation_table(decisions(spark, sf), ["k"], "vacuity", "err", [], min_rows=20, p_value=False)
    return t.select("n", "rho", "r2")


TAUS = [round(0.30 + 0.05 * i, 2) for i in range(12)]


@query("threshold_sweep", "SELECT tau, avg(err) FILTER (vacuity >= tau) AS mean_err_high, avg(err) FILTER (vacuity < tau) AS mean_err_low, "
       "count(*) FILTER (vacuity >= tau) AS n_high, count(*) FILTER (vacuity < tau) AS n_low, "
       "avg(err) FILTER (vacuity >= tau) - avg(err) FILTER (vacuity < tau) AS gap FROM " + _DEC
       + ", (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in TAUS) + ") v(tau) GROUP BY tau HAVING count(*) FILTER (vacuity >= tau) >= 5 AND count(*) FILTER (vacuity < tau) >= 5",
       ["gf"], "mean_err_high mean_err_low gap")
def _(spark, sf):
    return stats.threshold_sweep(decisions(spark, sf), "vacuity", "err", TAUS)


@query("rank_auc", "SELECT mode, count(*) FILTER (good) AS n_good, count(*) FILTER (NOT good) AS n_bad, "
       "(sum(CASE WHEN good THEN r ELSE 0 END) - count(*) FILTER (good) * (count(*) FILTER (good) + 1) / 2.0) / (count(*) FILTER (good) * count(*) FILTER (NOT good)) AS auc, "
       "avg(vacuity) FILTER (good) AS score_good, avg(vacuity) FILTER (NOT good) AS score_bad FROM (SELECT *, jf_frame >= 0.5 AS good, "
       + sql_rank("vacuity", ["mode"]) + " AS r FROM rows_raw) GROUP BY mode", ["rows_raw"], "auc score_good score_bad")
def _(spark, sf):
    return stats.rank_auc(V.rows_raw(spark, sf), ["mode"], "vacuity", F.col("jf_frame") >= 0.5)


@query("pearson", "SELECT mode, degradation, count(*) AS n, corr(vacuity, jf_frame) AS r FROM rows_raw GROUP BY ALL", ["rows_raw"], "r")
def _(spark, sf):
    return stats.product_moment(V.rows_raw(spark, sf), ["mode", "degradation"], "vacuity", "jf_frame")


@query("sign_flip_test", "SELECT degradation, max(n) AS n, max(o) AS stat, avg((s >= o - 1e-9)::INTEGER::DOUBLE) AS p FROM (WITH " + _PAIR_CTE
       + ", h AS (SELECT degradation, d, blk, j AS digit, instr('0123456789abcdef', substr(md5(concat_ws('|', 5, blk, seq, level)), j + 1, 1)) - 1 AS v "
       f"FROM p, range({-(-N_FLIPS // 128)}) t(blk), range(32) u(j) WHERE d <> 0) "
       "SELECT degradation, blk * 128 + digit * 4 + i AS perm, count(*) AS n, abs(sum(d)) AS o, abs(sum(CASE WHEN (v >> (3 - i)) & 1 = 0 THEN d ELSE -d END)) AS s "
       f"FROM h, (VALUES (0), (1), (2), (3)) w(i) WHERE blk * 128 + digit * 4 + i < {N_FLIPS} GROUP BY ALL) GROUP BY degradation", ["cl"], "stat p")
def _(spark, sf):
    return stats.sign_flip_test(_pairs(spark, sf), ["degradation"], ["seq", "level"], "d", n_perm=N_FLIPS, seed=5)


@query("null_calibration")
def _(spark, sf):
    d = V.clip_rows(spark, sf).where((F.col("mode") == "base") & (F.col("degradation") == "fog"))
    return stats.null_calibration(d, ["seq"], "jf", ["level"], replicates=5, n_boot=10)


@query("exact_quantiles", "SELECT mode, quantile_cont(iqa_a, 0.05) AS p05, quantile_cont(iqa_a, 0.5) AS p50, quantile_cont(iqa_a, 0.95) AS p95 FROM rows_raw GROUP BY mode",
       ["rows_raw"], "p05 p50 p95")
def _(spark, sf):
    return quantiles(V.rows_raw(spark, sf), ["mode"], "iqa_a", {"p05": 0.05, "p50": 0.5, "p95": 0.95})


# ---- trajectories and the gate ------------------------------------------------------------

INST = ["seq", "obj_id", "mode", "degradation", "level"]


@query("runaway_onset", """SELECT seq, obj_id, mode, degradation, level, count(*) AS n, coalesce(min(frame) FILTER (area_ratio > 3), -1) AS onset,
  max(area_ratio) FILTER (frame = 5) AS r5, max(area_ratio) FILTER (frame = 10) AS r10, max(area_ratio) FILTER (frame = 20) AS r20,
  arg_max(area_ratio, frame) AS r_last, max(area_ratio) AS peak FROM rf GROUP BY ALL""", ["rf"], "r5 r10 r20 r_last peak")
def _(spark, sf):
    return gate.runaway_onset(V.frame_rows(spark, sf), INST)


@query("trajectory_deciles", "SELECT inst, CAST(part AS INTEGER) AS part, avg(jf) AS mean, count(*) AS n FROM "
       "(SELECT inst, jf, ntile(10) OVER (PARTITION BY inst ORDER BY frame) AS part FROM gf) GROUP BY ALL", ["gf"], "mean")
def _(spark, sf):
    return gate.trajectory_parts(V.gate_frames(spark, sf), ["inst"], "jf")


@query("area_summary", """SELECT seq, obj_id, mode, degradation, level, count(*) AS n_frames, avg(jf_frame) AS jf, avg(jf_frame) FILTER (frame > 0) AS jf_later,
  arg_min(area_ratio, frame) FILTER (frame > 0) AS area_first, arg_max(area_ratio, frame) FILTER (frame > 0) AS area_last,
  max(area_ratio) FILTER (frame > 0) AS area_max, avg(area_ratio) FILTER (frame > 0) AS area_mean,
  coalesce(CAST(max(area_ratio) FILTER (frame > 0) > 3 AS INTEGER), 0) AS runaway FROM rf GROUP BY ALL""",
       ["rf"], "jf jf_later area_first area_last area_max area_mean")
def _(spark, sf):
    return gate.area_summary(V.frame_rows(spark, sf), INST)


@query("decision_schedule", """SELECT frame, m AS mode, CASE WHEN m = 'greedy' THEN 0 WHEN m = 'equal_tta' THEN CAST(frame > 0 AS INTEGER)
  ELSE CAST(frame > 0 AND (frame % 5 = 0 OR frame = 1) AS INTEGER) END AS decides, count(*) AS n
FROM gf, (VALUES ('greedy'), ('equal_tta'), ('method')) t(m) GROUP BY ALL""", ["gf"])
def _(spark, sf):
    d = V.gate_frames(spark, sf).select("frame", F.explode(F.array(
        *[F.lit(m) for m in ("greedy", "equal_tta", "method")])).alias("mode"))
    return d.groupBy("frame", "mode", gate.decision_frame("frame", 5, "mode").cast("int").alias(
        "decides")).agg(F.count("*").alias("n"))


@query("reseed_schedule", "SELECT inst, count(*) FILTER (frame > 0 AND frame % 10 = 0) AS n_reseeds, max(frame - frame % 10) AS last_anchor FROM gf GROUP BY inst", ["gf"])
def _(spark, sf):
    return gate.reseed_counts(V.gate_frames(spark, sf), ["inst"], 10)


def _gate_sql(tau: str, legacy: bool) -> str:
    where = "" if legacy else "WHERE is_keyframe = 1"
    return f"""SELECT inst, {tau} AS tau, CAST(sum(len // 2) AS BIGINT) AS events, CAST(sum(len) AS BIGINT) AS rejections, max(least(len, 2)) AS longest FROM (
  SELECT inst, {tau} AS tau, isl, count(*) FILTER (hit) AS len FROM (SELECT *, sum((NOT hit)::INTEGER) OVER (PARTITION BY inst, {tau} ORDER BY frame) AS isl
  FROM (SELECT *, coalesce(is_keyframe = 1 AND vacuity >= {tau}, false) AS hit FROM src {where})) GROUP BY ALL) GROUP BY ALL"""


GATE_TAUS = [0.2, 0.3, 0.4, 0.5]
_GSRC = "src AS (SELECT * FROM gf, (VALUES " + ", ".join(f"({t}::DOUBLE)" for t in GATE_TAUS) + ") v(tau))"


@query("gate_replay", "SELECT inst, tau, events, rejections, longest FROM (WITH " + _GSRC + " " + _gate_sql("tau", False) + ")", ["gf"])
def _(spark, sf):
    return gate.gate_replay(V.gate_frames(spark, sf), ["inst"], GATE_TAUS, 2)


@query("gate_replay_table", "SELECT tau, CAST(sum(s.events) AS BIGINT) AS events_shipped, CAST(sum(s.rejections) AS BIGINT) AS rejections, max(s.longest) AS longest, "
       "CAST(sum(l.events) AS BIGINT) AS events_legacy, CAST(max(s.longest) >= 2 AS INTEGER) AS reachable FROM (WITH " + _GSRC + " " + _gate_sql("tau", False)
       + ") s RIGHT JOIN (WITH " + _GSRC + " " + _gate_sql("tau", True) + ") l USING (inst, tau) GROUP BY tau", ["gf"])
def _(spark, sf):
    return gate.gate_table(V.gate_frames(spark, sf), ["inst"], GATE_TAUS, 2)


@query("recover_tau", """SELECT tau, rejections, abs(rejections - want) AS error, CAST(rejections = want AS INTEGER) AS faithful FROM (
  SELECT g.tau, count(f.inst) AS rejections, (SELECT count(*) FROM gf WHERE is_keyframe = 1 AND vacuity >= 0.415) AS want
  FROM (SELECT (60 + 5 * i) / 1000.0::DOUBLE AS tau FROM range(119) t(i)) g LEFT JOIN (SELECT * FROM gf WHERE is_keyframe = 1) f ON f.vacuity >= g.tau GROUP BY g.tau)
ORDER BY abs(rejections - want), tau LIMIT 1""", ["gf"], "tau")
def _(spark, sf):
    g = V.gate_frames(spark, sf)
    want = g.where("is_keyframe = 1 AND vacuity >= 0.415").agg(F.count("*")).scalar()
    return gate.recover_tau(g, want)


@query("vacuity_summary", """SELECT count(*) AS n, avg((vacuity >= 0.2)::INTEGER::DOUBLE) AS share_020, avg((vacuity >= 0.4)::INTEGER::DOUBLE) AS share_040,
  min(vacuity) AS q_min, list_sort(list(vacuity))[CAST(floor(0.25 * count(*)) AS INTEGER) + 1] AS p25, list_sort(list(vacuity))[CAST(floor(0.5 * count(*)) AS INTEGER) + 1] AS p50,
  list_sort(list(vacuity))[CAST(floor(0.75 * count(*)) AS INTEGER) + 1] AS p75, list_sort(list(vacuity))[CAST(floor(0.95::DOUBLE * count(*)) AS INTEGER) + 1] AS p95, max(vacuity) AS q_max
FROM gf WHERE is_keyframe = 1""", ["gf"], "share_020 share_040 q_min p25 p50 p75 p95 q_max")
def _(spark, sf):
    return tables.vacuity_summary(V.gate_frames(spark, sf).where("is_keyframe = 1"), "vacuity", [0.2, 0.4])


_PROFILE = """ev AS (SELECT inst, frame, op, vacuity AS e FROM gf WHERE is_keyframe = 1),
 k AS (SELECT inst, frame, row_number() OVER (PARTITION BY inst ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY inst) AS n FROM
   (SELECT inst, frame, sum(e) AS s FROM ev GROUP BY ALL HAVING sum(e) > 0)),
 w AS (SELECT i.inst, o.op, i.n AS n_updates, pow(0.55, i.n) / 5 + coalesce(sum(0.45 * pow(0.55, k.n - 1 - k.k)), 0) AS w
   FROM (SELECT inst, max(n) AS n FROM k GROUP BY inst) i CROSS JOIN (SELECT CAST(x AS INTEGER) AS op FROM range(5) t(x)) o
   LEFT JOIN (SELECT ev.inst AS inst, ev.op AS op, k.n AS n, k.k AS k FROM ev JOIN k USING (inst, frame)) k
     ON k.inst = i.inst AND k.op = o.op GROUP BY i.inst, o.op, i.n)"""


@query("profile_ema", "SELECT * FROM (WITH " + _PROFILE
       + " SELECT inst, op, n_updates, w FROM w)", ["gf"], "w")
def _(spark, sf):
    ev = V.gate_frames(spark, sf).where("is_keyframe = 1").select(
        "inst", "frame", "op", F.col("vacuity").alias("e"))
    return gate.profile_weights(ev, ["inst"], 5)


@query("profile_summary", "SELECT inst, n_updates, leader, entropy, selected FROM (WITH " + _PROFILE
       + """ SELECT inst, max(n_updates) AS n_updates, min(op) FILTER (r = 1) AS leader, -sum(least(greatest(w, 1e-8), 1) * ln(least(greatest(w, 1e-8), 1))) / ln(5 + 1e-8) AS entropy,
  string_agg(CAST(op AS VARCHAR), '|' ORDER BY op) FILTER (r <= 3) AS selected FROM (SELECT *, row_number() OVER (PARTITION BY inst ORDER BY round(w, 12) DESC, op) AS r FROM w) GROUP BY inst)""",
       ["gf"], "entropy")
def _(spark, sf):
    ev = V.gate_frames(spark, sf).where("is_keyframe = 1").select(
        "inst", "frame", "op", F.col("vacuity").alias("e"))
    return gate.profile_summary(gate.profile_weights(ev, ["inst"], 5), ["inst"], 5, 2)
