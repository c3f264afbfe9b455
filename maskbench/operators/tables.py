"""Report tables over clip scores."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import is_main
from ..functions.ordered import median, quantiles, with_large
from ..session import materialise
from . import stats
from .bootstrap import bootstrap_ci
from .collapse import group_mean


def main_table(clips: DataFrame, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """Mean by condition and arm with the percentile interval over clips."""
    keys = ["degradation", "level", "mode"]
    clips = materialise(clips.select(*keys, "seq", "jf"))
    ci = bootstrap_ci(clips, keys, ["seq"], "jf", n_boot=n_boot, seed=seed)
    return group_mean(clips, keys).join(ci.select(*keys, "ci_lo", "ci_hi"), keys)


def pivot_with_deltas(clips: DataFrame, modes: Sequence[str], base: str) -> DataFrame:
    """Condition rows, one column per arm and its difference from the baseline arm."""
    wide = clips.groupBy("degradation", "level").pivot("mode", list(modes)).agg(F.avg("jf"))
    return wide.select("degradation", "level", *modes,
                       *[(F.col(m) - F.col(base)).alias(f"d_{m}") for m in modes])


def retention(clips: DataFrame) -> DataFrame:
    """Mean as a share of the same arm's clean mean; NULL where the clean mean is not positive."""
    means = group_mean(clips, ["degradation", "level", "mode"])
    clean = clips.where(F.col("degradation") == "clean").groupBy("mode").agg(
        F.avg("jf").alias("clean"))
    return means.join(clean, "mode").select(
        "degradation", "level", "mode", F.col("jf_mean").alias("jf"),
        F.when(F.col("clean") > 0, F.col("jf_mean") / F.col("clean")).alias("retention"))


def arm_order(arm: str = "arm"):
    """Natural order of arm names: A2 before A10, everything else last."""
    return F.coalesce(F.regexp_extract(arm, r"^A(\d+)", 1).try_cast("int"), F.lit(999))


def ablation_table(clips: DataFrame, reference: str = "A0") -> DataFrame:
    """Arm means and differences from the reference arm, with the natural arm order."""
    arms = group_mean(clips.where(~is_main("arm")), ["arm"])
    ref = clips.where(F.col("arm") == reference).agg(F.avg("jf")).scalar()
    return arms.select("arm", "jf_mean", "jf_std", "n",
                       (F.col("jf_mean") - ref).alias("delta_vs_ref"),
                       arm_order("arm").alias("arm_order"))


def ablation_report(clips: DataFrame, arms: Sequence[str], phase: Sequence[str],
                    reference: str = "A0", n_boot: int = 10000, seed: int = 0,
                    p_value: bool = True) -> DataFrame:
    """Each arm against the reference within a phase, read by effect size before p."""
    clips = materialise(clips.select(*phase, "seq", "arm", "jf", "n_encoder_calls"))
    pairs = stats.paired_values(clips, [*phase, "seq"], "arm", "jf", reference, list(arms))
    pairs = pairs.withColumnRenamed("method", "arm")
    rep = stats.paired_report(pairs, [*phase, "arm"], ["seq"], n_boot, seed, p_value)
    cost = clips.groupBy(*phase, "arm").agg(F.avg("n_encoder_calls").alias("n_encoder_calls"))
    rep = rep.join(cost, [*phase, "arm"])
    small = F.abs("cliffs_delta") < stats.NEGLIGIBLE_DELTA
    if not p_value:
        return rep.withColumn("material", (~small).cast("int"))
    rep = stats.holm(rep, phase, "wilcoxon_p")
    return rep.withColumn(
        "reading", F.when(small, "no material contribution")
        .when((F.col("holm_p") < 0.05) & (F.col("mean_delta") < 0), "worse")
        .when(F.col("holm_p") < 0.05, "better")
        .otherwise("non-negligible, not significant"))


def severity_grid(clips: DataFrame, n_boot: int = 5000, seed: int = 0) -> DataFrame:
    """Mean and interval by degradation, level and arm, labelled for plotting."""
    t = main_table(clips, n_boot, seed)
    return t.select("degradation", "level", "mode", F.col("n").alias("n_seq"), "jf_mean",
                    "ci_lo", "ci_hi")


def cost_summary(profile: DataFrame, base: str, mode: str = "mode") -> DataFrame:
    """Encoder calls per frame as a ratio of sums, mean speed, and cost against the baseline."""
    t = profile.groupBy(mode).agg(
        F.sum("n_frames").cast("bigint").alias("n_frames"),
        (F.sum("encoder_calls") / F.sum("n_frames")).alias("calls_per_frame"),
        F.avg("fps").alias("fps"), F.min("fps").alias("fps_min"), F.max("fps").alias("fps_max"))
    ref = t.where(F.col(mode) == base)
    return t.select(
        mode, "n_frames", "calls_per_frame", "fps", "fps_min", "fps_max",
        (F.col("calls_per_frame") / ref.select("calls_per_frame").scalar()).alias("rel_calls"),
        (F.col("fps") / ref.select("fps").scalar()).alias("rel_fps"))


def relative_cost(profile: DataFrame, base: str) -> DataFrame:
    """Encoder calls of each (clip, arm) over the baseline's calls on the same clip."""
    keys = ["seq", "degradation", "level"]
    ref = profile.where(F.col("mode") == base).select(*keys, F.col("encoder_calls").alias("_c"))
    return profile.join(ref, keys).select(
        *keys, "mode", (F.col("encoder_calls") / F.nullif(F.col("_c"), F.lit(0))).alias("rel_cost"))


def activity(cells: DataFrame, counter: str) -> DataFrame:
    """How often a mechanism fires: share of instances, cells and clips with a positive count."""
    inst = ["degradation", "seq", "obj_id"]
    per_inst = cells.groupBy(*inst).agg(F.max(F.col(counter) > 0).alias("f"))
    per_cell = per_inst.groupBy("degradation", "seq").agg(F.max("f").alias("f"))
    per_seq = per_cell.groupBy("seq").agg(F.max("f").alias("f"))

    def count(df: DataFrame, level: str) -> DataFrame:
        return df.agg(F.count_if("f").alias("fired"), F.count("*").alias("total")).select(
            F.lit(level).alias("level"), "fired", "total",
            (F.col("fired") / F.col("total")).alias("share"))

    return count(per_inst, "instance").unionByName(count(per_cell, "cell")).unionByName(
        count(per_seq, "sequence"))


def activity_distribution(cells: DataFrame, counter: str) -> DataFrame:
    return cells.groupBy(F.col(counter).cast("bigint").alias("count")).agg(
        F.count("*").alias("n_instances"))


def activity_effect(pairs: DataFrame, counter: str, delta: str = "d") -> DataFrame:
    """Mean paired difference by firing band; the bands share one pass."""
    band = F.when(F.col(counter) <= 0, "0").when(F.col(counter) <= 3, "1-3").otherwise("4+")
    return pairs.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.avg(delta).alias("mean_delta"),
        F.count_if(F.abs(delta) <= 0.02).alias("n_small"),
        F.count_if(F.abs(delta) >= 0.1).alias("n_large"),
        F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"))


def activity_correlation(pairs: DataFrame, counter: str, delta: str = "d") -> DataFrame:
    """Product-moment and rank correlation of the firing count with the paired difference."""
    d = pairs.withColumn("_all", F.lit("all"))
    r = stats.product_moment(d, ["_all"], counter, delta)
    rho = stats.rank_correlation(d, ["_all"], counter, delta).select("rho").scalar()
    return r.select("n", "r", rho.alias("rho"))


def probe_summary(pairs: DataFrame, keys: Sequence[str], delta: str = "d",
                  fired: str | None = None) -> DataFrame:
    """Paired differences with the mean that remains without the single largest one."""
    n, total = F.count(delta), F.sum(delta)
    aggs = [n.alias("n"), F.avg(delta).alias("mean_delta"),
            F.count_if(F.col(delta) > 0).alias("wins"),
            F.count_if(F.abs(delta) <= 0.02).alias("n_near"),
            F.min(delta).alias("min_delta"), F.max(delta).alias("max_delta"),
            F.when(n > 1, (total - F.max(delta)) / (n - 1)).otherwise(total)
            .alias("mean_without_largest")]
    if fired:
        aggs += [F.avg(F.when(F.col(fired) > 0, F.col(delta))).alias("mean_fired"),
                 F.avg(F.when(F.col(fired) == 0, F.col(delta))).alias("mean_quiet")]
    return pairs.groupBy(*keys).agg(*aggs).join(median(pairs, keys, delta, "median_delta"),
                                                list(keys))


def iqa_cell_summary(frames: DataFrame, metrics: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Mean, population std, p10 and p90 of every image metric per cell, in long form."""
    probs = {"p10": 0.1, "p90": 0.9}
    if not keys:
        return _long_cell_summary(frames, metrics, keys, probs)
    d = with_large(frames.select(*keys, *[F.col(m).cast("double").alias(f"_x{i}") for i, m in enumerate(metrics)]), keys)
    large = d.where(F.col("_large")).select(*keys, *[F.col(f"_x{i}").alias(m) for i, m in enumerate(metrics)])
    xs = [F.col(f"_x{i}") for i in range(len(metrics))]
    # small cells meet once for all metrics, each as one sorted list of values
    g = d.where(F.col("_large").isNull()).groupBy(*keys).agg(*[e for i, x in enumerate(xs) for e in (
        F.avg(x).alias(f"_m{i}"), F.stddev_pop(x).alias(f"_s{i}"), F.count(x).alias(f"_n{i}"),
        F.sort_array(F.collect_list(F.when(~F.isnan(x), x))).alias(f"_l{i}"))])

    def at(values: Column, q: float) -> Column:
        pos = F.lit(q) * (F.size(values) - 1)
        a, b = (F.get(values, f(pos).cast("int")) for f in (F.floor, F.ceil))
        return a + (b - a) * (pos - F.floor(pos))

    out = g.select(*keys, F.inline(F.array(*[F.struct(
        F.lit(m).alias("metric"), F.col(f"_m{i}").alias("mean"), F.col(f"_s{i}").alias("std"), F.col(f"_n{i}").alias("n"),
        *[at(F.col(f"_l{i}"), q).alias(p) for p, q in probs.items()]) for i, m in enumerate(metrics)]))).where(F.col("p10").isNotNull())
    return out.unionByName(_long_cell_summary(large, metrics, keys, probs))


def _long_cell_summary(frames: DataFrame, metrics: Sequence[str], keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """The same for cells of any size: no task holds a cell."""
    rows = stats.metric_rows(frames, metrics, keys)
    k = [*keys, "metric"]
    m = rows.groupBy(*k).agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"),
                             F.count("*").alias("n"))
    return m.join(quantiles(rows, k, "x", probs), k)


def vacuity_summary(frames: DataFrame, score: str, taus: Sequence[float]) -> DataFrame:
    """Nearest-index quantiles of the score over decision frames and the share at each tau."""
    d = frames.where(F.col(score).isNotNull()).withColumn("_all", F.lit("all"))
    q = quantiles(d, ["_all"], score, {"q_min": 0.0, "p25": 0.25, "p50": 0.5, "p75": 0.75,
                                       "p95": 0.95, "q_max": 1.0}, method="index")
    share = d.groupBy("_all").agg(F.count("*").alias("n"), *[
        F.avg((F.col(score) >= t).cast("double")).alias(f"share_{int(round(t * 100)):03d}")
        for t in taus])
    names = [c for c in q.columns if c != "_all"]
    row = q.select(F.struct(*names)).scalar()
    return share.drop("_all").withColumn("_q", row).select(
        *[c for c in share.columns if c != "_all"], *[F.col(f"_q.{c}").alias(c) for c in names])


def policy_summary(cells: DataFrame, policy: str, value: str, runaway: str, failures: str
                   ) -> DataFrame:
    """Mean, median and worst score of each policy with its runaways and failures."""
    s = cells.groupBy(policy).agg(
        F.count("*").alias("cells"), F.avg(value).alias("mean"), F.min(value).alias("worst"),
        F.sum(runaway).cast("bigint").alias("runaways"),
        F.sum(failures).cast("bigint").alias("failures"))
    return s.join(median(cells, [policy], value), policy)


def policy_verdict(pairs: DataFrame, keys: Sequence[str], tol: float = 1e-9,
                   label: str = "seq") -> DataFrame:
    """Improved, worse and unchanged pairs, and the pairs that gain and lose the most."""
    name = F.struct(F.col("d").alias("d"), F.col(label).alias("l"))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("d").alias("mean_delta"),
        F.count_if(F.col("d") > tol).alias("improved"),
        F.count_if(F.col("d") < -tol).alias("worse"),
        F.count_if(F.abs("d") <= tol).alias("unchanged"),
        F.max(name)["l"].alias("best_at"), F.max("d").alias("best_delta"),
        F.min(name)["l"].alias("worst_at"), F.min("d").alias("worst_delta"))


def sweep_arms(clips: DataFrame) -> DataFrame:
    """Split arm names such as ``A8=5`` into sweep and value; other arms drop out."""
    parts = F.split("arm", "=")
    return clips.where(F.size(parts) == 2).select(
        "*", parts[0].alias("sweep"), parts[1].try_cast("double").cast("int").alias("variant")
    ).where(F.col("variant").isNotNull())


def sweep_report(clips: DataFrame, defaults: dict[str, int], n_boot: int = 10000, seed: int = 0,
                 p_value: bool = True) -> DataFrame:
    """Each variant against its sweep's default, Holm within the sweep, and its decidability."""
    d = sweep_arms(clips)
    default = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))])
    d = d.withColumn("_is_ref", F.col("variant") == default[F.col("sweep")])
    ref = d.where("_is_ref").select("sweep", "seq", F.col("jf").alias("a"))
    pairs = d.where(~F.col("_is_ref")).select("sweep", "variant", "seq", F.col("jf").alias("b"))
    pairs = stats.with_difference(pairs.join(ref, ["sweep", "seq"]))
    rep = stats.paired_report(pairs, ["sweep", "variant"], ["seq"], n_boot, seed, p_value)
    if not p_value:
        return rep
    rep = stats.holm(rep, ["sweep"], "wilcoxon_p")
    return rep.withColumn("decidable", ((F.col("holm_p") < 0.05) & (
        F.abs("cliffs_delta") >= stats.NEGLIGIBLE_DELTA)).cast("int"))


def sweep_default_spread(clips: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Means of the default variants: equal if the runs are deterministic."""
    d = sweep_arms(clips)
    hit = F.lit(False)
    for k, v in defaults.items():
        hit = hit | ((F.col("sweep") == k) & (F.col("variant") == v))
    m = d.where(hit).groupBy("sweep").agg(F.avg("jf").alias("m"))
    return m.agg(F.count("*").alias("n_sweeps"), F.min("m").alias("lo"), F.max("m").alias("hi"),
                 (F.max("m") - F.min("m")).alias("spread"))


def correlation_verdict(table: DataFrame, threshold: float = stats.USABLE_RHO) -> DataFrame:
    """Largest |rho| over arms, metrics and views, where it is, and whether any is usable."""
    views = table.select("mode", "metric", F.inline(F.array(
        F.struct(F.lit("across").alias("view"), F.col("across_rho").alias("rho")),
        F.struct(F.lit("within").alias("view"), F.col("within_mean_rho").alias("rho")))))
    place = F.concat_ws("/", "mode", "metric", "view")
    key = F.struct(F.round(F.abs("rho"), 12).alias("r"), place.alias("p"))
    return views.where(F.col("rho").isNotNull()).agg(
        F.max(F.abs("rho")).alias("max_abs_rho"), F.max(key)["p"].alias("max_at"),
        F.max((F.abs("rho") >= threshold).cast("int")).alias("any_usable"))


def intervals_reaching(table: DataFrame, threshold: float = stats.USABLE_RHO) -> DataFrame:
    """Rows whose interval reaches the threshold: not usable, yet not excluded either."""
    return table.where(F.greatest(F.abs("ci_lo"), F.abs("ci_hi")) >= threshold)


def silent_cells(cells: DataFrame, counter: str, by: Sequence[str]) -> DataFrame:
    """Cells in which a mechanism never fired, out of all cells."""
    return cells.groupBy(*by).agg(F.count_if(F.coalesce(F.col(counter), F.lit(0)) == 0)
                                  .alias("silent"), F.count("*").alias("cells"))


def series(clips: DataFrame, by: Sequence[str]) -> DataFrame:
    """Points of a curve or bar chart: mean, population std and count."""
    return group_mean(clips, by)


def efficiency_series(clips: DataFrame) -> DataFrame:
    """Mean encoder cost against mean score by arm."""
    return clips.groupBy("mode").agg(F.avg("n_encoder_calls").alias("mean_calls"),
                                     F.avg("jf").alias("mean_jf"), F.count("*").alias("n"))
