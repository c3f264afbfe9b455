"""Paired tests, effect sizes, multiple-comparison correction and association studies."""

from __future__ import annotations

from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.keys import c, hash32
from ..functions.ordered import (average_rank, hash_chunk, median, ordinal, rank_table, running,
                                 spread, value_chunk)
from ..functions.tails import EXACT_MAX_N, rank_correlation_p_udf, signed_rank_p_udf
from ..kernels.draws import Draws
from ..session import materialise
from .bootstrap import bootstrap_ci, rank_correlation, unit_bootstrap_rho
from .sign_flip import sign_flip_test  # noqa: F401

USABLE_RHO = 0.6  # fixed value: |rho| from which a metric could drive a choice
NEGLIGIBLE_DELTA = 0.147  # fixed value: |Cliff's delta| below it is negligible
GAP_DIGITS = 12  # differences are compared after this rounding, so ties do not depend on order


def paired_values(df: DataFrame, unit: Sequence[str], arm: str, value: str, base: str,
                  other: str | Sequence[str]) -> DataFrame:
    """Inner pairing of arms on ``unit`` by one aggregation instead of a self join.

    One row per (unit, other arm) with ``a`` (base), ``b`` (other) and ``d = b - a``. A unit that has
    an arm twice fails the job.
    """
    others = [other] if isinstance(other, str) else list(other)

    def single(m: str):
        of = F.when(F.col(arm) == m, F.col(value))
        twice = F.raise_error(F.lit(f"arm {m!r} has a unit twice")).cast("double")
        return F.when(F.count(of) > 1, twice).otherwise(F.max(of))

    wide = df.where(F.col(arm).isin([base, *others])).groupBy(*unit).agg(
        single(base).alias("a"), *[single(o).alias(f"_b{i}") for i, o in enumerate(others)])
    pairs = F.array(*[F.struct(F.lit(o).alias("method"), F.col(f"_b{i}").alias("b"))
                      for i, o in enumerate(others)])
    long = wide.where(F.col("a").isNotNull()).select(*unit, "a", F.inline(pairs))
    return with_difference(long.where(F.col("b").isNotNull()))


def with_difference(pairs: DataFrame) -> DataFrame:
    """Round ``a`` and ``b`` and add ``d = b - a``, so that ties are ties in any order."""
    return pairs.withColumns({"a": F.round("a", GAP_DIGITS), "b": F.round("b", GAP_DIGITS),
                              "d": F.round(F.col("b") - F.col("a"), GAP_DIGITS)})


def signed_rank(pairs: DataFrame, keys: Sequence[str], diff: str = "d") -> DataFrame:
    """Wilcoxon signed-rank sums; zero differences are dropped before ranking.

    ``n`` counts the non-zero differences, ``w_stat`` is the smaller rank sum.
    """
    d = pairs.where(F.col(diff).isNotNull()).withColumn("_abs", F.abs(F.col(diff)))
    zeros = d.groupBy(*keys).agg(F.count_if(F.col(diff) == 0).alias("n_zero"))
    r = rank_table(d.where(F.col(diff) != 0), keys, "_abs", {
        "n": F.lit(1).cast("bigint"),
        "_pos": F.when(F.col(diff) > 0, 1).otherwise(0).cast("bigint"),
    })
    avg = average_rank("n")
    sums = r.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(avg * F.col("_pos")).alias("w_plus"),
        F.sum(avg * (F.col("n") - F.col("_pos"))).alias("w_minus"),
        F.sum((F.col("n") * F.col("n") * F.col("n") - F.col("n")).cast("double")).alias("tie_sum"),
    )
    out = zeros.join(sums, list(keys), "left")
    return out.select(
        *keys,
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        "n_zero",
        "w_plus",
        "w_minus",
        F.least("w_plus", "w_minus").alias("w_stat"),
        F.coalesce("tie_sum", F.lit(0.0)).alias("tie_sum"),
    )


def with_signed_rank_p(df: DataFrame, name: str = "wilcoxon_p", exact_max_n: int = EXACT_MAX_N
                       ) -> DataFrame:
    """Add the p value to signed-rank sums, and in ``p_method`` how it was found.

    ``exact`` counts the null distribution: up to ``exact_max_n`` pairs without ties or zeros.
    ``normal`` is the tie-corrected approximation, ``none`` has no non-zero difference (p is 1).
    """
    exact = (F.col("n") <= exact_max_n) & (F.col("tie_sum") == 0) & (F.col("n_zero") == 0)
    return df.withColumn(name, signed_rank_p_udf("n", "w_stat", "tie_sum", exact)).withColumn(
        "p_method", F.when(F.col("n") == 0, "none").when(exact, "exact").otherwise("normal"))


def cliffs_delta(df: DataFrame, keys: Sequence[str], side: str, value: str, base: str,
                 other: str) -> DataFrame:
    """P(other > base) - P(other < base) over all cross pairs, by ranks instead of pairs."""
    d = df.where(F.col(side).isin(base, other))
    r = rank_table(d, keys, value, {
        "na": F.when(F.col(side) == base, 1).otherwise(0).cast("bigint"),
        "nb": F.when(F.col(side) == other, 1).otherwise(0).cast("bigint"),
    })
    above = F.col("na_before")
    below = F.col("na_total") - F.col("na_before") - F.col("na")
    total = (F.max("na_total") * F.max("nb_total")).cast("double")
    return r.groupBy(*keys).agg(
        F.when(total > 0, F.sum(F.col("nb") * (above - below)) / total).alias("cliffs_delta"))


def paired_cliffs_delta(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cliff's delta of the two columns of paired rows (the definition itself is unpaired)."""
    sides = pairs.select(*keys, F.inline(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("v")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("v")))))
    return cliffs_delta(sides, keys, "side", "v", "a", "b")


def holm(df: DataFrame, family: Sequence[str], p: str, name: str = "holm_p") -> DataFrame:
    """Holm step-down adjusted p within a family; the running maximum keeps it monotone."""
    d = df.where(F.col(p).isNotNull()).withColumn("_tie", hash32(*[x for x in df.columns]))
    d = ordinal(d, family, [p, "_tie"], value_chunk(p), name="_r", count="_m")
    d = running(d, family, ["_r"], value_chunk(p),
                maxes={name: (F.col("_m") - F.col("_r")) * F.col(p)})
    return d.withColumn(name, F.least(F.lit(1.0), F.col(name))).drop("_r", "_m", "_tie")


def paired_summary(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, mean, extremes, wins and losses of paired differences."""
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.avg("a").alias("mean_base"),
        F.avg("b").alias("mean_method"),
        F.avg("d").alias("mean_delta"),
        F.min("d").alias("min_delta"),
        F.max("d").alias("max_delta"),
        F.count_if(F.col("d") > 0).alias("wins"),
        F.count_if(F.col("d") < 0).alias("losses"),
    )


def paired_report(pairs: DataFrame, keys: Sequence[str], unit: Sequence[str],
                  n_boot: int = 10000, seed: int = 0, p_value: bool = True) -> DataFrame:
    """One row per comparison: size, location, interval, signed-rank test, effect size."""
    keys = list(keys)
    pairs = materialise(pairs.select(*keys, *unit, "a", "b", "d"))
    ci = bootstrap_ci(pairs, keys, unit, "d", n_boot=n_boot, seed=seed)
    w = signed_rank(pairs, keys)
    if p_value:
        w = with_signed_rank_p(w)
    out = (
        paired_summary(pairs, keys)
        .join(median(pairs, keys, "d", "median_delta"), keys)
        .join(ci.select(*keys, "ci_lo", "ci_hi"), keys)
        .join(w.withColumnRenamed("n", "n_nonzero").drop("tie_sum", "n_zero"), keys)
        .join(paired_cliffs_delta(pairs, keys), keys)
    )
    return out


def corrected_report(pairs: DataFrame, family: Sequence[str], test: Sequence[str],
                     unit: Sequence[str], n_boot: int = 10000, seed: int = 0) -> DataFrame:
    """Paired reports of a family of tests with Holm-adjusted p and the significance flag."""
    rep = paired_report(pairs, [*family, *test], unit, n_boot, seed)
    out = holm(rep, family, "wilcoxon_p")
    return out.withColumn("significant", (F.col("holm_p") < 0.05).cast("int"))


def metric_rows(df: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to (metric, x) rows; missing values are left out."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics
    ]))).where(F.col("x").isNotNull())


def correlation_table(df: DataFrame, keys: Sequence[str], x: str, y: str, unit: Sequence[str],
                      n_boot: int = 0, min_rows: int = 10, seed: int = 0,
                      p_value: bool = True) -> DataFrame:
    """Rho, explained share and the verdict by effect size; interval and p on request."""
    rho = rank_correlation(df, keys, x, y).where(F.col("n") >= min_rows)
    out = rho.select(*keys, "n", "rho", (F.col("rho") * F.col("rho")).alias("r2"),
                     (F.abs("rho") >= USABLE_RHO).cast("int").alias("usable"))
    if p_value:
        out = out.withColumn("p", rank_correlation_p_udf("rho", "n"))
    if n_boot:
        out = out.join(unit_bootstrap_rho(df, keys, unit, x, y, n_boot, seed=seed), list(keys))
    return out


def metric_kind(metric: Column | str, full_reference: Sequence[str]) -> Column:
    return F.when(c(metric).isin(list(full_reference)), "full-reference").otherwise("no-reference")


def interval_comparison(naive: DataFrame, clustered: DataFrame, keys: Sequence[str], n: str = "n"
                        ) -> DataFrame:
    """Width of the naive interval over the clustered one and the effective sample size."""
    b = clustered.select(*keys, (F.col("ci_hi") - F.col("ci_lo")).alias("width_clustered"))
    a = naive.select(*keys, n, (F.col("ci_hi") - F.col("ci_lo")).alias("width_naive"))
    r = F.col("width_naive") / F.nullif(F.col("width_clustered"), F.lit(0.0))
    return a.join(b, list(keys)).withColumn("width_ratio", r).withColumn(
        "n_eff", F.round(F.col(n) * F.col("width_ratio") * F.col("width_ratio")).cast("bigint"))


def across_within(df: DataFrame, keys: Sequence[str], stratum: str, x: str, y: str,
                  min_rows: int = 8) -> DataFrame:
    """Pooled rho next to the mean, least and greatest rho of the strata."""
    pooled = rank_correlation(df, keys, x, y)
    inner = rank_correlation(df, [*keys, stratum], x, y).where(F.col("n") >= min_rows)
    within = inner.groupBy(*keys).agg(
        F.avg("rho").alias("within_mean_rho"), F.min("rho").alias("within_min_rho"),
        F.max("rho").alias("within_max_rho"), F.count("rho").alias("within_n"))
    return pooled.withColumnRenamed("rho", "across_rho").join(within, list(keys), "left")


def level_trend(df: DataFrame, unit: Sequence[str], level: str, value: str,
                cell: Sequence[str]) -> DataFrame:
    """Rank trend of the score along the level inside every unit, and the endpoint drop."""
    keys = [*cell, *unit]
    rho = rank_correlation(df, keys, level, value)
    ends = df.groupBy(*keys).agg((F.max_by(value, level) - F.min_by(value, level)).alias("drop"))
    return rho.join(ends, keys)


def unit_means(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str
               ) -> DataFrame:
    return df.groupBy(*keys, *unit).agg(F.avg(x).alias("x"), F.avg(y).alias("y"),
                                        F.count("*").alias("n_obs"))


def between_association(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str,
                        n_perm: int = 1000, seed: int = 0, min_units: int = 5) -> DataFrame:
    """Rho of unit means with a permutation p: (draws at least as extreme + 1) / (N + 1).

    A permutation pairs the y at position i with the x whose keyed hash is the i-th smallest. Keys with
    fewer than ``min_units`` units are refused: they give no row.
    """
    keys = list(keys)
    um = unit_means(df, keys, unit, x, y).withColumn("_h", hash32(*unit))
    um = ordinal(um, keys, ["_h", *unit], hash_chunk("_h"), "pos", "n_units").where(F.col("n_units") >= min_units)
    um = materialise(um.orderBy(*keys, *unit).withColumn("_u", F.monotonically_increasing_id()))
    obs = rank_correlation(um, keys, "x", "y")
    null = _permuted(um.where(F.col("n_units") <= WHOLE_PERMUTATION), keys, unit, n_perm, seed)
    large = um.where(F.col("n_units") > WHOLE_PERMUTATION)
    if large.limit(1).count():
        null = null.unionByName(_permuted_in_chunks(large, keys, unit, n_perm, seed))
    # the observed rho joins its permutations as number -1: n_perm + 1 rows per key
    both = null.unionByName(obs.select(*keys, F.lit(-1).alias("perm"), "n", "rho"))
    seen = F.max(F.when(F.col("perm") == -1, F.struct("n", "rho"))).over(W.partitionBy(*keys))
    j = both.withColumn("_o", seen)
    drawn = F.col("perm") >= 0
    extreme = drawn & (F.abs("rho") >= F.abs(F.col("_o.rho")) - F.lit(1e-12))
    return j.groupBy(*keys, F.col("_o.n").alias("n_units"), F.col("_o.rho").alias("_r")).agg(
        ((F.count_if(extreme) + 1) / (F.count_if(drawn) + 1)).alias("perm_p")).withColumnRenamed(
        "_r", "rho")


#: Units of a key up to which one task orders a whole permutation (about 150 bytes a unit), and permutations of a task.
WHOLE_PERMUTATION, PERMUTATIONS_AT_ONCE = 1 << 21, 25


def _permuted(um: DataFrame, keys: Sequence[str], unit: Sequence[str], n_perm: int, seed: int) -> DataFrame:
    """(keys, perm, n, rho) of all permutations; units meet once for PERMUTATIONS_AT_ONCE of them."""
    tail = F.concat_ws("|", F.lit(""), *[F.col(u).cast("string") for u in unit])
    groups = F.sequence(F.lit(0), F.lit((n_perm - 1) // PERMUTATIONS_AT_ONCE))
    d = um.select(*keys, "pos", "_u", tail.alias("_t"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    d = spread(d, [*keys, "_u"]).withColumn("_g", F.explode(groups))

    def centred(v: np.ndarray) -> np.ndarray:
        """Twice the average-tie ranks less their mean."""
        _, at, times = np.unique(v, return_inverse=True, return_counts=True)
        upto = np.cumsum(times)
        return (2 * upto - times - len(v))[at].astype(float)

    def rho(a: np.ndarray, b: np.ndarray) -> float | None:
        aa, bb = np.einsum("i,i->", a, a), np.einsum("i,i->", b, b)
        return float(np.einsum("i,i->", a, b) / np.sqrt(aa) / np.sqrt(bb)) if len(a) >= 4 and aa > 0 and bb > 0 else None

    def group(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(t.column("_u").to_numpy())))
        x, y_of = (t.column(c).to_numpy() for c in ("x", "y"))
        y = np.empty(len(x))
        y[t.column("pos").to_numpy()] = y_of
        whole = not (np.isnan(x).any() or np.isnan(y).any())
        if whole:
            x, y = centred(x), centred(y)
        draws = Draws(t.column("_t").combine_chunks(), seed)
        lo = t.column("_g")[0].as_py() * PERMUTATIONS_AT_ONCE
        perms, n, found = range(lo, min(lo + PERMUTATIONS_AT_ONCE, n_perm)), [], []
        for k in perms:
            # units are in their order, which settles equal hashes
            a, b = x[np.argsort(draws.first_bits(k), kind="stable")], y
            if not whole:
                kept = ~(np.isnan(a) | np.isnan(b))
                a, b = centred(a[kept]), centred(b[kept])
            n.append(len(a))
            found.append(rho(a, b))
        first = pa.array(np.zeros(len(perms), np.int64))
        return pa.table([*[t.column(k).take(first) for k in keys], pa.array(perms, pa.int32()), pa.array(n, pa.int64()), pa.array(found, pa.float64())],
                        names=[*keys, "perm", "n", "rho"])

    of_keys = "".join(f"`{k}` {um.schema[k].dataType.simpleString()}, " for k in keys)
    return d.repartition(int(um.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_g").groupBy(*keys, "_g").applyInArrow(
        group, of_keys + "perm int, n long, rho double")


def _permuted_in_chunks(um: DataFrame, keys: Sequence[str], unit: Sequence[str], n_perm: int, seed: int) -> DataFrame:
    """The same for keys of any size: no task holds a permutation."""
    shuffled = spread(um, [*keys, *unit]).select(*keys, *unit, "x", F.explode(
        F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    shuffled = shuffled.withColumn("_g", hash32(F.lit(seed), "perm", *unit))
    placed = ordinal(shuffled, [*keys, "perm"], ["_g", *unit], hash_chunk("_g"), "pos")
    return rank_correlation(
        placed.select(*keys, "perm", "pos", "x").join(um.select(*keys, "pos", "y"),
                                                      [*keys, "pos"]),
        [*keys, "perm"], "x", "y")


def within_association(df: DataFrame, keys: Sequence[str], unit: Sequence[str], x: str, y: str,
                       min_rows: int = 10, p_value: bool = True) -> DataFrame:
    """Rho inside every unit; their mean, the positive share, and a signed-rank test of zero."""
    rho = rank_correlation(df, [*keys, *unit], x, y)
    rho = rho.where((F.col("n") >= min_rows) & F.col("rho").isNotNull()).withColumn(
        "d", F.round("rho", GAP_DIGITS))
    out = rho.groupBy(*keys).agg(
        F.count("*").alias("n_units"), F.avg("rho").alias("within_rho"),
        F.avg((F.col("d") > 0).cast("double")).alias("share_positive"))
    w = signed_rank(rho, keys)
    if p_value:
        w = with_signed_rank_p(w)
    return out.join(w.drop("n", "n_zero", "tie_sum"), list(keys))


def threshold_sweep(df: DataFrame, score: str, error: str, taus: Sequence[float],
                    min_side: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean error at or above and below every threshold, both sides large enough.

    A row is counted once, in the bucket of the thresholds that it reaches; the few buckets are then
    added up per threshold.
    """
    ts = sorted(set(float(t) for t in taus))
    reached = sum([(F.col(score) >= F.lit(t)).cast("int") for t in ts], F.lit(0))
    d = df.where(F.col(score).isNotNull()).groupBy(*keys, reached.alias("_r")).agg(
        F.sum(error).alias("_s"), F.count(error).alias("_k"), F.count("*").alias("_n"))
    d = d.select(*keys, "_r", "_s", "_k", "_n", F.posexplode(F.array(*[F.lit(t) for t in ts])).alias("_i", "tau"))
    hi = F.col("_r") > F.col("_i")

    def mean(side: Column) -> Column:
        k = F.sum(F.when(side, F.col("_k")))
        return F.sum(F.when(side, F.col("_s"))) / F.nullif(k, F.lit(0))

    out = d.groupBy(*keys, "tau").agg(
        mean(hi).alias("mean_err_high"), mean(~hi).alias("mean_err_low"),
        F.sum(F.when(hi, F.col("_n")).otherwise(0)).alias("n_high"),
        F.sum(F.when(~hi, F.col("_n")).otherwise(0)).alias("n_low"))
    return out.where((F.col("n_high") >= min_side) & (F.col("n_low") >= min_side)).withColumn(
        "gap", F.col("mean_err_high") - F.col("mean_err_low"))


def rank_auc(df: DataFrame, keys: Sequence[str], score: str, good: Column | str) -> DataFrame:
    """AUC of a score for the good rows by average-tie ranks, with the two score means."""
    d = df.withColumn("_good", c(good).cast("int"))
    r = rank_table(d, keys, score, {
        "n": F.lit(1).cast("bigint"), "pos": F.col("_good").cast("bigint")})
    s, n_pos = F.col(score), F.max("pos_total")
    n_neg = F.max("n_total") - F.max("pos_total")
    u = F.sum(average_rank("n") * F.col("pos")) - n_pos * (n_pos + 1) / F.lit(2.0)
    return r.groupBy(*keys).agg(
        n_pos.alias("n_good"), n_neg.alias("n_bad"),
        F.when((n_pos > 0) & (n_neg > 0), u / (n_pos * n_neg)).alias("auc"),
        (F.sum(s * F.col("pos")) / F.nullif(F.sum("pos"), F.lit(0))).alias("score_good"),
        (F.sum(s * (F.col("n") - F.col("pos"))) / F.nullif(F.sum(F.col("n") - F.col("pos")),
                                                          F.lit(0))).alias("score_bad"))


def product_moment(df: DataFrame, keys: Sequence[str], x: str, y: str, min_rows: int = 3
                   ) -> DataFrame:
    """Pearson's r per key; NULL below ``min_rows`` or without spread."""
    a = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.corr(F.col(x).cast("double"), F.col(y).cast("double"))
        .alias("_r"), F.max(x).alias("_mx"), F.min(x).alias("_nx"), F.max(y).alias("_my"),
        F.min(y).alias("_ny"))
    ok = (F.col("n") >= min_rows) & (F.col("_mx") > F.col("_nx")) & (F.col("_my") > F.col("_ny"))
    return a.select(*keys, "n", F.when(ok, F.col("_r")).alias("r"))


def null_calibration(df: DataFrame, unit: Sequence[str], y: str, row_id: Sequence[str],
                     kind: str = "null", replicates: int = 20, n_boot: int = 50,
                     seed: int = 0) -> DataFrame:
    """False-positive rate of the frame-level interval under a planted signal.

    ``kind``: ``null`` draws x at random, ``between`` sets it to the unit mean of y, ``within``
    to the deviation from that mean plus a unit-level jitter. Each replicate is a key, so the
    replicates run side by side.
    """
    d = df.where(F.col(y).isNotNull()).select(*unit, *row_id, F.col(y).alias("_y"))
    mu = d.groupBy(*unit).agg(F.avg("_y").alias("_mu"))
    e = spread(d.join(mu, list(unit)), [*unit, *row_id]).withColumn(
        "rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    u01 = hash32(F.lit(seed), "rep", *unit, *row_id) / F.lit(float(1 << 32))
    jitter = hash32(F.lit(seed + 1), "rep", *unit) / F.lit(float(1 << 32))
    x = {"null": u01, "between": F.col("_mu"),
         "within": (F.col("_y") - F.col("_mu")) + 4.0 * jitter + 0.01 * u01}[kind]
    e = e.withColumn("_x", x)
    rho = rank_correlation(e, ["rep"], "_x", "_y")
    ci = unit_bootstrap_rho(e, ["rep"], [*unit, *row_id], "_x", "_y", n_boot, seed=seed)
    j = rho.join(ci, "rep")
    fires = ((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)).cast("double")
    return j.agg(F.count("*").alias("replicates"), F.avg("rho").alias("mean_rho"),
                 F.avg(fires).alias("rejection_rate"))
