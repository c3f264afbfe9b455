"""Per-instance frame order: trajectories, schedules, the rejection gate and the profile."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.keys import c
from ..functions.ordered import number_chunk, ordinal, running

RUNAWAY_RATIO = 3.0  # fixed value: predicted over true area that counts as runaway

# Arms that never decide, and arms that decide on every frame.
NEVER_DECIDE = ("greedy", "greedy_gate", "greedy_reseed", "greedy_robust", "oracle_clean",
                "cascade", "fixed_op")
ALWAYS_DECIDE = ("equal_tta", "random_op")


def runaway_onset(df: DataFrame, keys: Sequence[str], ratio: str = "area_ratio",
                  frame: str = "frame", marks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """First frame past the ratio (-1 if none), the ratio at marked frames, last and peak."""
    r, f = F.col(ratio), F.col(frame)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.coalesce(F.min(F.when(r > RUNAWAY_RATIO, f)), F.lit(-1)).alias("onset"),
        *[F.max(F.when(f == m, r)).alias(f"r{m}") for m in marks],
        F.max_by(r, f).alias("r_last"), F.max(r).alias("peak"))


def trajectory_parts(df: DataFrame, keys: Sequence[str], value: str, frame: str = "frame",
                     parts: int = 10) -> DataFrame:
    """Mean score of each tenth of a trajectory; the first parts take the extra frames."""
    d = ordinal(df, keys, [frame], number_chunk(frame), "_pos", "_n")
    k = F.least(F.lit(parts), F.col("_n"))
    q, r = F.floor(F.col("_n") / k), F.col("_n") % k
    head = r * (q + 1)
    part = F.when(F.col("_pos") < head, F.floor(F.col("_pos") / (q + 1))).otherwise(
        r + F.floor((F.col("_pos") - head) / q))
    return d.groupBy(*keys, (part + 1).cast("int").alias("part")).agg(
        F.avg(value).alias("mean"), F.count("*").alias("n"))


def area_summary(df: DataFrame, keys: Sequence[str], ratio: str = "area_ratio",
                 score: str = "jf_frame", frame: str = "frame") -> DataFrame:
    """Area ratio without the given first frame: first, last, max, mean and the runaway flag."""
    later = F.col(frame) > 0
    r = F.when(later, F.col(ratio))
    at = F.when(later & F.col(ratio).isNotNull(), F.col(frame))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_frames"), F.avg(score).alias("jf"),
        F.avg(F.when(later, F.col(score))).alias("jf_later"),
        F.min_by(ratio, at).alias("area_first"), F.max_by(ratio, at).alias("area_last"),
        F.max(r).alias("area_max"), F.avg(r).alias("area_mean"),
        F.coalesce((F.max(r) > RUNAWAY_RATIO).cast("int"), F.lit(0)).alias("runaway"))


def decision_frame(frame: Column | str, every: int, mode: Column | str | None = None) -> Column:
    """Whether an arm takes a decision on a frame; frame 0 is given and never decided."""
    f = c(frame)
    grid = (f > 0) & ((f % every == 0) | (f == 1))
    if mode is None:
        return grid
    m = c(mode)
    return F.when(m.isin(list(NEVER_DECIDE)), False).when(
        m.isin(list(ALWAYS_DECIDE)), f > 0).otherwise(grid)


def reseed_anchor(frame: Column | str, stride: int) -> Column:
    """Frame whose state a reseeding arm starts from: the last multiple of the stride."""
    return c(frame) - c(frame) % stride if stride else F.lit(0)


def reseed_counts(df: DataFrame, keys: Sequence[str], stride: int, frame: str = "frame"
                  ) -> DataFrame:
    hit = (F.col(frame) > 0) & (F.col(frame) % stride == 0) if stride else F.lit(False)
    return df.groupBy(*keys).agg(F.count_if(hit).alias("n_reseeds"),
                                 F.max(reseed_anchor(frame, stride)).alias("last_anchor"))


def gate_replay(df: DataFrame, keys: Sequence[str], taus: Sequence[float], max_consecutive: int,
                score: str = "vacuity", keyframe: str = "is_keyframe", frame: str = "frame",
                legacy: bool = False) -> DataFrame:
    """Re-anchor events, rejections and longest counted run per (key, tau).

    A rejected decision frame advances the counter, an accepted one resets it, and an event
    resets it too. Runs are islands between accepted frames, found with a chunked running
    count; ``legacy`` lets every accepted frame reset, not only decision frames.
    """
    kf = F.col(keyframe).cast("boolean")
    base = df if legacy else df.where(kf)
    d = base.select(*keys, frame, F.coalesce(kf, F.lit(False)).alias("_kf"),
                    F.col(score).alias("_s"),
                    F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau"))
    d = d.withColumn("_hit", F.coalesce(F.col("_kf") & (F.col("_s") >= F.col("tau")),
                                        F.lit(False)))
    k = [*keys, "tau"]
    d = running(d, k, [frame], number_chunk(frame),
                sums={"_island": (~F.col("_hit")).cast("bigint")})
    runs = d.groupBy(*k, "_island").agg(F.count_if("_hit").alias("_len"))
    m = F.lit(int(max_consecutive))
    return runs.groupBy(*k).agg(
        F.sum(F.floor(F.col("_len") / m)).cast("bigint").alias("events"),
        F.sum("_len").alias("rejections"),
        F.max(F.least("_len", m)).cast("bigint").alias("longest"))


def gate_table(df: DataFrame, keys: Sequence[str], taus: Sequence[float], max_consecutive: int,
               **cols: str) -> DataFrame:
    """Shipped and legacy counter side by side per tau, and whether an event is reachable."""
    def total(legacy: bool, suffix: str) -> DataFrame:
        g = gate_replay(df, keys, taus, max_consecutive, legacy=legacy, **cols)
        return g.groupBy("tau").agg(
            F.sum("events").cast("bigint").alias(f"events_{suffix}"),
            F.sum("rejections").cast("bigint").alias("rejections"),
            F.max("longest").alias("longest"))

    t = total(False, "shipped").join(total(True, "legacy").select("tau", "events_legacy"), "tau")
    return t.withColumn("reachable", (F.col("longest") >= max_consecutive).cast("int"))


def recover_tau(df: DataFrame, recorded: int | Column, score: str = "vacuity",
                keyframe: str = "is_keyframe", lo: int = 60, step: int = 5, hi: int = 650
                ) -> DataFrame:
    """Threshold of a per-mille grid whose rejection count is nearest the recorded count.

    A score is binned by the greatest grid value not above it, so one small histogram answers
    for the whole grid. The earliest threshold wins a tie.
    """
    last = (hi - lo) // step
    tau_of = lambda i: (F.lit(lo) + F.lit(step) * i) / F.lit(1000.0)
    v = F.col(score)
    guess = F.floor((v * 1000 - lo) / step).cast("int")
    idx = F.when(tau_of(guess + 1) <= v, guess + 1).when(tau_of(guess) > v, guess - 1)
    idx = F.least(F.lit(last), idx.otherwise(guess))
    hist = df.where(F.col(keyframe).cast("boolean") & v.isNotNull()).groupBy(
        idx.alias("i")).agg(F.count("*").alias("n"))
    # a rejection at grid value i is one at every lower value too; both tables have at most
    # one row per grid value
    each = hist.where("i >= 0").select(F.explode(F.sequence(F.lit(0), "i")).alias("g"), "n")
    grid = df.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("g"),
                                                  F.lit(0).cast("bigint").alias("n"))
    counts = each.unionByName(grid).groupBy("g").agg(F.sum("n").alias("rejections"))
    want = F.lit(int(recorded)) if isinstance(recorded, int) else recorded
    err = F.abs(F.col("rejections") - want)
    best = F.min(F.struct(err.alias("err"), F.col("g").alias("g"),
                          F.col("rejections").alias("rejections")))
    return counts.agg(best.alias("b")).select(
        tau_of(F.col("b.g")).alias("tau"), F.col("b.rejections").alias("rejections"),
        F.col("b.err").alias("error"), (F.col("b.err") == 0).cast("int").alias("faithful"))


def profile_weights(evidence: DataFrame, keys: Sequence[str], n_ops: int, lam: float = 0.45,
                    frame: str = "frame", op: str = "op", mass: str = "e") -> DataFrame:
    """Operator profile after the last decision: an exponential average of evidence shares.

    The fold has the closed form ``(1-lam)^n / M + sum lam (1-lam)^(n-1-k) p_k``, a plain sum
    over decisions, so no instance is folded in one task. Decisions without mass are skipped.
    """
    tot = evidence.groupBy(*keys, frame).agg(F.sum(mass).alias("_s")).where(F.col("_s") > 0)
    tot = ordinal(tot, keys, [frame], number_chunk(frame), "_k", "n_updates")
    d = evidence.join(tot, [*keys, frame])
    share = F.lit(lam) * F.pow(F.lit(1 - lam), F.col("n_updates") - 1 - F.col("_k")) * (
        F.col(mass) / F.col("_s"))
    got = d.groupBy(*keys, op).agg(F.sum(share).alias("_w"))
    grid = tot.groupBy(*keys).agg(F.max("n_updates").alias("n_updates")).select(
        *keys, "n_updates", F.explode(F.sequence(F.lit(0), F.lit(n_ops - 1))).alias(op))
    start = F.pow(F.lit(1 - lam), F.col("n_updates")) / F.lit(float(n_ops))
    return grid.join(got, [*keys, op], "left").select(
        *keys, op, "n_updates", (start + F.coalesce("_w", F.lit(0.0))).alias("w"))


def profile_summary(weights: DataFrame, keys: Sequence[str], n_ops: int, top: int,
                    min_ops: int = 3, op: str = "op") -> DataFrame:
    """Leading operator, normalised entropy and the top operators of each profile.

    At most ``n_ops`` rows per key, one per operator of the bank.
    """
    j = max(min_ops, min(top, n_ops))
    p = F.least(F.greatest(F.col("w"), F.lit(1e-8)), F.lit(1.0))
    w = F.round("w", 12)
    r = weights.withColumn("_r", F.row_number().over(
        W.partitionBy(*keys).orderBy(w.desc(), F.col(op))))
    return r.groupBy(*keys).agg(
        F.max("n_updates").alias("n_updates"),
        F.min(F.when(F.col("_r") == 1, F.col(op))).alias("leader"),
        (-F.sum(p * F.log(p)) / F.log(F.lit(n_ops + 1e-8))).alias("entropy"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("_r") <= j, F.col(op)))), "|")
        .alias("selected"))
