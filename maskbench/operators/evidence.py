"""Candidate agreement, Dirichlet evidence, selection and pickers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.keys import c
from ..functions.ordered import quantiles
from .masks import iou, perimeter

# Agreement weights for temporal, consensus and boundary terms.
AGREEMENT_WEIGHTS = (0.45, 0.35, 0.20)
KAPPA, GAMMA = 8.0, 2.0  # fixed values: evidence scale and exponent
EPS = 1e-8


def oversized_groups(candidates: DataFrame, key: Sequence[str], bank_size: int) -> DataFrame:
    """Frames with more candidates than the bank has operators, or an operator twice."""
    return candidates.groupBy(*key).agg(
        F.count("*").alias("n"), F.countDistinct("op").alias("n_ops")).where(
        (F.col("n") > bank_size) | (F.col("n") != F.col("n_ops")))


def consensus(candidates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean IoU of each candidate with the others of its frame.

    The key includes the frame and an operator occurs once, so a group has at most as many
    rows as the restoration bank has operators (see ``oversized_groups``).
    """
    a = candidates.select(*key, "op", "h", "w", F.col("bits").alias("_x"))
    b = candidates.select(*key, F.col("op").alias("_o"), F.col("bits").alias("_y"))
    pairs = a.join(b, list(key)).where(F.col("op") != F.col("_o"))
    return pairs.groupBy(*key, "op").agg(F.avg(iou("_x", "_y", "h", "w")).alias("c"))


def agreement(candidates: DataFrame, anchors: DataFrame, key: Sequence[str],
              weights: Sequence[float] = AGREEMENT_WEIGHTS) -> DataFrame:
    """Terms a, c, u and the weighted score of every candidate; a lone one takes c = a."""
    d = candidates.join(anchors.select(*key, F.col("bits").alias("_anchor")), list(key))
    ref = F.greatest(perimeter("_anchor", "h", "w"), F.lit(1))
    per = perimeter("bits", "h", "w")
    d = d.select(*key, "op", iou("bits", "_anchor", "h", "w").alias("a"),
                 (1 - F.least(F.lit(1.0), F.abs(per / ref - 1))).alias("u"))
    d = d.join(consensus(candidates, key), [*key, "op"], "left").withColumn(
        "c", F.coalesce("c", "a"))
    s = sum(weights) + EPS
    score = sum(F.col(t) * F.lit(w / s) for t, w in zip("acu", weights))
    return d.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)))


def dirichlet(scores: DataFrame, key: Sequence[str], score: str = "score", kappa: float = KAPPA,
              gamma: float = GAMMA) -> DataFrame:
    """Evidence, strength, belief and vacuity; vacuity is M / S of the frame."""
    s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(score)))
    d = scores.withColumn("e", F.lit(kappa) * F.pow(s, F.lit(gamma)) + F.lit(1e-9))
    strength = d.groupBy(*key).agg(F.sum(F.col("e") + 1).alias("strength"),
                                   F.count("*").alias("m"))
    d = d.join(strength, list(key))
    return d.withColumn("belief", F.col("e") / (F.col("strength") + EPS)).withColumn(
        "vacuity", F.col("m") / (F.col("strength") + EPS)).drop("m")


def top_k(beliefs: DataFrame, key: Sequence[str], k: int, belief: str = "belief",
          op: str = "op") -> DataFrame:
    """The k most believed candidates of a frame; at most one row per operator per frame."""
    w = W.partitionBy(*key).orderBy(F.round(belief, 12).desc(), F.col(op))
    d = beliefs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    share = F.col(belief) / (F.sum(belief).over(W.partitionBy(*key)) + EPS)
    return d.withColumn("weight", share)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two ARRAY<DOUBLE> columns."""
    dot = F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def norm(x: Column) -> Column:
        return F.sqrt(F.aggregate(F.transform(x, lambda v: v * v), F.lit(0.0), lambda s, v: s + v))

    return dot / (norm(c(a)) * norm(c(b)) + F.lit(EPS))


def reanchor_choice(candidates: DataFrame, key: Sequence[str], similarity: str = "similarity",
                    area: str = "area", ref_area: str = "ref_area") -> DataFrame:
    """Best re-anchor box per frame: 0.6 similarity + 0.4 area ratio, first candidate on ties."""
    small, ref = F.least(area, ref_area), F.greatest(F.lit(1), F.col(ref_area))
    ratio = F.least(F.col(area), ref) / F.greatest(F.col(area), ref)
    gain = F.round(0.6 * F.col(similarity) + 0.4 * ratio, 12)
    d = candidates.where(F.col(area) > 0).withColumn("gain", gain)
    best = F.max(F.struct(F.col("gain").alias("gain"), (-F.col("candidate")).alias("nc")))
    return d.groupBy(*key).agg(best.alias("b")).select(
        *key, (-F.col("b.nc")).alias("candidate"), F.col("b.gain").alias("gain"))


def pick_three(deltas: DataFrame, keys: Sequence[str], name: Sequence[str] = ("seq", "obj_id"),
               delta: str = "d") -> DataFrame:
    """Best, nearest-median and worst instance of each key; ties go to the lower name.

    The median is the upper one. Extremes are found by aggregation and the middle by the
    least distance to the median among the rest, so no key is sorted in one task.
    """
    d = deltas.select(*keys, *name, F.round(delta, 12).alias("_d"))
    who = F.struct(*name)
    ends = d.groupBy(*keys).agg(
        F.min(F.struct((-F.col("_d")).alias("m"), *name)).alias("top"),
        F.max(F.struct((-F.col("_d")).alias("m"), *name)).alias("bot"),
        F.count("*").alias("n"))
    med = quantiles(d, keys, "_d", {"_med": 0.5}, method="index")
    j = d.join(ends, list(keys)).join(med, list(keys))
    same = lambda e: F.struct(*[F.col(f"{e}.{x}").alias(x) for x in name])
    mid = j.where((who != same("top")) & (who != same("bot"))).groupBy(*keys).agg(
        F.min(F.struct(F.round(F.abs(F.col("_d") - F.col("_med")), 12).alias("g"), *name,
                       F.col("_d").alias("d"))).alias("mid"))
    out = ends.where(F.col("n") >= 3).join(mid, list(keys))
    rows = F.array(
        F.struct(F.lit("best").alias("pick"), *[F.col(f"top.{x}").alias(x) for x in name],
                 (-F.col("top.m")).alias("delta")),
        F.struct(F.lit("median").alias("pick"), *[F.col(f"mid.{x}").alias(x) for x in name],
                 F.col("mid.d").alias("delta")),
        F.struct(F.lit("worst").alias("pick"), *[F.col(f"bot.{x}").alias(x) for x in name],
                 (-F.col("bot.m")).alias("delta")))
    return out.select(*keys, F.inline(rows))


def frame_of_disagreement(pairs: DataFrame, keys: Sequence[str], frame: str = "frame",
                          delta: str = "d") -> DataFrame:
    """Frame with the largest |difference|; the earliest frame wins a tie."""
    best = F.max(F.struct(F.round(F.abs(delta), 12).alias("gap"), (-F.col(frame)).alias("nf")))
    return pairs.groupBy(*keys).agg(best.alias("b")).select(
        *keys, (-F.col("b.nf")).alias("frame"), F.col("b.gap").alias("gap"))


def trajectory_choice(frames: DataFrame, name: Sequence[str], keyframe: str = "is_keyframe",
                      within: Sequence[str] = ()) -> DataFrame:
    """Instance with the most decision frames; a tie takes the largest name."""
    n = frames.groupBy(*within, *name).agg(F.sum(F.col(keyframe).cast("int")).alias("n"))
    best = F.max(F.struct("n", *name))
    return n.where(F.col("n") > 0).groupBy(*within).agg(best.alias("b")).select(
        *within, *[F.col(f"b.{x}").alias(x) for x in name], F.col("b.n").alias("n_decisions"))
