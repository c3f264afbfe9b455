"""Ordered operations that never put one key's rows into a single task.

A plain ``Window.partitionBy(key).orderBy(x)`` sends all rows of a key to one task. Here the
order is cut into chunks by a monotone expression; rows are windowed per (key, chunk), the
chunk totals are windowed per key (one row per chunk) and the two are joined. A key that holds
a third of the table is thus spread over as many tasks as it has chunks. Where most keys are small, their
chunk totals would be as many as the rows; with ``small_keys`` only large keys are cut.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .keys import c

UNB = W.unboundedPreceding

#: Keys are counted by hash, in this many buckets; those of a bucket of up to SMALL_ROWS rows are small.
KEY_BUCKETS, SMALL_ROWS = 1 << 16, 1 << 18


def value_chunk(v: Column | str, per_octave: int = 4096) -> Column:
    """Monotone chunk number of a DOUBLE: ``per_octave`` chunks for every doubling of |v|."""
    v = c(v).cast("double")
    mag = F.floor(F.log2(F.lit(1.0) + F.abs(v) * F.lit(float(1 << 20))) * per_octave)
    return F.when(v < 0, -mag).otherwise(mag).cast("bigint")


def number_chunk(v: Column | str, size: int = 65536) -> Column:
    """Chunk number of an integer position."""
    return F.floor(c(v) / F.lit(size)).cast("bigint")


def hash_chunk(h: Column | str) -> Column:
    """Chunk of a 32-bit hash, 4096 of them, for hash-ordered positions."""
    return F.shiftright(c(h), 20)


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deal rows evenly over the shuffle partitions before each of them turns into much work.

    For rows that are few but expand (one draw per replicate) or cost a pixel kernel. The
    fixed partition count keeps adaptive coalescing from packing them into one task; ``keys``
    must be unique or nearly so, so no partition is hot.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def with_large(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_large``: true, or NULL for keys that certainly have no more than SMALL_ROWS rows.

    The buckets that hold more are one value of KEY_BUCKETS bits, so nothing is joined and no bucket's rows meet in a task.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    large = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_k")).where(F.col("_k") > SMALL_ROWS)
    none = df.sparkSession.range(KEY_BUCKETS // 64).select(F.col("id").cast("int").alias("_word"), F.lit(0).cast("bigint").alias("_bits"))
    words = large.select(F.shiftright("_bucket", 6).alias("_word"), F.expr("shiftleft(1L, _bucket & 63)").alias("_bits")).unionByName(none)
    words = words.groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    bits = words.agg(F.sort_array(F.collect_list(F.struct("_word", "_bits")))["_bits"].alias("_b")).scalar()
    return df.withColumn("_large", F.when(F.getbit(bits[F.shiftright(bucket, 6)], bucket.bitwiseAND(63)) == 1, True))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    sums: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    totals: Sequence[str] = (),
    small_keys: bool = False,
) -> DataFrame:
    """Add inclusive running sums / maxima per key; ``totals`` adds ``<name>_total`` as well.

    ``chunk`` must not decrease along ``order``. With ``small_keys`` only keys that may be large are cut into
    chunks, at the cost of one more pass over ``df`` that counts rows; for input that is cheap to read twice.
    """
    sums, maxes = dict(sums or {}), dict(maxes or {})
    keys, new = list(keys), {**sums, **maxes}
    small_keys = small_keys and bool(keys)
    d = with_large(df, keys) if small_keys else df
    d = d.withColumns({"_chunk": F.when(F.col("_large"), F.coalesce(chunk, F.lit(-(1 << 62)))) if small_keys else chunk,
                       **{f"_in_{n}": e for n, e in new.items()}})
    per_chunk = (d.where(F.col("_chunk").isNotNull()) if small_keys else d).groupBy(*keys, "_chunk").agg(
        *[F.sum(f"_in_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_in_{n}").alias(f"_t_{n}") for n in maxes],
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(UNB, -1)
    whole = W.partitionBy(*keys)
    offsets = per_chunk.select(
        *keys,
        "_chunk",
        *[F.sum(f"_t_{n}").over(before).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(before).alias(f"_o_{n}") for n in maxes],
        *[F.sum(f"_t_{n}").over(whole).alias(f"{n}_total") for n in totals],
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*[c(o) for o in order]).rowsBetween(UNB, 0)
    own = W.partitionBy(*keys, "_chunk")
    d = d.withColumns({**{f"_in_{n}": F.sum(f"_in_{n}").over(inside) for n in sums},
                       **{f"_in_{n}": F.max(f"_in_{n}").over(inside) for n in maxes},
                       **({f"_all_{n}": F.sum(f"_in_{n}").over(own) for n in totals} if small_keys else {})})
    kept = [x for x in df.columns if x not in new]
    return d.join(offsets, [*keys, "_chunk"], "left" if small_keys else "inner").select(
        *[F.col(f"`{x}`") for x in kept],
        *[(F.col(f"_in_{n}") + F.coalesce(F.col(f"_o_{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.greatest(F.col(f"_in_{n}"), F.col(f"_o_{n}")).alias(n) for n in maxes],
        *[F.coalesce(f"{n}_total", f"_all_{n}").alias(f"{n}_total") if small_keys else F.col(f"{n}_total") for n in totals],
    )


def ordinal(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    chunk: Column,
    name: str = "pos",
    count: str | None = None,
    small_keys: bool = False,
) -> DataFrame:
    """Add a 0-based position per key, and the group size when ``count`` is named."""
    out = running(df, keys, order, chunk, {name: F.lit(1).cast("bigint")},
                  totals=[name] if count else [], small_keys=small_keys)
    out = out.withColumn(name, F.col(name) - 1)
    return out.withColumnRenamed(f"{name}_total", count) if count else out


def rank_table(
    df: DataFrame, keys: Sequence[str], value: str, weights: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per (key, value): each weight, its sum below the value, its sum over the key.

    ``<w>_before`` counts strictly smaller values, so the average-tie rank of a value is
    ``before + (w + 1) / 2``. Equal values are combined map-side before anything is sorted.
    """
    weights = dict(weights or {"n": F.lit(1).cast("bigint")})
    hist = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    hist = hist.groupBy(*keys, value).agg(*[F.sum(e).alias(w) for w, e in weights.items()])
    cum = {f"{w}_cum": F.col(w) for w in weights}
    out = running(hist, keys, [value], value_chunk(value), cum, totals=list(cum))
    return out.select(
        *keys,
        value,
        *weights,
        *[(F.col(f"{w}_cum") - F.col(w)).alias(f"{w}_before") for w in weights],
        *[F.col(f"{w}_cum_total").alias(f"{w}_total") for w in weights],
    )


def average_rank(n: str = "n") -> Column:
    return F.col(f"{n}_before") + (F.col(n) + 1) / F.lit(2.0)


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact quantiles per key by position, without holding a key's values in one task.

    ``linear`` interpolates at ``q * (n - 1)``; ``index`` takes the element ``floor(q * n)``.
    """
    ranks = rank_table(df, keys, value)
    v, n = F.col(value).cast("double"), F.col("n_total")
    lo, hi = F.col("n_before"), F.col("n_before") + F.col("n")
    picks, outs = [], []
    for name, q in probs.items():
        if method == "linear":
            pos = F.lit(float(q)) * (n - 1)
            k0, k1 = F.floor(pos), F.ceil(pos)
            picks += [
                F.max(F.when((k0 >= lo) & (k0 < hi), v)).alias(f"_a_{name}"),
                F.max(F.when((k1 >= lo) & (k1 < hi), v)).alias(f"_b_{name}"),
                F.max(pos - k0).alias(f"_w_{name}"),
            ]
            outs.append((F.col(f"_a_{name}") + (F.col(f"_b_{name}") - F.col(f"_a_{name}"))
                         * F.col(f"_w_{name}")).alias(name))
        elif method == "index":
            k = F.least(F.floor(F.lit(float(q)) * n), n - 1)
            picks.append(F.max(F.when((k >= lo) & (k < hi), v)).alias(name))
            outs.append(F.col(name))
        else:
            raise ValueError(f"unknown quantile method {method!r}")
    return ranks.groupBy(*keys).agg(*picks).select(*keys, *outs)


def median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})
