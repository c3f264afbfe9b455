"""Registry of named queries and the SQL they are checked against."""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..functions.tails import EXACT_MAX_N
from ..operators.bootstrap import STEPS
from .views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
DIGITS = 9


def printed(df: DataFrame) -> DataFrame:
    """Round the DOUBLE columns for output; adding zero turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), DIGITS) + F.lit(0.0)).alias(f.name)
        if isinstance(f.dataType, DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def query(name: str, sql: str | None = None, views: Sequence[str] = (), floats: str = ""
          ) -> Callable[[Query], Query]:
    """Register a query; ``floats`` names the columns the SQL has to round likewise."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: printed(fn(spark, sf_dir))
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            text = with_views(sql, *views) if views else sql
            cols = floats.split()
            if cols:
                swap = ", ".join(f"round({c}, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in cols)
                text = f"SELECT * REPLACE ({swap}) FROM ({text})"
            ORACLES[name] = text
        return fn

    return add


# ---- SQL fragments ------------------------------------------------------------------------


def sql_hash(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def sql_rank(x: str, keys: Sequence[str]) -> str:
    part = f"PARTITION BY {', '.join(keys)}" if keys else ""
    tie = ", ".join([*keys, x])
    return (f"(rank() OVER ({part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {tie}) - 1) / 2.0)"
            "::DOUBLE")


def sql_rho(src: str, keys: Sequence[str], x: str, y: str) -> str:
    """Subquery: n and rho per key, NULL below four rows or without spread."""
    k = ", ".join(keys)
    kk = f"{k}, " if k else ""
    return (f"SELECT {kk}count(*) AS n, CASE WHEN count(*) >= 4 AND stddev_pop(rx) > 0 AND "
            f"stddev_pop(ry) > 0 THEN corr(rx, ry) END AS rho FROM (SELECT {kk}"
            f"{sql_rank(x, keys)} AS rx, {sql_rank(y, keys)} AS ry FROM {src} "
            f"WHERE {x} IS NOT NULL AND {y} IS NOT NULL)" + (f" GROUP BY {k}" if k else ""))


def sql_weights(src: str, cols: Sequence[str], unit: Sequence[str], n_boot: int, seed: int = 0) -> str:
    """Rows of ``src`` once per replicate ``b`` in which their unit counts, with its weight ``w``."""
    text = f"concat_ws('|', {seed}, t.rep // 8, {', '.join(unit)})"
    digits = f"substr(md5({text}), CAST(t.rep % 8 * 4 + 1 AS BIGINT), 4)"
    weight = " + ".join(f"CAST(h >= '{t}' AS INT)" for t in STEPS)
    return (f"SELECT * FROM (SELECT * EXCLUDE (h), {weight} AS w FROM (SELECT {', '.join(cols)}, t.rep AS b, {digits} AS h "
            f"FROM {src}, range({n_boot}) t(rep))) WHERE w > 0")


def sql_boot(name: str, src: str, keys: Sequence[str], unit: Sequence[str], value: str,
             n_boot: int, seed: int = 0) -> str:
    """CTEs ending in ``<name>``: keys, point, n, ci_lo, ci_hi of the bootstrapped mean."""
    k = ", ".join(keys)
    return (
        f"{name}_s AS (SELECT * FROM {src} WHERE {value} IS NOT NULL), "
        f"{name}_d AS ({sql_weights(f'{name}_s', [*keys, *[u for u in unit if u not in keys], value], unit, n_boot, seed)}), "
        f"{name}_m AS (SELECT {k}, b, sum(w * {value}) / sum(w) AS m FROM {name}_d GROUP BY {k}, b), "
        f"{name} AS (SELECT {k}, quantile_cont(m, 0.025) AS ci_lo, quantile_cont(m, 0.975) AS ci_hi "
        f"FROM {name}_m GROUP BY {k})")


def sql_paired(name: str, pairs: str, keys: Sequence[str], unit: Sequence[str], n_boot: int,
               seed: int = 0) -> str:
    """CTEs ending in ``<name>``: the paired report without p of rows (keys, unit, a, b, d)."""
    k = ", ".join(keys)
    r = sql_rank("ad", keys)
    return (
        sql_boot(f"{name}_ci", pairs, keys, unit, "d", n_boot, seed) + ", "
        f"{name}_sum AS (SELECT {k}, count(*) AS n_pairs, avg(a) AS mean_base, avg(b) AS mean_method, "
        f"avg(d) AS mean_delta, min(d) AS min_delta, max(d) AS max_delta, "
        f"count(*) FILTER (d > 0) AS wins, count(*) FILTER (d < 0) AS losses, "
        f"quantile_cont(d, 0.5) AS median_delta FROM {pairs} GROUP BY {k}), "
        f"{name}_w AS (SELECT {k}, count(*) AS n_nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, "
        f"sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus FROM (SELECT *, {r} AS r FROM "
        f"(SELECT *, abs(d) AS ad FROM {pairs} WHERE d <> 0)) GROUP BY {k}), "
        f"{name}_v AS (SELECT {k}, a AS v, 1 AS na, 0 AS nb FROM {pairs} UNION ALL "
        f"SELECT {k}, b, 0, 1 FROM {pairs}), "
        f"{name}_c AS (SELECT {k}, 2 * (sum(CASE WHEN nb = 1 THEN r ELSE 0 END) - sum(nb) * (sum(nb) + 1) / 2.0) "
        f"/ (sum(na) * sum(nb)) - 1 AS cliffs_delta FROM (SELECT *, {sql_rank('v', keys)} AS r "
        f"FROM {name}_v) GROUP BY {k}), "
        f"{name} AS (SELECT * FROM {name}_sum JOIN {name}_ci USING ({k}) LEFT JOIN (SELECT {k}, "
        f"coalesce(n_nonzero, 0) AS n_nonzero, w_plus, w_minus, least(w_plus, w_minus) AS w_stat "
        f"FROM {name}_w) USING ({k}) JOIN {name}_c USING ({k}))")


def sql_signed(src: str, keys: Sequence[str]) -> str:
    """Subquery: signed-rank sums of the differences ``d`` with the tie term."""
    k = ", ".join(keys)
    side = lambda sign: f"sum(CASE WHEN d {sign} 0 THEN r ELSE 0 END) FILTER (d <> 0)"
    return (f"SELECT *, least(w_plus, w_minus) AS w_stat FROM (SELECT {k}, count(*) FILTER (d <> 0) AS n, count(*) FILTER (d = 0) AS n_zero, "
            f"{side('>')} AS w_plus, {side('<')} AS w_minus, coalesce(sum(t * t - 1) FILTER (d <> 0), 0)::DOUBLE AS tie_sum FROM (SELECT *, "
            f"{sql_rank('ad', [*keys, 'z'])} AS r, count(*) OVER (PARTITION BY {k}, z, ad) AS t FROM (SELECT *, abs(d) AS ad, d = 0 AS z "
            f"FROM {src} WHERE d IS NOT NULL)) GROUP BY {k})")


def sql_signed_p(src: str, keys: Sequence[str], exact_max_n: int = EXACT_MAX_N) -> str:
    """Subquery: ``sql_signed`` with the p value and its method.

    The null counts grow by one rank a step; the normal tail is the power series of erf.
    """
    ways = ("(WITH RECURSIVE nw(n, ways) AS (SELECT 0::BIGINT, [1.0::DOUBLE] UNION ALL SELECT n + 1, list_transform(range(CAST(len(ways) + n + 1 AS BIGINT)), "
            "lambda i: coalesce(ways[i + 1], 0) + CASE WHEN i > n THEN coalesce(ways[i - n], 0) ELSE 0 END) "
            f"FROM nw WHERE n < {exact_max_n}) SELECT * FROM nw)")
    exact = f"(n <= {exact_max_n} AND tie_sum = 0 AND n_zero = 0)"
    var = "(n * (n + 1.0::DOUBLE) * (2.0 * n + 1) / 24 - tie_sum / 48)"
    erf = "list_sum(list_transform(range(600), lambda i: exp((2 * i + 1) * ln(z) - z * z - lgamma(i + 1.5))))"
    tail = f"CASE WHEN z <= 0 THEN 1 WHEN z > 15 THEN 0 ELSE least(1, greatest(0, 1 - {erf})) END"
    return (f"SELECT * EXCLUDE (z, ways), CASE WHEN n = 0 THEN 1 WHEN {exact} THEN least(1, 2 * list_sum(ways[1:CAST(floor(w_stat) AS BIGINT) + 1]) / pow(2, n)) "
            f"WHEN z IS NULL THEN 1 ELSE {tail} END::DOUBLE AS wilcoxon_p, CASE WHEN n = 0 THEN 'none' WHEN {exact} THEN 'exact' ELSE 'normal' END AS p_method "
            f"FROM (SELECT *, CASE WHEN {var} > 0 THEN abs(w_stat - n * (n + 1.0::DOUBLE) / 4) / sqrt({var}) / sqrt(2.0::DOUBLE) END AS z "
            f"FROM ({sql_signed(src, keys)})) LEFT JOIN {ways} USING (n)")


def sql_rho_p(rho: str = "rho", n: str = "n") -> str:
    """Two-sided p of a rank correlation by Student's t: the finite sums over powers of the cosine, for even and odd degrees of freedom."""
    df, cos = f"({n} - 2)", "greatest(1e-300::DOUBLE, sqrt(1 - r2))"
    even = f"list_sum(list_transform(range({df} // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0) + 2 * k * ln({cos})))) / sqrt(pi())"
    odd = f"coalesce(list_sum(list_transform(range(({df} - 1) // 2), lambda k: exp(lgamma(k + 1.0) - lgamma(k + 1.5) + (2 * k + 1) * ln({cos})))), 0) * sqrt(pi()) / 2"
    inside = f"CASE WHEN {df} % 2 = 0 THEN sqrt(r2) * {even} ELSE 2 / pi() * (asin(sqrt(r2)) + sqrt(r2) * {odd}) END"
    return f"CASE WHEN {n} >= 3 AND {rho} IS NOT NULL THEN greatest(0, 1 - ({inside})) END".replace("r2", f"least(1, {rho} * {rho})")


def sql_holm(src: str, family: Sequence[str], p: str = "wilcoxon_p") -> str:
    """Subquery: rows of ``src`` with the Holm-adjusted p of their family."""
    f = ", ".join(family)
    return (f"SELECT * EXCLUDE (r, m), least(1.0::DOUBLE, max((m - r + 1) * {p}) OVER (PARTITION BY {f} ORDER BY r)) AS holm_p FROM (SELECT *, "
            f"row_number() OVER (PARTITION BY {f} ORDER BY {p}) AS r, count(*) OVER (PARTITION BY {f}) AS m FROM {src} WHERE {p} IS NOT NULL)")


PAIRED_FLOATS = ("mean_base mean_method mean_delta min_delta max_delta median_delta ci_lo ci_hi "
                 "w_plus w_minus w_stat cliffs_delta")
