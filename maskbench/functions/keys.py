"""Column helpers: numeric coercion, canonical levels, keyed pseudo-randomness."""

from __future__ import annotations

from functools import reduce
from typing import Iterable

from pyspark.sql import Column, functions as F


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 9) -> Column:
    """Round a printed figure: summation order differs between partitionings."""
    return F.round(c(x), digits)


def to_number(x: Column | str) -> Column:
    """Text or number to DOUBLE; blank, unparsable, NaN and infinite all become NULL."""
    v = F.expr("NULL") if x is None else c(x)
    d = F.trim(v.cast("string")).try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def level_label(x: Column | str) -> Column:
    """A level as ``%g`` prints it, so that 3, 3.0 and "3" name the same cell."""
    v = to_number(x)
    text = F.regexp_replace(v.cast("decimal(20,5)").cast("string"), r"\.?0+$", "")
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(text)


def is_main(arm: Column | str = "arm") -> Column:
    """Rows of the main study: the ablation tag is absent or blank."""
    return F.coalesce(F.trim(c(arm)), F.lit("")) == ""


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of the md5 of the parts joined by '|', as BIGINT.

    A function of the key values alone, so draws do not depend on partitioning, and any
    engine with md5 reproduces them.
    """
    return md5_bits(F.concat_ws("|", *[c(p).cast("string") for p in parts]))


def md5_bits(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def sequence_seed(seq: Column | str, seed: int = 0) -> Column:
    """Seed of one clip: the study seed plus the clip-name hash modulo 100000."""
    return F.lit(seed).cast("bigint") + md5_bits(c(seq).cast("string")) % 100000


def all_of(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds)
