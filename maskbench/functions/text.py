"""Chunk expressions for text order."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import c


def text_chunk(x: Column | str, prefix: int = 3) -> Column:
    """Leading characters of a name: they never decrease along the name order."""
    return F.substring(c(x), 1, prefix)
