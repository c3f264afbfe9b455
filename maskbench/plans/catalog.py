"""All registered queries."""

from __future__ import annotations

from . import association, flows_io, integrity, pixels, study, trees  # noqa: F401  (they register on import)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
