"""Rounding for shown numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int) -> Column:
    """``value`` to ``digits`` places; a billionth is added first, so that exact halves go up on every engine."""
    return F.round((F.col(value) if isinstance(value, str) else value) + F.lit(1e-9), digits)
