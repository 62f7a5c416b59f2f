"""Numbers as reports give them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round4(c: str | Column) -> Column:
    """Four decimals, halves up, in double precision."""
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("double") * 1e4 + 0.5) / 1e4


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four decimals; null where whole is 0."""
    return round4(F.try_divide(part.cast("double"), whole.cast("double")))


def nearest_rank(c: str, p: float) -> Column:
    """The smallest value with at least a share p of the values up to it."""
    return F.expr(f"percentile_disc({p}) within group (order by {c})")
