"""Quantiles. The flavours differ on purpose: callers say which one they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import TidemarkError


def interpolated_median(x: Column) -> Column:
    return F.percentile(x, 0.5)


def nearest_rank(x: str, q: float) -> Column:
    """The q-th percentile (0 to 100) that is one of the observations; null if there are none."""
    if not 0 <= q <= 100:
        raise TidemarkError(f"percentile {q} is not between 0 and 100")
    return F.expr(f"percentile_disc({q / 100!r}D) WITHIN GROUP (ORDER BY {x})")
