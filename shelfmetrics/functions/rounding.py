"""Rounding as SQL engines do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_scaled(x: Column, digits: int) -> Column:
    """x, scaled in binary, rounded half away from zero and scaled back; x itself where that overflows.

    Spark's own round takes the shortest decimal that reads as x instead. The two part at ties: 77.225 scales to 7722.499999999999
    and becomes 77.22, where Spark's gives 77.23.
    """
    power = F.lit(10.0**digits)
    out = F.round(x * power) / power
    return F.when(F.abs(out) < float("inf"), out).otherwise(x)
