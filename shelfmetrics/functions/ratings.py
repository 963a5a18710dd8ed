"""The credibility-adjusted rating, and intervals of shares."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check_prior(c: float, m: float) -> None:
    """Raises ValueError for parameters that the rating isn't defined for."""
    if m <= 0:
        raise ValueError(f"the prior's weight must be above 0, not {m}")
    if not 1 <= c <= 5:
        raise ValueError(f"the prior mean must be from 1 to 5, not {c}")


def car(rating: Column, count: Column, c: Column, m: Column) -> Column:
    """v / (v + m) * R + m / (v + m) * C; null without a count, C itself for a count of zero."""
    v = count.cast("double")
    return F.when(count.isNull(), None).when(count == 0, c).otherwise((v / (v + m)) * rating + (m / (v + m)) * c)


def contradiction(rating: Column, count: Column) -> Column:
    """Why a row can't be rated, or null: a negative count, or ratings counted without a mean."""
    return F.when(count < 0, F.lit("negative rating_number")).when((count > 0) & rating.isNull(), F.lit("rating_number without average_rating"))


def is_rated(rating: str = "average_rating", count: str = "rating_number") -> Column:
    return F.col(rating).isNotNull() & (F.coalesce(F.col(count), F.lit(0)) > 0)


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of k in n; NaN for n = 0."""
    size = F.when(n > 0, n.cast("double"))
    p = k.cast("double") / size
    scale = F.lit(1.0) + F.lit(z * z) / size
    centre = (p + F.lit(z * z) / (F.lit(2.0) * size)) / scale
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / size + F.lit(z * z) / (F.lit(4.0) * size * size)) / scale
    nan = F.lit(float("nan"))
    return F.coalesce(centre - half, nan), F.coalesce(centre + half, nan)
