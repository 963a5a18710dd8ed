"""Priors of candidate sets, and ranking by the credibility-adjusted rating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.ratings import car, check_prior, contradiction, is_rated

#: Sets with fewer rated items use the stored priors and are flagged.
LEAST_RATED = 30


class Contradictions(ValueError):
    """Rows that can't be rated, with why."""


def refuse_contradictions(items: DataFrame) -> DataFrame:
    """items, or Contradictions with the first fifty rows whose ratings contradict themselves."""
    bad = items.select("parent_asin", contradiction(F.col("average_rating"), F.col("rating_number")).alias("why")).where("why IS NOT NULL")
    if rows := bad.orderBy("parent_asin").limit(50).collect():
        raise Contradictions("; ".join(f"{r.parent_asin}: {r.why}" for r in rows))
    return items


def _aggregates() -> list[Column]:
    rated = is_rated()
    # whole numbers and decimals add up the same in any order
    stars = F.when(rated, F.col("average_rating").cast("decimal(12,6)"))
    count = F.when(rated, F.col("rating_number"))
    return [
        F.count_if(rated).alias("n_rated"),
        (F.sum(stars).cast("double") / F.count(stars)).alias("C_simple"),
        (F.sum(stars * count.cast("decimal(18,0)")).cast("double") / F.sum(count)).alias("C_weighted"),
        F.percentile(count, F.lit(0.5)).alias("m_median"),
    ]


def compute_priors(items: DataFrame, *by: str) -> DataFrame:
    """n_rated, simple and count-weighted mean rating, and the exact median count of rated items, by group.

    Means are null where nothing is rated.
    """
    return items.groupBy(*by).agg(*_aggregates()) if by else items.agg(*_aggregates())


def priors_for(candidates: DataFrame, fallback: tuple[float, float] | None, by: str = "query", least: int = LEAST_RATED) -> DataFrame:
    """Each candidate set's C and m: its own, or the fallback's, with the source and a flag.

    The fallback is (C, m) and is needed only if some set is small.
    """
    if fallback:
        check_prior(*fallback)
    own = F.col("n_rated") >= least
    c, m = fallback or (None, None)
    return compute_priors(candidates, by).select(
        by,
        F.when(own, F.col("C_simple")).otherwise(F.lit(c)).cast("double").alias("C"),
        F.when(own, F.col("m_median")).otherwise(F.lit(m)).cast("double").alias("m"),
        F.when(own, "candidate_set").otherwise("fallback").alias("source"),
        "n_rated",
        (~own).alias("flagged"),
    )


def order_by_car() -> list[Column]:
    """CAR descending, then the count, then the id; those without a CAR come last."""
    return [F.col("car").desc_nulls_last(), F.coalesce(F.col("rating_number"), F.lit(0)).desc(), F.col("parent_asin").asc()]


def order_by_stars() -> list[Column]:
    return [F.col("average_rating").desc_nulls_last(), F.col("rating_number").desc_nulls_last(), F.col("parent_asin").asc()]


def with_car(candidates: DataFrame, priors: DataFrame, by: str = "query") -> DataFrame:
    """Adds C, m, source and car. Priors have a row for each set."""
    scored = candidates.join(priors.select(by, "C", "m", "source"), by)
    return scored.withColumn("car", car(F.col("average_rating"), F.col("rating_number"), F.col("C"), F.col("m")))


def ranked(candidates: DataFrame, priors: DataFrame, by: str = "query", top: int | None = None) -> DataFrame:
    """Adds C, m, source, car and rank inside the set; only the first ``top`` if given.

    With a top, rows beyond it are cut before the shuffle.
    """
    out = with_car(candidates, priors, by).withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order_by_car())))
    return out.where(F.col("rank") <= top) if top else out


def rank_pool(items: DataFrame, c: float, m: float, top: int | None = None) -> DataFrame:
    """All items by CAR under one prior, or the first ``top``."""
    check_prior(c, m)
    out = items.withColumn("car", car(F.col("average_rating"), F.col("rating_number"), F.lit(c), F.lit(float(m)))).orderBy(*order_by_car())
    return out.limit(top) if top else out
