"""How the top of the ranking moves with the prior's mean and weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.ratings import car

from .ratings import compute_priors, order_by_car, order_by_stars

LABELS = {"C_simple": "simple", "C_weighted": "count-weighted"}


def combinations(spark: SparkSession, priors: DataFrame, m_values: tuple[int, ...] = (25, 50, 120, 500), sources: tuple[str, ...] = ("C_simple", "C_weighted")) -> DataFrame:
    """A row for each prior mean and weight: combo, C, m."""
    grid = spark.createDataFrame([(s, f"{LABELS[s]} C, m={m}", float(m)) for s in sources for m in m_values], "c_source string, combo string, m double")
    c = F.lit(None).cast("double")
    for s in sources:
        c = F.when(F.col("c_source") == s, F.col(s)).otherwise(c)
    return grid.crossJoin(priors).select("combo", c.alias("C"), "m")  # one row of priors


def sweep(items: DataFrame, top: int = 20, m_values: tuple[int, ...] = (25, 50, 120, 500), sources: tuple[str, ...] = ("C_simple", "C_weighted")) -> DataFrame:
    """The top of every combination: combo, rank and the item. The grid is a handful of rows and is sent to the items."""
    grid = combinations(items.sparkSession, compute_priors(items), m_values, sources)
    scored = items.join(F.broadcast(grid)).withColumn("car", car(F.col("average_rating"), F.col("rating_number"), F.col("C"), F.col("m")))
    rank = F.row_number().over(Window.partitionBy("combo").orderBy(*order_by_car()))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).select("combo", "rank", "parent_asin", "title", "average_rating", "rating_number", "car")


def overlaps(tops: DataFrame) -> DataFrame:
    """How many items each pair of combinations shares, pairs without any among them. tops has at most top rows a combination."""
    a, b = tops.select(F.col("combo").alias("a"), "parent_asin"), tops.select(F.col("combo").alias("b"), "parent_asin")
    pairs = tops.select(F.col("combo").alias("a")).distinct().join(F.broadcast(tops.select(F.col("combo").alias("b")).distinct()))
    return pairs.join(a.join(b, "parent_asin").groupBy("a", "b").agg(F.count("*").alias("n")), ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("shared"))


def resolution(items: DataFrame, m_values: tuple[int, ...] = (25, 50, 120, 500), sources: tuple[str, ...] = ("C_simple", "C_weighted")) -> DataFrame:
    """Distinct CAR values by combination, at nine and at two decimals, beside distinct stars and (stars, count) pairs.

    CAR depends on stars and count alone, so the pairs are made distinct before the grid multiplies them.
    """
    grid = combinations(items.sparkSession, compute_priors(items), m_values, sources)
    pairs = items.select("average_rating", "rating_number").distinct()
    value = car(F.col("average_rating"), F.col("rating_number"), F.col("C"), F.col("m"))
    per_combo = (
        pairs.join(F.broadcast(grid))
        .groupBy("combo")
        .agg(F.countDistinct(F.round(value, 9)).alias("distinct_car"), F.countDistinct(F.round(value, 2)).alias("distinct_car_2dp"))
    )
    totals = pairs.agg(F.countDistinct("average_rating").alias("distinct_stars"), F.count("*").alias("distinct_pairs"))
    return per_combo.join(F.broadcast(totals))  # one row


def by_stars(items: DataFrame, top: int = 20) -> DataFrame:
    """The first ``top`` by stars, then count, then id."""
    return items.orderBy(*order_by_stars()).limit(top)


def star_overlap(items: DataFrame, tops: DataFrame, top: int = 20) -> DataFrame:
    """How much of each combination's top is in the star sort's, and that top's upper median count."""
    stars = by_stars(items, top)
    median = stars.agg(F.get(F.sort_array(F.collect_list("rating_number")), F.floor(F.count("*") / 2).cast("int")).alias("upper_median_count"))
    shared = tops.join(F.broadcast(stars.select(F.col("parent_asin").alias("_star"))), F.col("parent_asin") == F.col("_star"), "left")
    return shared.groupBy("combo").agg(F.count("_star").alias("shared")).join(F.broadcast(median))  # top rows, and one


def rank_table(tops: DataFrame, combos: list[str] | None = None) -> DataFrame:
    """A row for each item in any top, its rank in each combination, and its place in the report's order."""
    combos = combos or [r[0] for r in tops.select("combo").distinct().orderBy("combo").collect()]
    wide = tops.groupBy("parent_asin").pivot("combo", combos).agg(F.first("rank"))
    best = F.least(*[F.coalesce(F.col(f"`{c}`"), F.lit(999)) for c in combos]) * 100
    rest = sum((F.coalesce(F.col(f"`{c}`"), F.lit(99)) for c in combos[1:]), F.coalesce(F.col(f"`{combos[0]}`"), F.lit(99))) / 100
    wide = wide.withColumn("_order", best + rest)
    place = F.row_number().over(Window.orderBy("_order", "parent_asin"))  # at most top rows a combination
    long = F.explode(F.array(*[F.struct(F.lit(c).alias("combo"), F.col(f"`{c}`").alias("rank")) for c in combos]))
    return wide.withColumn("place", place).select("place", "parent_asin", long.alias("r")).select("place", "parent_asin", "r.combo", "r.rank")
