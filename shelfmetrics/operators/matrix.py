"""The rating by unit-price matrix of each candidate set."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfmetrics.functions.rounding import round_scaled
from shelfmetrics.functions.units import UNITS

# The unit in which each dimension's prices are shown, and the rules' bounds.
SHOWN_UNITS = {"weight": "oz", "volume": "fl oz", "count": "ct"}
LEAST_ITEMS, LEAST_SHARE, MOST_SPREAD, FAR, WEIGHT_FAR = 30, 0.80, 10.0, 10.0, 3.0


def unit_prices(candidates: DataFrame) -> DataFrame:
    """Adds total (in the dimension's shown unit), unit and unit_price; null, with the listed price left, where there is no pack size.

    A size of zero gives no unit price.
    """
    dim = F.col("pack.dimension")
    per = F.lit(None).cast("double")
    unit = F.lit(None).cast("string")
    for d, u in SHOWN_UNITS.items():
        per, unit = F.when(dim == d, F.lit(UNITS[u][1])).otherwise(per), F.when(dim == d, F.lit(u)).otherwise(unit)
    total = F.col("pack.total_base") / per
    return candidates.withColumns({"dimension": dim, "unit": unit, "total": total, "unit_price": F.try_divide(F.col("price"), total)})


def coherence(priced_units: DataFrame, by: str = "query") -> DataFrame:
    """Whether a set has a unit-price axis, or the first reason against it.

    A dimension needs enough extractions, then a dominant share of them; and for counts the unit prices' 90th percentile
    must not be more than ten times the 10th.
    """
    groups = priced_units.where("unit_price IS NOT NULL").groupBy(by, "dimension").agg(
        F.count("*").alias("n"), F.percentile("unit_price", F.lit(0.9)).alias("p90"), F.percentile("unit_price", F.lit(0.1)).alias("p10")
    )
    # of equal dimensions, the first by name
    largest = F.max_by(F.struct("dimension", "n", "p90", "p10"), F.struct(F.col("n"), F.when(F.col("dimension") == "count", 3).when(F.col("dimension") == "volume", 2).otherwise(1)))
    sets = priced_units.select(by).distinct().join(groups.groupBy(by).agg(largest.alias("d"), F.sum("n").alias("extracted")), by, "left")
    n, share = F.coalesce(F.col("d.n"), F.lit(0)), F.col("d.n") / F.col("extracted")
    spread = F.try_divide(F.col("d.p90"), F.col("d.p10"))
    reason = (
        F.when(n < LEAST_ITEMS, "too_few_extractions").when(share < LEAST_SHARE, "no_dominant_dimension").when((F.col("d.dimension") == "count") & (F.coalesce(spread, F.lit(1e9)) > MOST_SPREAD), "count_spread")
    )
    return sets.select(by, F.col("d.dimension").alias("dimension"), n.alias("n"), F.coalesce("extracted", F.lit(0)).alias("extracted"), share.alias("share"), spread.alias("spread"), reason.isNull().alias("has_axis"), reason.alias("reason"))


def two_axis(scored: DataFrame, axes: DataFrame, by: str = "query") -> DataFrame:
    """Rows of coherent sets that have a CAR and a unit price in the set's dimension."""
    return scored.join(axes.where("has_axis").select(by, "dimension"), [by, "dimension"]).where("car IS NOT NULL AND unit_price IS NOT NULL")


def guard(rows: DataFrame, by: str = "query") -> DataFrame:
    """Adds flagged and guard_reason: a unit price or total more than ten times from the set's median either way. Nothing is dropped."""
    medians = rows.groupBy(by).agg(F.percentile("unit_price", F.lit(0.5)).alias("_price"), F.percentile("total", F.lit(0.5)).alias("_size"))
    far = lambda x, m: (F.try_divide(F.col(x), F.col(m)) > FAR) | (F.try_divide(F.col(m), F.col(x)) > FAR)
    reason = F.when(far("unit_price", "_price"), "unit_price_far_from_median").when(far("total", "_size"), "total_size_far_from_median")
    return rows.join(medians, by).withColumn("guard_reason", reason).withColumn("flagged", F.col("guard_reason").isNotNull()).drop("_price", "_size")


def weight_disagrees(item_weight_grams, total_grams):
    """Whether a listed item weight is more than three times from the extracted size; shown, not used."""
    return (F.try_divide(item_weight_grams, total_grams) > WEIGHT_FAR) | (F.try_divide(total_grams, item_weight_grams) > WEIGHT_FAR)


def quadrants(guarded: DataFrame, by: str = "query") -> DataFrame:
    """Adds quadrant, split at the medians of the set's unflagged items; null for flagged ones. A value at the median counts as above."""
    medians = guarded.where("NOT flagged").groupBy(by).agg(F.percentile("car", F.lit(0.5)).alias("_car"), F.percentile("unit_price", F.lit(0.5)).alias("_price"))
    high, cheap = F.col("car") >= F.col("_car"), F.col("unit_price") < F.col("_price")
    name = F.concat(F.when(high, "high_car").otherwise("low_car"), F.when(cheap, "_low_price").otherwise("_high_price"))
    return guarded.join(medians, by).withColumn("quadrant", F.when(~F.col("flagged"), name)).drop("_car", "_price")


def off_diagonal(guarded: DataFrame, by: str = "query") -> DataFrame:
    """Adds percentile ranks on both axes among unflagged items, and off_diagonal: one in the top third, the other in the bottom.

    The percentile rank is (rank - 1) / (n - 1), ties sharing the lowest rank.
    """
    rows = guarded.where("NOT flagged")
    rank = lambda c: F.percent_rank().over(Window.partitionBy(by).orderBy(c))
    rows = rows.withColumns({"car_rank": rank("car"), "price_rank": rank("unit_price")})
    low, high = F.lit(1 / 3), F.lit(2 / 3)
    apart = ((F.col("car_rank") >= high) & (F.col("price_rank") <= low)) | ((F.col("car_rank") <= low) & (F.col("price_rank") >= high))
    return rows.withColumn("off_diagonal", apart)


def axis_correlation(guarded: DataFrame, by: str = "query") -> DataFrame:
    """Spearman's rank correlation of both axes, ties at their mean rank, over unflagged items."""
    w = lambda c: Window.partitionBy(by).orderBy(c)
    mean_rank = lambda c: F.rank().over(w(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2
    ranks = guarded.where("NOT flagged").select(by, mean_rank("car").alias("a"), mean_rank("unit_price").alias("b"))
    return ranks.groupBy(by).agg(F.count("*").alias("n"), F.corr("a", "b").alias("spearman"))


def star_sort_landing(placed: DataFrame, by: str = "query", top: int = 10) -> DataFrame:
    """Where each set's first ten by stars land: star_rank with the quadrant."""
    order = Window.partitionBy(by).orderBy(F.col("average_rating").desc_nulls_last(), F.col("rating_number").desc_nulls_last(), "parent_asin")
    return placed.withColumn("star_rank", F.row_number().over(order)).where(F.col("star_rank") <= top)


def explanation(rows: DataFrame) -> DataFrame:
    """Adds a sentence on why a point lies where it does. Numbers are rounded before they are printed, as engines print ties each in their way."""
    cents = lambda c: round_scaled(round_scaled(F.col(c), 6), 2)
    said = F.format_string("%s has a credibility-adjusted rating of %.2f from %d ratings and costs %.2f per %s.", "title", cents("car"), F.coalesce("rating_number", F.lit(0)), cents("unit_price"), "unit")
    return rows.withColumn("explanation", said)
