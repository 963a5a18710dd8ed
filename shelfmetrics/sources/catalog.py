"""A product catalogue made of the driver's tables, in whole numbers, so that any engine makes the same one.

Each part is an item. Its name and a template, chosen by its key, give the title and details, so that every way of writing a
pack size occurs and the true one is known. Line items give the mean rating (from discounts) and the number of ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATES = 12


def _key(mod: int) -> Column:
    return F.col("p_partkey") % mod


def _amounts() -> tuple[Column, Column, Column]:
    """A size, a number of packs and a count for each part."""
    return F.col("p_size") + 1, F.lit(2) + _key(5), F.col("p_size") + 2


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records: id and title as text, and four cells of JSON text, as ``sources.load`` reads them.

    Some prices are null, dashes, ranges or not positive, and some titles are blank.
    """
    parts, lines = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "lineitem"))
    rated = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("_cents"), F.count("*").alias("_n"))
    size, packs, count = (x.cast("string") for x in _amounts())
    name, t = F.col("p_name"), _key(TEMPLATES)
    title = (
        F.when(_key(97) == 0, F.lit("  "))
        .when(t == 0, F.concat(name, F.lit(", "), size, F.lit(" oz")))
        .when(t == 1, F.concat(name, F.lit(" "), packs, F.lit(" x "), size, F.lit(" ml")))
        .when(t == 2, F.concat(name, F.lit(", "), count, F.lit(" count")))
        .when(t == 3, F.concat(name, F.lit(" (pack of "), packs, F.lit(")")))
        .when(t == 4, F.concat(name, F.lit(" kit, "), size, F.lit(" oz")))
        .when(t == 5, F.concat(name, F.lit(" holder, "), size, F.lit(" oz mug")))
        .when(t == 6, F.concat(name, F.lit(" "), size, F.lit(" oz and "), (3 * F.col("p_size") + 3).cast("string"), F.lit(" oz")))
        .when(t == 7, F.concat(name, F.lit("s "), size, F.lit(" oz")))
        .when(t == 8, F.concat(name, F.lit(", "), size, F.lit(" oz, "), count, F.lit(" count")))
        .when(t == 9, F.concat(name, F.lit(" refill")))
        .when(t == 10, F.concat(name, F.lit(" "), size, F.lit(" oz")))
        .otherwise(name)
    )
    details = (
        F.when(t == 3, F.create_map(F.lit("Unit Count"), F.concat(count, F.lit(" Count"))))
        .when(t == 7, F.create_map(F.lit("Size"), F.concat(size, F.lit(" Ounces"))))
        .when(t == 9, F.create_map(F.lit("Size"), F.concat(size, F.lit(" Pounds")), F.lit("Item Package Quantity"), packs))
        .when(t == 10, F.create_map(F.lit("Size"), F.concat((2 * F.col("p_size") + 3).cast("string"), F.lit(" Pounds"))))
        .when(t == 11, F.create_map(F.lit("Number of Items"), packs))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    price = (
        F.when(_key(13) == 0, F.lit("null"))
        .when(_key(29) == 0, F.lit('"—"'))
        .when(_key(31) == 0, F.lit('"from $8.00"'))
        .when(_key(37) == 0, F.lit("0"))
        .otherwise(F.col("p_retailprice").cast("decimal(12,2)").cast("string"))
    )
    tenths = F.lit(10) + F.floor(F.lit(4) * F.col("_cents") / F.col("_n"))
    count_of = F.when(_key(41) == 0, F.lit("null")).when(_key(43) == 0, F.lit("0")).otherwise((F.col("_n") * F.when(_key(7) == 0, 20).otherwise(1)).cast("string"))
    return parts.join(rated, "p_partkey").select(
        F.concat(F.lit("P"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("parent_asin"),
        title.alias("title"),
        price.alias("price"),
        (tenths.cast("decimal(4,1)") / 10).cast("decimal(3,1)").cast("string").alias("average_rating"),
        count_of.alias("rating_number"),
        F.to_json(details).alias("details"),
    )
