"""Descriptive statistics of a raw catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmetrics.functions.decoding import json_kind, json_number

PERCENTILES = (0.01, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
EDGES = (0, 5, 10, 15, 20, 30, 50, 100, 200, 500)


def _share(condition) -> object:
    return F.round(100 * F.avg(condition.cast("double")), 2)


def _percentiles(column) -> list:
    # one exact pass for all
    return [F.get(F.percentile(column, F.array(*[F.lit(p) for p in PERCENTILES])), F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(PERCENTILES)]


def profile_prices(raw: DataFrame) -> DataFrame:
    """Rows, repeated ids, shares of non-null and numeric prices, and the distribution of prices above zero. One row."""
    price, kind = json_number(F.col("price")), json_kind(F.col("price"))
    rows = raw.select("parent_asin", price.alias("price"), kind.alias("kind"))
    above = F.when(F.col("price") > 0, F.col("price"))
    return rows.agg(
        F.count("*").alias("n_rows"),
        (F.count("*") - F.countDistinct("parent_asin") - F.max(F.col("parent_asin").isNull().cast("int"))).alias("duplicate_ids"),
        _share(~F.col("kind").isin("null", "missing")).alias("pct_non_null"),
        _share(F.col("price").isNotNull()).alias("pct_numeric"),
        F.count_if(F.col("price") <= 0).alias("non_positive"),
        F.count(above).alias("n"),
        F.round(F.avg(above), 2).alias("mean"),
        F.min(above).alias("min"),
        *_percentiles(above),
        F.max(above).alias("max"),
    )


def price_histogram(raw: DataFrame) -> DataFrame:
    """Prices above zero in bins closed at the left; every bin is listed, the last without an end."""
    spark = raw.sparkSession
    ends = [*map(float, EDGES[1:]), float("inf")]
    bins = spark.createDataFrame([(k, f"[{float(a)}, {b})") for k, (a, b) in enumerate(zip(EDGES, ends, strict=True))], "bin int, label string")
    price = json_number(F.col("price"))
    bin_of = F.size(F.filter(F.array(*[F.lit(float(e)) for e in EDGES]), lambda e: e <= F.col("price"))) - 1
    counts = raw.select(price.alias("price")).where("price > 0").groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"))
    return F.broadcast(bins).join(counts, "bin", "left").select("bin", "label", F.coalesce("n", F.lit(0)).alias("n"))  # ten bins


def price_texts(raw: DataFrame, top: int = 10) -> DataFrame:
    """The commonest prices that aren't numbers, as their JSON text."""
    odd = raw.where(~json_kind(F.col("price")).isin("integer", "number", "null", "missing"))
    return odd.groupBy(F.col("price").alias("price_text")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "price_text").limit(top)


def profile_ratings(raw: DataFrame) -> DataFrame:
    """Shares and odd values of ratings and counts, and the whole catalogue's priors. One row."""
    stars, count = json_number(F.col("average_rating")), json_number(F.col("rating_number"))
    rows = raw.select(json_kind(F.col("average_rating")).alias("rk"), json_kind(F.col("rating_number")).alias("ck"), stars.alias("stars"), count.alias("count"))
    rated = F.col("stars").isNotNull() & (F.col("count") >= 1)
    r, n = F.when(rated, F.col("stars").cast("decimal(12,6)")), F.when(rated, F.col("count"))
    other = lambda kind: F.count_if(~F.col(kind).isin("integer", "number", "null", "missing"))
    return rows.agg(
        _share(~F.col("rk").isin("null", "missing")).alias("pct_rating"),
        other("rk").alias("odd_ratings"),
        F.count_if((F.col("stars") < 1) | (F.col("stars") > 5)).alias("out_of_range"),
        _share(~F.col("ck").isin("null", "missing")).alias("pct_count"),
        other("ck").alias("odd_counts"),
        F.count_if(F.col("count") == 0).alias("zero_counts"),
        _share(F.coalesce(F.col("count") >= 1, F.lit(False))).alias("pct_count_ge_1"),
        F.count_if(rated).alias("n_rated"),
        F.round(F.sum(r).cast("double") / F.count(r), 4).alias("C_simple"),
        F.round(F.sum(r * n.cast("decimal(18,0)")).cast("double") / F.sum(n), 4).alias("C_weighted"),
        F.percentile(n, F.lit(0.5)).alias("m_median"),
        *_percentiles(n),
    )


def markdown(row: dict, title: str) -> str:
    """A one-row profile as a table."""
    return "\n".join([f"# {title}", "", "| Metric | Value |", "|---|---|", *[f"| {k} | {v} |" for k, v in row.items()]]) + "\n"
