"""Raw records to typed items under a strict contract, with every bad row reported."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmetrics.functions.decoding import is_blank, price_of, read_cells
from shelfmetrics.functions.staging import stage

FIELDS = ("parent_asin", "title", "price", "average_rating", "rating_number", "details")
#: Raw records hold text; four cells hold JSON text.
RAW = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])
#: Details keys that anything reads.
DETAIL_KEYS = (
    "Unit Count", "Number of Items", "Item Package Quantity", "Size", "Item Weight", "Item Volume", "Liquid Volume", "Volume", "Sheet Count", "Number of Pieces", "Package Information", "Item Form",
)


class MalformedRows(ValueError):
    """All bad rows of a load: ``rows`` is a DataFrame (row_index, parent_asin, errors), ``first`` its first fifty, which the text shows."""

    def __init__(self, count: int, first: list[tuple[int, str | None, list[str]]], rows: DataFrame | None = None):
        self.count, self.first, self.rows = count, first, rows
        shown = "\n".join(f"  row {index} ({asin or '?'}): {'; '.join(messages)}" for index, asin, messages in first[:50])
        more = f"\n  and {count - 50} more" if count > 50 else ""
        super().__init__(f"{count} malformed rows:\n{shown}{more}")


def check_columns(df: DataFrame) -> None:
    if missing := [f for f in FIELDS if f not in df.columns]:
        raise ValueError(f"fields absent in the source: {', '.join(missing)}")


def decoded(raw: DataFrame) -> DataFrame:
    """Adds to raw records: drop_reason, price_null_reason, errors, and typed columns under a leading underscore.

    Blank titles are dropped before prices are looked at, so they add no price reason; a row with errors adds none either.
    """
    check_columns(raw)
    cells = ("price", "average_rating", "rating_number", "details")
    rows = read_cells(raw, *cells)
    price, reason, price_error = price_of(F.col("price_kind"), F.col("price_number"), F.col("price_v"))
    rows = stage(
        rows,
        {
            "_price": price,
            "_reason": reason,
            "_price_error": price_error,
            "_rating": F.col("average_rating_number"),
            "_count": F.when(F.col("rating_number_kind") == "integer", F.try_variant_get("rating_number_v", "$", "bigint")),
            "_details": F.from_json("details", T.MapType(T.StringType(), T.StringType())),
            "drop_reason": F.when(F.col("title").isNotNull() & is_blank(F.col("title")), "empty_title"),
        },
    )
    says = lambda wrong, message: F.when(wrong, F.lit(message))
    kind = {c: F.col(f"{c}_kind") for c in cells}
    json_errors = [says(kind[f].isin("missing", "bad"), f"{f}: absent in the source or bad JSON") for f in cells[1:]]
    contract = [
        says(F.col("parent_asin").isNull() | (F.col("parent_asin") == ""), "parent_asin: empty"),
        says(F.col("title").isNull(), "title: absent"),
        F.col("_price_error"),
        says(kind["average_rating"].isin("boolean", "string", "array", "object"), "average_rating: not a number"),
        says((F.col("_rating") < 1) | (F.col("_rating") > 5), "average_rating: outside 1 to 5"),
        says(kind["rating_number"].isin("boolean", "string", "array", "object", "number"), "rating_number: not a whole number"),
        says((kind["rating_number"] == "integer") & (F.col("_count").isNull() | (F.col("_count") < 0)), "rating_number: negative or too large"),
        says(kind["details"].isin("null", "boolean", "string", "array", "integer", "number"), "details: not an object"),
    ]
    errors = F.filter(F.array(*json_errors, *contract), lambda e: e.isNotNull())
    rows = stage(rows, {"errors": F.when(F.col("drop_reason").isNull(), errors).otherwise(F.array().cast("array<string>"))})
    sound = F.col("drop_reason").isNull() & (F.size("errors") == 0)
    return stage(rows, {"price_null_reason": F.when(sound, F.col("_reason"))}).select(*raw.columns, "drop_reason", "errors", "price_null_reason", "_price", "_rating", "_count", "_details")


def typed(rows: DataFrame) -> DataFrame:
    """The sound rows of ``decoded`` as items."""
    return rows.where(F.col("drop_reason").isNull() & (F.size("errors") == 0)).select(
        "parent_asin", "title", F.col("_price").alias("price"), F.col("_rating").alias("average_rating"), F.col("_count").alias("rating_number"), F.col("_details").alias("details")
    )


def load_report(rows: DataFrame) -> DataFrame:
    """One row: rows read, loaded, dropped for blank titles, malformed, priced, and null prices by reason."""
    sound = F.col("drop_reason").isNull() & (F.size("errors") == 0)
    reason = lambda r: F.count_if(F.col("price_null_reason") == r).alias(f"price_{r}")
    return rows.agg(
        F.count("*").alias("rows_read"),
        F.count_if(sound).alias("rows_loaded"),
        F.count_if(F.col("drop_reason") == "empty_title").alias("empty_titles"),
        F.count_if(F.size("errors") > 0).alias("malformed"),
        F.count_if(sound & F.col("_price").isNotNull()).alias("priced"),
        *[reason(r) for r in ("missing", "dash", "from_range", "non_positive")],
    )


@dataclass(frozen=True)
class Loaded:
    items: DataFrame
    report: DataFrame


def gate(manifest: str | Path | None) -> None:
    """Refuses data whose ingest met bad lines. No manifest, no gate."""
    if manifest and Path(manifest).exists() and (bad := json.loads(Path(manifest).read_text()).get("unparseable_json_lines", 0)):
        raise MalformedRows(bad, [(-1, "-", [f"{bad} source lines are no records; see {manifest}"])])


def load_items(spark: SparkSession, raw: DataFrame | str, manifest: str | Path | None = None) -> Loaded:
    """Typed items, or MalformedRows once every row has been checked.

    A bad row is known by its index: its place in the Parquet files, in the order of their names, or for a DataFrame in its rows.
    """
    gate(manifest)
    if isinstance(raw, str):
        frame = spark.read.schema(RAW).parquet(raw) if set(FIELDS) <= set(spark.read.parquet(raw).columns) else spark.read.parquet(raw)
        place = F.struct("_metadata.file_path", "_metadata.row_index")
    else:
        frame, place = raw, F.struct(F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index"))
    check_columns(frame)
    bad = decoded(frame.select(*FIELDS, place.alias("_place"))).where(F.size("errors") > 0).select("_place", "parent_asin", "errors")
    if head := bad.orderBy("_place").limit(50).collect():
        index = F.col("_place.row_index")
        if isinstance(raw, str):  # rows of the files before: a row for each file
            counts = spark.read.parquet(raw).groupBy(F.col("_metadata.file_path").alias("file_path")).count()
            before = Window.orderBy("file_path").rowsBetween(Window.unboundedPreceding, -1)
            counts = counts.select("file_path", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
            known = {r[0]: r[1] for r in counts.collect()}
            rows = bad.join(F.broadcast(counts), F.col("_place.file_path") == F.col("file_path")).select((index + F.col("_before")).alias("row_index"), "parent_asin", "errors")
        else:
            known, rows = {"": 0}, bad.select(index.alias("row_index"), "parent_asin", "errors")
        raise MalformedRows(bad.count(), [(r[0].row_index + known[r[0].file_path], r[1], list(r[2])) for r in head], rows)
    rows = decoded(frame)
    return Loaded(typed(rows), load_report(rows))


def priced(items: DataFrame) -> DataFrame:
    """Items that can be ranked: those with a price."""
    return items.where(F.col("price").isNotNull())


def detail_columns(items: DataFrame) -> DataFrame:
    """The details that anything reads, a column each, empty where absent."""
    value = lambda k: F.coalesce(F.try_element_at("details", F.lit(k)), F.lit(""))
    return items.select("parent_asin", "title", "price", *[value(k).alias(k.lower().replace(" ", "_")) for k in DETAIL_KEYS])
