"""Cells of JSON text, by their JSON types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import stage

#: A price that is a lower bound.
RANGE = r"^from \$?\d+(\.\d+)?$"
DASH = "—"


def parsed(cell: Column) -> Column:
    """The cell's JSON value; null for text that isn't one. The parser ignores what follows a value, so that the text is
    also parsed as an array's only element."""
    return F.when(F.json_array_length(F.concat(F.lit("["), cell, F.lit("]"))) == 1, F.try_parse_json(cell))


def kind_of(cell: Column, value: Column) -> Column:
    """The JSON type of a cell, given its parsed value: null, boolean, integer, number, string, array, object; bad for
    text that isn't JSON; missing for no text."""
    kind = F.schema_of_variant(value)
    return (
        F.when(cell.isNull(), "missing")
        .when(value.isNull(), "bad")
        .when(F.is_variant_null(value), "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "BIGINT", "integer")
        .when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def number_of(kind: Column, value: Column) -> Column:
    """A JSON number as a double; null for anything else, numbers in quotes and booleans among it."""
    return F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))


def json_kind(cell: Column) -> Column:
    return kind_of(cell, parsed(cell))


def json_number(cell: Column) -> Column:
    return number_of(json_kind(cell), parsed(cell))


def read_cells(df: DataFrame, *cells: str) -> DataFrame:
    """Adds, for each cell, its parsed value, JSON type and number under its name with _v, _kind and _number."""
    df = stage(df, {f"{c}_v": parsed(F.col(c)) for c in cells})
    df = stage(df, {f"{c}_kind": kind_of(F.col(c), F.col(f"{c}_v")) for c in cells})
    return stage(df, {f"{c}_number": number_of(F.col(f"{c}_kind"), F.col(f"{c}_v")) for c in cells})


def price_of(kind: Column, number: Column, value: Column) -> tuple[Column, Column, Column]:
    """(price, why it is null, error) of a price cell.

    A number above zero is the price. Null, a dash, a price from some amount on, and numbers that aren't positive are
    known conditions. All else is an error, a number in quotes among it.
    """
    text = F.trim(F.when(kind == "string", F.try_variant_get(value, "$", "string")))
    price = F.when(number > 0, number)
    reason = F.when(kind == "null", "missing").when(number <= 0, "non_positive").when(text == DASH, "dash").when(text.rlike(RANGE), "from_range")
    known = price.isNotNull() | reason.isNotNull()
    error = F.when(~known, F.when(kind == "bad", "price: bad JSON").when(kind == "missing", "price: missing in source").otherwise("price: unrecognised"))
    return price, reason, error


def is_blank(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*$")
