"""Units of weight, volume and count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical units with their dimension and exact factor to grams, millilitres or pieces.
UNITS = {
    "oz": ("weight", 28.349523125),
    "lb": ("weight", 453.59237),
    "g": ("weight", 1.0),
    "kg": ("weight", 1000.0),
    "fl oz": ("volume", 29.5735295625),
    "ml": ("volume", 1.0),
    "l": ("volume", 1000.0),
    "gal": ("volume", 3785.411784),
    "qt": ("volume", 946.352946),
    "pt": ("volume", 473.176473),
    "ct": ("count", 1.0),
}

# How units are written, in the order in which they are tried.
ALIASES = [
    (r"fl\.?\s*oz\.?|fluid\s*ounces?|fl\.\s*ounces?", "fl oz"),
    (r"ounces?|oz\.?", "oz"),
    (r"pounds?|lbs?\.?", "lb"),
    (r"kilograms?|kgs?", "kg"),
    (r"grams?|gr|g", "g"),
    (r"milliliters?|millilitres?|ml", "ml"),
    (r"liters?|litres?|ltr|l", "l"),
    (r"gallons?|gal", "gal"),
    (r"quarts?|qt", "qt"),
    (r"pints?|pt", "pt"),
]


def _by_unit(unit: Column, values: dict) -> Column:
    # a lookup names the unit's expression once, where a case for each unit would copy it
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), unit)


def factor(unit: Column) -> Column:
    """What one of the unit is in its dimension's base."""
    return _by_unit(unit, {u: f for u, (_, f) in UNITS.items()})


def dimension(unit: Column) -> Column:
    return _by_unit(unit, {u: d for u, (d, _) in UNITS.items()})


def canonical_unit(written: Column) -> Column:
    """The unit that a way of writing it names; null if none."""

    def named(text: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, unit in reversed(ALIASES):
            out = F.when(text.rlike(f"(?U)^(?:{pattern})$"), unit).otherwise(out)
        return out

    # the lambda's variable stands for the text, which is thus computed once
    return F.get(F.transform(F.array(F.lower(F.trim(written))), named), F.lit(0))


def agree(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two amounts differ by at most a share of the larger."""
    return F.abs(a - b) <= F.lit(tolerance) * F.greatest(a, b)
