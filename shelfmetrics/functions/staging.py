"""Columns in stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stage(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds or replaces columns behind a generator of one row, which the optimiser doesn't merge projections across.

    Otherwise each column's expression would be copied wherever it is used, stage upon stage.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[e.alias(n) for n, e in columns.items()]))))
