"""Evaluate costly expressions once per row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters and projections read but never re-evaluate.

    Catalyst pushes a filter on a projected column below the projection by
    repeating the column's expression, so a parsed payload used in a filter
    and in the output would be parsed several times. A filter on the output of a
    generator stays above it. The expressions themselves are evaluated in a plain
    projection, which is compiled and shares common parts; the one-row ``inline``
    on top only passes them on.
    """
    given = df.columns
    computed = df.select("*", *[value.alias(name) for name, value in columns.items()])
    return computed.select(*given, F.inline(F.array(F.struct(*columns))))
