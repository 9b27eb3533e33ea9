"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, array: Column | str, name: str, *columns: Column | str) -> DataFrame:
    """A row for each element that is not null, as ``name``, with ``columns``.

    A plain ``explode`` lets Spark infer that the array is not empty and test that below, where the array is computed once more for each
    test. For an array that took a whole scan of a text, that costs more than the rows.
    """
    return df.select(*columns, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())
