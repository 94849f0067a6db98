"""Rounding of float columns, so that the order of a sum does not show in a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(F.col(c).cast("double"), digits))
    return df
