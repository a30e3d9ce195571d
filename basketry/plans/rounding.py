"""Doubles are rounded where results leave a query: sums may differ in their last bits with the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
