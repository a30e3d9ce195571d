"""Quotes that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unit_value_stream(quotes: DataFrame, late: str = "40 days") -> DataFrame:
    """category, item_id, start, expenditure, quantity, price of 30-day windows over a stream of sales.

    quotes has ts, category, item_id, price, quantity. Sales that come later than `late` after the newest one seen are
    left to the next compilation of the panel; state is one sum for each item and open window.
    """
    w = quotes.withWatermark("ts", late).groupBy(F.window("ts", "30 days").alias("w"), "category", "item_id")
    s = w.agg(F.sum(F.col("price") * F.col("quantity")).alias("expenditure"), F.sum("quantity").alias("quantity"))
    return s.select("category", "item_id", F.col("w.start").alias("start"), "expenditure", "quantity", (F.col("expenditure") / F.nullif(F.col("quantity"), F.lit(0.0))).alias("price"))
