"""Costs of owner-occupied housing by four approaches, and tender prices against input costs; many series in one plan.

A series is all rows with one name in `series`: (series, period, value). Null values do not exist. Series without a base
(their first value is 0) have no rows in a result; `unbased` names them.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class HousingError(ValueError):
    """An approach that the data or the parameters do not allow."""


def _first(value: str) -> F.Column:
    return F.first(value).over(Window.partitionBy("series").orderBy("period"))


def unbased(series: DataFrame) -> DataFrame:
    """series: those whose first value is 0."""
    first = series.filter("value is not null").groupBy("series").agg(F.min_by("value", "period").alias("first"))
    return first.filter("first = 0").select("series")


def rebased(series: DataFrame) -> DataFrame:
    """series, period, index: first value = 100."""
    s = series.filter("value is not null").withColumn("_first", _first("value"))
    return s.filter("_first <> 0").select("series", "period", (F.col("value") / F.col("_first") * 100).alias("index"))


def rental_equivalence(rents: DataFrame) -> DataFrame:
    """series, period, index: market rents stand for what owners would pay."""
    return rebased(rents)


def net_acquisitions(prices: DataFrame, land_share: float = 0.0, land: DataFrame | None = None) -> DataFrame:
    """series, period, price, land, index of dwellings new to households: (price - share x land) / (1 - share).

    price and land are rebased first. Without a land share land is included and null; without a land price in a period
    its index is null.
    """
    p = rebased(prices).withColumnRenamed("index", "price")
    if not land_share:
        return p.select("series", "period", "price", F.lit(None).cast("double").alias("land"), F.col("price").alias("index"))
    if not 0 < land_share < 1:
        raise HousingError("the land share has to lie between 0 and 1")
    if land is None:
        raise HousingError("land cannot be taken out without its prices")
    j = p.join(rebased(land).withColumnRenamed("index", "land"), ["series", "period"], "left")
    return j.withColumn("index", (F.col("price") - land_share * F.col("land")) / (1 - land_share)).select("series", "period", "price", "land", "index")


def rate_gaps(prices: DataFrame, rates: DataFrame) -> DataFrame:
    """series, n: series with periods without an interest rate (period, rate); user_cost leaves them out."""
    return prices.filter("value is not null").join(rates.filter("rate is not null"), "period", "left_anti").groupBy("series").agg(F.count("*").alias("n"))


def user_cost(prices: DataFrame, rates: DataFrame, *, depreciation: float = 1.5, maintenance: float = 1.0, tax: float = 0.5, years: int = 5, per_year: int = 4) -> DataFrame:
    """series, period, price, rate, expected, cost, realised_cost, index: price x (rate + upkeep - expected gain) / 100.

    Rates are percent a year. The expected gain is the mean annual growth over `years`; where the series is shorter, the
    mean of the gains realised so far, else 0. Costs may be negative. Without a cost in the first period the index is null.
    """
    w = Window.partitionBy("series").orderBy("period")
    p = rebased(prices).withColumnRenamed("index", "price").join(rate_gaps(prices, rates), "series", "left_anti")
    p = p.join(rates.select("period", "rate"), "period")
    p = p.withColumn("realised", (F.col("price") / F.lag("price", per_year).over(w) - 1) * 100)
    long_run = (F.pow(F.col("price") / F.lag("price", years * per_year).over(w), F.lit(1 / years)) - 1) * 100
    so_far = F.avg("realised").over(w.rowsBetween(Window.unboundedPreceding, 0))
    p = p.withColumn("expected", F.coalesce(long_run, so_far, F.lit(0.0)))
    held = F.col("rate") + depreciation + maintenance + tax
    p = p.withColumn("cost", F.col("price") * (held - F.col("expected")) / 100).withColumn("realised_cost", F.col("price") * (held - F.coalesce("realised", F.lit(0.0))) / 100)
    first = _first("cost")
    return p.withColumn("index", F.when(first != 0, F.col("cost") / first * 100)).select("series", "period", "price", "rate", "expected", "cost", "realised_cost", "index")


def payments(outlays: DataFrame) -> DataFrame:
    """series, period, total, index of cash outlays (series, period, kind, value); first period = 100.

    A period that lacks one of its series' kinds has no row. Repayments of principal are saving: their kinds are refused.
    """
    saving = outlays.filter(F.lower("kind").rlike("capital|principal")).select("kind").distinct().limit(5).collect()
    if saving:
        raise HousingError(f"repayments of principal are no payments: {sorted(r['kind'] for r in saving)}")
    sums = outlays.filter("value is not null").groupBy("series", "period").agg(F.sum("value").alias("value"), F.count_distinct("kind").alias("kinds"))
    every = outlays.groupBy("series").agg(F.count_distinct("kind").alias("all_kinds"))
    total = sums.join(every, "series").filter("kinds = all_kinds").select("series", "period", "value")
    return total.withColumnRenamed("value", "total").join(rebased(total), ["series", "period"])


# --- construction ---


def output_price_index(rates: DataFrame, bill: Mapping[str, float]) -> DataFrame:
    """series, period, index of tender rates (series, period, item, rate): the bill's cost at the mean rates of a period.

    First period in which every item of the bill has a rate = 100; periods that lack one are null.
    """
    quantity = F.create_map(*[F.lit(x) for kv in bill.items() for x in kv])
    mean = rates.filter(F.col("item").isin(*bill) & F.col("rate").isNotNull()).groupBy("series", "period", "item").agg(F.avg("rate").alias("rate"))
    cost = mean.groupBy("series", "period").agg(F.sum(quantity[F.col("item")] * F.col("rate")).alias("cost"), F.count("*").alias("n"))
    cost = cost.withColumn("cost", F.when(F.col("n") == len(bill), F.col("cost")))
    base = F.first("cost", ignorenulls=True).over(Window.partitionBy("series").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return cost.select("series", "period", (F.col("cost") / base * 100).alias("index"))


def output_over_input(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """series, period, input, output, gap: output prices over input costs (both series, period, index), times 100.

    Both are set to 100 in the first period that both have, so that they share a base.
    """
    j = inputs.select("series", "period", F.col("index").alias("input")).join(outputs.select("series", "period", F.col("index").alias("output")), ["series", "period"]).filter("input is not null and output is not null")
    j = j.withColumn("_i", _first("input")).withColumn("_o", _first("output")).filter("_i <> 0 and _o <> 0")
    j = j.select("series", "period", (F.col("input") / F.col("_i") * 100).alias("input"), (F.col("output") / F.col("_o") * 100).alias("output"))
    return j.withColumn("gap", F.col("output") / F.col("input") * 100)
