"""Multilateral indices of scanner data and their extension."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.linalg import fixed_point_levels, two_way_dummies
from basketry.sources.staging import staged


def unit_value_panel(panel: DataFrame, *by: str) -> DataFrame:
    """by, period, item_id, price, quantity, expenditure: one row for each, positive prices and quantities from 0."""
    p = panel.filter("price > 0 and quantity >= 0").groupBy(*by, "period", "item_id").agg(F.sum("expenditure").alias("expenditure"), F.sum("quantity").alias("quantity"))
    return p.filter("quantity > 0").withColumn("price", F.col("expenditure") / F.col("quantity"))


def _key(windows: DataFrame | None, by: str | None) -> list[str]:
    return ["window"] if windows is not None else [by] if by else []


def log_pairs(panel: DataFrame, block: str = "fisher", least: int = 2, windows: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """s, t, log_ratio, matched (and window, or by) for all periods s < t with `least` items in common.

    A self-join on the item, grouped at once. windows (window, period), if given, keeps to pairs inside a window; by
    names a column whose values are compared each on their own.
    """
    p = unit_value_panel(panel, *([by] if by else []))
    if windows is not None:
        p = p.join(F.broadcast(windows), "period")  # windows x periods rows
    keys = [*_key(windows, by), "item_id"]
    a = p.select(*keys, F.col("period").alias("s"), F.col("price").alias("p0"), F.col("quantity").alias("q0"), F.col("expenditure").alias("e0"))
    b = p.select(*keys, F.col("period").alias("t"), F.col("price").alias("pt"), F.col("quantity").alias("qt"), F.col("expenditure").alias("et"))
    ratio = F.ln(F.col("pt") / F.col("p0"))
    if block == "fisher":
        value = 0.5 * F.ln(F.sum(F.col("pt") * F.col("q0")) / F.sum(F.col("p0") * F.col("q0")) * F.sum(F.col("pt") * F.col("qt")) / F.sum(F.col("p0") * F.col("qt")))
    else:
        value = 0.5 * (F.sum(F.col("e0") * ratio) / F.sum("e0") + F.sum(F.col("et") * ratio) / F.sum("et"))
    out = a.join(b, keys).filter("s < t").groupBy(*keys[:-1], "s", "t").agg(value.alias("log_ratio"), F.count("*").alias("matched"))
    return out.filter(F.col("matched") >= least)


def geks(panel: DataFrame, block: str = "fisher", base_value: float = 100.0, windows: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """period, index (and window, or by): the geometric mean over all bridges of the two-period indices through them.

    A bridge is a period that compares with every other one; without one there are no rows. With by, each value of that
    column has an index of its own.
    """
    key = _key(windows, by)
    one = log_pairs(panel, block, windows=windows, by=by)
    periods = panel.select(*key, "period").distinct() if windows is None else windows
    both = one.select(*key, "s", "t", "log_ratio").unionByName(one.select(*key, F.col("t").alias("s"), F.col("s").alias("t"), (-F.col("log_ratio")).alias("log_ratio")))
    both = both.unionByName(periods.select(*key, F.col("period").alias("s"), F.col("period").alias("t"), F.lit(0.0).alias("log_ratio")))
    ends = periods.groupBy(*key).agg(F.min("period").alias("t0"), F.count("*").alias("periods"))
    full = both.groupBy(*key, "s").agg(F.count("*").alias("n"))
    full = (full.join(ends if by else F.broadcast(ends), key) if key else full.join(F.broadcast(ends))).filter("n = periods").select(*key, "s", "t0")  # one row a window
    bridged = both.join(full, [*key, "s"])
    first = bridged.filter("t = t0").select(*key, "s", F.col("log_ratio").alias("first"))
    out = bridged.join(first, [*key, "s"]).groupBy(*key, "t").agg((base_value * F.exp(F.avg(F.col("log_ratio") - F.col("first")))).alias("index"))
    return out.withColumnRenamed("t", "period")


def product_cells(panel: DataFrame, weighted: bool = False) -> DataFrame:
    """t, i, y, w: log unit values by period and item, weighed by their shares of the period's expenditure or equally."""
    p = unit_value_panel(panel.filter("period is not null and item_id is not null"))
    if weighted:
        p = staged(p, "unit values")
        p = p.join(F.broadcast(p.groupBy("period").agg(F.sum("expenditure").alias("whole"))), "period")  # one row a period
    return p.select(F.col("period").alias("t"), F.col("item_id").alias("i"), F.ln("price").alias("y"), (F.col("expenditure") / F.col("whole") if weighted else F.lit(1.0)).alias("w"))


def dummy_levels(cells: DataFrame, base_value: float = 100.0) -> DataFrame:
    """period, index from product_cells()."""
    times, effects = two_way_dummies(cells)
    return cells.sparkSession.createDataFrame([(t, float(base_value * np.exp(e))) for t, e in zip(times, effects, strict=True)], "period date, index double")


def time_product_dummy(panel: DataFrame, weighted: bool = False, base_value: float = 100.0) -> DataFrame:
    """period, index from a regression of log prices on period and product dummies; weights are expenditure shares."""
    return dummy_levels(product_cells(panel, weighted), base_value)


def geary_khamis(panel: DataFrame, base_value: float = 100.0) -> DataFrame:
    """period, index: the fixed point of average prices and levels."""
    cells = unit_value_panel(panel).select(F.col("period").alias("t"), F.col("item_id").alias("i"), F.col("price").alias("p"), F.col("quantity").alias("q"))
    times, levels = fixed_point_levels(cells)
    return panel.sparkSession.createDataFrame([(t, float(base_value * x)) for t, x in zip(times, levels, strict=True)], "period date, index double")


def extend(panel: DataFrame, window: int = 25, splice: str = "movement", block: str = "fisher", base_value: float = 100.0) -> DataFrame:
    """period, index: rolling windows of GEKS, each new period linked on by the splice.

    All windows are computed in one job; the fold over periods handles windows x periods numbers. The splices link at
    the last (movement), first (window), middle (half) or all (mean) periods that a window shares with the past.
    """
    spark = panel.sparkSession
    periods = sorted(r["period"] for r in panel.select("period").distinct().collect())
    n = min(window, len(periods))
    rows = [(k, p) for k in range(len(periods) - n + 1) for p in periods[k : k + n]]
    windows = spark.createDataFrame(rows, "window int, period date")
    levels: dict = {}
    for r in geks(panel, block, base_value, windows).collect():
        levels.setdefault(r["window"], {})[r["period"]] = r["index"]
    out = [levels[0].get(p) for p in periods[:n]]
    for k in range(1, len(periods) - n + 1):
        new = periods[k + n - 1]
        shared = list(range(k, k + n - 1))
        at = {"movement": shared[-1:], "window": shared[:1], "half": [shared[len(shared) // 2]], "mean": shared}[splice]
        logs = [np.log(out[j] * levels[k][new] / levels[k][periods[j]]) for j in at if out[j] and levels[k].get(periods[j]) and levels[k].get(new)]
        out.append(float(np.exp(np.mean(logs))) if logs else None)
    return spark.createDataFrame(list(zip(periods, out, strict=True)), "period date, index double")
