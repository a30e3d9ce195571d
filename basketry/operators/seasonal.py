"""Seasonal items and series: class treatments, counter-seasonal estimates, a seasonal-trend decomposition, projections."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.sources.staging import staged


def chained_aggregate(components: DataFrame, weights: DataFrame, base_value: float = 100.0) -> DataFrame:
    """period, index: links are weighted means of the components' relatives; weights has component, period, weight.

    A period without a usable component holds the level. With constant weights this is class confinement, with
    weights of what is in season it is the weight update.
    """
    before = F.lag("index").over(Window.partitionBy("component").orderBy("period"))
    c = components.withColumn("relative", F.col("index") / before)
    usable = c.join(weights, ["component", "period"]).filter("relative is not null and weight > 0")
    links = usable.groupBy("period").agg((F.sum(F.col("weight") * F.col("relative")) / F.sum("weight")).alias("link"))
    grid = components.select("period").distinct().join(links, "period", "left")
    level = base_value * F.exp(F.sum(F.coalesce(F.ln("link"), F.lit(0.0))).over(Window.orderBy("period")))  # one row a period
    return grid.select("period", level.alias("index"))


def in_season_weights(panel: DataFrame, group: str = "category") -> DataFrame:
    """component, period, weight: the mean expenditures of the items that are priced in the period."""
    w = panel.groupBy(group, "item_id").agg(F.avg("expenditure").alias("w"))
    return panel.filter("price > 0").join(w, [group, "item_id"]).groupBy(F.col(group).alias("component"), "period").agg(F.sum("w").alias("weight"))


def constant_weights(panel: DataFrame, group: str = "category") -> DataFrame:
    """component, period, weight: the mean expenditures of all items, in every period of the component."""
    w = panel.groupBy(group, "item_id").agg(F.avg("expenditure").alias("w")).groupBy(group).agg(F.sum("w").alias("weight"))
    return panel.select(group, "period").distinct().join(w, group).select(F.col(group).alias("component"), "period", "weight")


def counter_seasonal(panel: DataFrame, group: str = "category") -> DataFrame:
    """panel with a row for every item and every period of its category between its first and last price.

    Missing prices follow the category's mean movement from the item's last price; links that no item matches count
    as no movement, and a cell at such a link stays empty. Adds price_imputed and imputation.
    """
    from basketry.operators.quality import impute_by_movement

    panel = staged(panel, "panel")
    spans = panel.filter("price > 0").groupBy(group, "item_id").agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = spans.join(F.broadcast(panel.select(group, "period").distinct()), group).filter("period between a and b")  # a row a period and group.select(group, "item_id", "period")
    full = staged(grid.join(panel, [group, "item_id", "period"], "left").withColumn("price_clean", F.when(F.col("price") > 0, F.col("price"))), "full")
    filled = impute_by_movement(full, "targeted_mean")
    return filled.withColumn("imputation", F.when(F.col("imputation").isNotNull(), "counter_seasonal"))


def loess(y: np.ndarray, x: np.ndarray, at: np.ndarray, span: int, robust: np.ndarray) -> np.ndarray:
    """Locally linear smooth of y(x) at the points given, tricube weights over the nearest `span` points."""
    out = np.empty(len(at))
    k = min(span, len(x))
    for n, a in enumerate(at):
        d = np.abs(x - a)
        h = np.partition(d, k - 1)[k - 1] * (1.0 if span <= len(x) else span / len(x)) + 1e-12
        w = robust * np.clip(1 - (d / h) ** 3, 0, None) ** 3
        total = w.sum()
        if total <= 0:
            out[n] = y.mean()
            continue
        mean, centre = (w * x).sum() / total, (w * y).sum() / total
        spread = (w * (x - mean) ** 2).sum()
        slope = (w * (x - mean) * (y - centre)).sum() / spread if spread > 1e-12 else 0.0
        out[n] = centre + slope * (a - mean)
    return out


def decompose_series(y: np.ndarray, period: int = 12, seasonal: int = 7, outer: int = 5, inner: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trend, seasonal and remainder by robust local regression of the cycle's sub-series and of what they leave."""
    n, x = len(y), np.arange(len(y), dtype=float)
    wide = int(np.ceil(1.5 * period / (1 - 1.5 / seasonal)))
    wide += 1 - wide % 2
    low = period + 1 - period % 2
    trend, cycle, robust = np.zeros(n), np.zeros(n), np.ones(n)
    for _ in range(outer):
        for _ in range(inner):
            free = y - trend
            long = np.empty(n + 2 * period)
            for k in range(period):
                own = np.arange(k, n, period)
                m = len(own)
                long[k :: period][: m + 2] = loess(free[own], np.arange(m, dtype=float), np.arange(-1, m + 1, dtype=float), seasonal, robust[own])
            smooth = long
            for width in (period, period, 3):
                smooth = np.convolve(smooth, np.ones(width) / width, "valid")
            cycle = long[period : period + n] - loess(smooth, x, x, low, np.ones(n))
            trend = loess(y - cycle, x, x, wide, robust)
        rest = y - trend - cycle
        scale = 6 * np.median(np.abs(rest)) + 1e-12
        robust = np.clip(1 - (rest / scale) ** 2, 0, None) ** 2
    return trend, cycle, y - trend - cycle


def adjust(series: DataFrame, period: int = 12) -> DataFrame:
    """series, period, index, trend, seasonal, adjusted: each series with two years or more, on logs, as one small group.

    A series is one number a month, so a group's size is the length of its history.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period").dropna(subset=["index"])
        pdf = pdf[pdf["index"] > 0]
        if len(pdf) < 2 * period:
            return pdf.iloc[:0].assign(trend=[], seasonal=[], adjusted=[])[["series", "period", "index", "trend", "seasonal", "adjusted"]]
        trend, cycle, _ = decompose_series(np.log(pdf["index"].to_numpy()), period)
        return pdf.assign(trend=np.exp(trend), seasonal=np.exp(cycle), adjusted=pdf["index"] / np.exp(cycle))[["series", "period", "index", "trend", "seasonal", "adjusted"]]

    return series.select("series", "period", "index").groupBy("series").applyInPandas(one, "series string, period date, index double, trend double, seasonal double, adjusted double")


def naive_backtest(series: DataFrame, horizons: int = 12, period: int = 12) -> DataFrame:
    """series, method, horizon, rmse (percent), n: log errors of the random walk and the seasonal naive at every origin.

    A forecast h ahead is the level at the origin, or the one a period before the target: both are lags, so all
    origins are one pass of windows.
    """
    w = Window.partitionBy("series").orderBy("period")
    s = series.filter("index > 0").select("series", F.ln("index").alias("y"), *[F.ln(F.lag("index", h).over(w)).alias(f"l{h}") for h in range(1, max(horizons, period) + 1)])
    walk = [F.struct(F.lit("random_walk").alias("method"), F.lit(h).alias("horizon"), (F.col("y") - F.col(f"l{h}")).alias("e")) for h in range(1, horizons + 1)]
    season = [F.struct(F.lit("seasonal_naive").alias("method"), F.lit(h).alias("horizon"), (F.col("y") - F.col(f"l{period}")).alias("e")) for h in range(1, min(horizons, period) + 1)]
    e = s.select("series", F.explode(F.array(*walk, *season)).alias("x")).select("series", "x.*").filter("e is not null")
    return e.groupBy("series", "method", "horizon").agg((F.sqrt(F.avg(F.col("e") ** 2)) * 100).alias("rmse"), F.count("*").alias("n"))


def scenario_path(series: DataFrame, shock_pct: float, coefficient: float, phase_in: int, horizon: int = 24, growth: float = 0.0) -> DataFrame:
    """series, step, baseline, scenario: the last year repeated with growth, and a shock phased in on top."""
    w = Window.partitionBy("series").orderBy(F.desc("period"))
    last = series.withColumn("back", F.row_number().over(w) - 1).filter("back < 12").groupBy("series").agg(F.map_from_entries(F.collect_list(F.struct("back", "index"))).alias("y"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    back = 11 - (F.col("step") - 1) % 12
    cycle = F.floor((F.col("step") - 1) / 12) + 1
    base = F.element_at("y", back) * F.pow(F.element_at("y", F.lit(0)) / F.element_at("y", F.lit(11)) * F.lit(1 + growth), cycle)
    ramp = F.least(F.col("step") / float(phase_in), F.lit(1.0))
    effect = F.log1p(F.lit(shock_pct / 100)) * coefficient * ramp
    return steps.select("series", "step", base.alias("baseline"), (base * F.exp(effect)).alias("scenario"))


def chain_linked(components: DataFrame, weights: DataFrame) -> DataFrame:
    """period, index: a yearly chained Laspeyres index linked in December; weights has component, year, weight.

    Within a year it is the weighted mean of levels over their last December's; the December values chain the years.
    """
    c = components.withColumn("year", F.year("period"))
    dec = c.filter(F.month("period") == 12).select("component", (F.col("year") + 1).alias("year"), F.col("index").alias("link"))
    j = c.join(dec, ["component", "year"]).join(weights, ["component", "year"])
    within = j.groupBy("year", "period").agg((F.sum(F.col("weight") * F.col("index") / F.col("link")) / F.sum("weight")).alias("ratio"))
    ends = within.filter(F.month("period") == 12).select((F.col("year") + 1).alias("year"), "ratio")
    years = within.select("year").distinct().join(ends, "year", "left").withColumn("start", F.exp(F.sum(F.coalesce(F.ln("ratio"), F.lit(0.0))).over(Window.orderBy("year"))))  # one row a year
    return within.drop("start").join(years.select("year", "start"), "year").select("period", (100 * F.col("start") * F.col("ratio")).alias("index"))
