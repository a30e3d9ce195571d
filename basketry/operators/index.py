"""Pairing, chaining and splicing of price indices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.formulas import formula


def period_links(panel: DataFrame, group: str = "category", base: bool = False) -> DataFrame:
    """group, period, rank, before: the group's previous present period, or with base its first one.

    All rows make a period present, priced or not. The table has one row for each group and period.
    """
    periods = panel.filter(F.col(group).isNotNull()).select(group, "period").distinct()
    w = Window.partitionBy(group).orderBy("period")
    before = F.min("period").over(Window.partitionBy(group)) if base else F.lag("period").over(w)
    return periods.select(group, "period", F.row_number().over(w).alias("rank"), before.alias("before"))


def matched_pairs(panel: DataFrame, group: str = "category", price: str = "price", base: bool = False, extra: Sequence[str] = ()) -> DataFrame:
    """group, period, item_id, p0, pt, q0, qt, w: items with positive prices in both periods of a link."""
    priced = panel.filter(F.col(price) > 0)
    now = priced.select(group, "period", "item_id", F.col(price).alias("pt"), F.col("quantity").alias("qt"), *extra)
    then = priced.select(F.col(group), F.col("period").alias("before"), "item_id", F.col(price).alias("p0"), F.col("quantity").alias("q0"), (F.col(price) * F.col("quantity")).alias("w"))
    links = period_links(panel, group, base).select(group, "period", "before")
    return now.join(links, [group, "period"]).join(then, [group, "before", "item_id"]).drop("before")


def links(panel: DataFrame, name: str = "jevons", group: str = "category", price: str = "price", base: bool = False) -> DataFrame:
    """group, period, link (the formula's ratio), matched: every period of every group but the first has a row."""
    found = matched_pairs(panel, group, price, base).groupBy(group, "period").agg(formula(name).alias("link"), F.count("*").alias("matched"))
    return period_links(panel, group, base).select(group, "period", "rank").join(found, [group, "period"], "left")


def chained_index(panel: DataFrame, name: str = "jevons", group: str = "category", price: str = "price", least: int = 2, base_value: float = 100.0) -> DataFrame:
    """group, period, index, matched: links of at least `least` items are compounded, others hold the level."""
    step = F.when((F.col("matched") >= least) & (F.col("link") > 0), F.ln("link")).otherwise(0.0)
    run = Window.partitionBy(group).orderBy("period")
    level = base_value * F.exp(F.sum(step).over(run))
    matched = F.when(F.col("rank") > 1, F.coalesce("matched", F.lit(0)))
    return links(panel, name, group, price).select(group, "period", level.alias("index"), matched.alias("matched"))


def fixed_base_index(panel: DataFrame, name: str = "jevons", group: str = "category", price: str = "price", least: int = 2, base_value: float = 100.0) -> DataFrame:
    """group, period, index, matched against the group's first period; null where too few items match."""
    level = F.when(F.col("rank") == 1, base_value).when(F.col("matched") >= least, base_value * F.col("link"))
    return links(panel, name, group, price, base=True).select(group, "period", level.alias("index"), F.coalesce("matched", F.lit(0)).alias("matched"))


def category_weights(panel: DataFrame, group: str = "category", weight: str = "expenditure") -> DataFrame:
    """group, weight: the items' mean weights over periods, summed; groups without a positive sum are left out."""
    items = panel.filter(F.col(group).isNotNull()).groupBy(group, "item_id").agg(F.avg(weight).alias("w"))
    return items.groupBy(group).agg(F.sum("w").alias("weight")).filter("weight > 0")


def geometric_all_items(index: DataFrame) -> DataFrame:
    """period, index: the geometric mean of the groups that have a level."""
    return index.filter("index > 0").groupBy("period").agg(F.exp(F.avg(F.ln("index"))).alias("index"))


def weighted_all_items(index: DataFrame, weights: DataFrame, group: str = "category") -> DataFrame:
    """period, index: sum of weight x index over the whole weight, so a missing group lowers the level; null if all miss."""
    joined = index.join(weights, group)
    whole = weights.agg(F.sum("weight").alias("whole"))
    out = joined.groupBy("period").agg(F.sum(F.col("weight") * F.col("index")).alias("s"))
    return out.join(F.broadcast(whole)).select("period", (F.col("s") / F.col("whole")).alias("index"))  # one row


def all_series(panel: DataFrame, name: str = "jevons", weighted: bool = False) -> DataFrame:
    """series, period, index: every category and `All items`."""
    index = chained_index(panel, name)
    total = weighted_all_items(index, category_weights(panel)) if weighted else geometric_all_items(index)
    return index.select(F.col("category").alias("series"), "period", "index").unionByName(total.select(F.lit("All items").alias("series"), "period", "index"))


def year_on_year(series: DataFrame, rows: int = 12) -> DataFrame:
    """Adds yoy: the change in percent from `rows` rows before."""
    before = F.lag("index", rows).over(Window.partitionBy("series").orderBy("period"))
    return series.withColumn("yoy", (F.col("index") / F.nullif(before, F.lit(0.0)) - 1) * 100)


def annualised(series: DataFrame) -> DataFrame:
    """series, rate: the mean yearly change in percent from first to last level, years of 365.25 days."""
    ends = series.filter("index is not null").groupBy("series").agg(F.min("period").alias("a"), F.max("period").alias("b"), F.min_by("index", "period").alias("x"), F.max_by("index", "period").alias("y"))
    years = F.datediff("b", "a") / 365.25
    return ends.select("series", F.when(years > 0, (F.pow(F.col("y") / F.col("x"), 1 / years) - 1) * 100).alias("rate"))


def rebase(series: DataFrame, reference: Column, base_value: float = 100.0) -> DataFrame:
    """Levels over the level at the reference period; null if that is missing or 0."""
    at = F.max(F.when(F.col("period") == reference, F.col("index"))).over(Window.partitionBy("series"))
    return series.withColumn("index", base_value * F.col("index") / F.nullif(at, F.lit(0.0)))


def splice(old: DataFrame, new: DataFrame, overlap: Column) -> DataFrame:
    """old before the overlap period, then new scaled to old's level there: by series."""
    factor = old.filter(F.col("period") == overlap).select("series", F.col("index").alias("o")).join(new.filter(F.col("period") == overlap).select("series", F.col("index").alias("n")), "series")
    scaled = new.filter(F.col("period") >= overlap).join(factor, "series").select("series", "period", (F.col("index") * F.col("o") / F.col("n")).alias("index"))
    return old.filter(F.col("period") < overlap).select("series", "period", "index").unionByName(scaled)


def chain_drift(panel: DataFrame, name: str = "jevons", threshold: float = 1.0) -> DataFrame:
    """category, chained, direct, drift_pp, drift_pct, flagged at the last period that both have."""
    c = chained_index(panel, name).select("category", "period", F.col("index").alias("chained"))
    d = fixed_base_index(panel, name).select("category", "period", F.col("index").alias("direct"))
    both = c.join(d, ["category", "period"]).filter("chained is not null and direct is not null")
    last = both.groupBy("category").agg(F.max_by("chained", "period").alias("chained"), F.max_by("direct", "period").alias("direct"))
    gap = F.col("chained") - F.col("direct")
    return last.select("category", "chained", "direct", gap.alias("drift_pp"), (gap / F.col("direct") * 100).alias("drift_pct"), (F.abs(gap) > threshold).alias("flagged"))


def bilateral(panel: DataFrame, name: str, group: str = "category") -> DataFrame:
    """group, period, value, n_items: a weighted formula of each period against the group's first.

    Reference quantities qb and shares sb are those of the group's second period.
    """
    second = period_links(panel, group).filter("rank = 2").select(group, F.col("period").alias("second"))
    ref = panel.join(second, [group]).filter(F.col("period") == F.col("second")).select(group, "item_id", F.col("quantity").alias("qb"), F.col("expenditure").alias("sb"))
    pairs = matched_pairs(panel, group, base=True)
    if name in ("lowe", "young", "price_updating_effect"):
        pairs = pairs.join(ref, [group, "item_id"])
    from basketry.functions.formulas import BILATERAL

    return pairs.groupBy(group, "period").agg(F.expr(BILATERAL[name]).alias("value"), F.count("*").alias("n_items"))
