"""Rates, contributions and core measures of component indices.

Components are long tables (component, period, index), weights (component, weight). They have one row for each
component and period, so windows over them stay small whatever the panel's size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators.trees import aggregate_tree
from basketry.sources.staging import staged


def rates(series: DataFrame, per_year: int = 12) -> DataFrame:
    """series, period and percent changes: on the period and year before, three on three months, since the start."""
    w = Window.partitionBy("series").orderBy("period")
    three = w.rowsBetween(-2, 0)
    s = series.withColumn("m3", F.when(F.count("index").over(three) == 3, F.avg("index").over(three)))
    before, year, m33 = F.lag("index", 1).over(w), F.lag("index", per_year).over(w), F.lag("m3", 3).over(w)

    def pct(ratio):
        return (ratio - 1) * 100

    i, m3 = F.col("index"), F.col("m3")
    return s.select(
        "series",
        "period",
        pct(i / before).alias("pop"),
        pct(i / year).alias("yoy"),
        pct(F.pow(i / before, F.lit(float(per_year)))).alias("pop_annualised"),
        pct(m3 / m33).alias("three_month"),
        pct(F.pow(m3 / m33, F.lit(per_year / 3))).alias("three_month_annualised"),
        pct(i / F.first("index").over(w)).alias("cumulative"),
    )


def contributions(components: DataFrame, weights: DataFrame, start: str, end: str) -> DataFrame:
    """component, contribution: percentage points of the aggregate's change between two periods; they add up exactly."""
    c = components.join(weights, "component")
    ends = c.groupBy("component", "weight").agg(
        F.max(F.when(F.col("period") == F.to_date(F.lit(start)), F.col("index"))).alias("a"), F.max(F.when(F.col("period") == F.to_date(F.lit(end)), F.col("index"))).alias("b")
    )
    whole = ends.agg(F.sum(F.col("weight") * F.col("a")).alias("whole"))
    return ends.join(F.broadcast(whole)).select("component", (F.col("weight") * (F.col("b") - F.col("a")) / F.col("whole") * 100).alias("contribution"))  # one row


def contributions_over_time(components: DataFrame, weights: DataFrame, horizon: int = 1) -> DataFrame:
    """component, period, contribution to the aggregate's change over `horizon` rows."""
    before = F.lag("index", horizon).over(Window.partitionBy("component").orderBy("period"))
    c = components.join(weights, "component").withColumn("before", before).filter("before is not null")
    whole = F.sum(F.col("weight") * F.col("before")).over(Window.partitionBy("period"))
    return c.select("component", "period", (F.col("weight") * (F.col("index") - F.col("before")) / whole * 100).alias("contribution"))


def changes(components: DataFrame, weights: DataFrame, horizon: int = 1) -> DataFrame:
    """component, period, change (percent over `horizon` rows), effective (weight x level before), weight."""
    before = F.lag("index", horizon).over(Window.partitionBy("component").orderBy("period"))
    c = components.join(weights, "component").withColumn("before", before).filter("before is not null")
    return c.select("component", "period", ((F.col("index") / F.col("before") - 1) * 100).alias("change"), (F.col("weight") * F.col("before")).alias("effective"), "weight")


def exclusion(components: DataFrame, weights: DataFrame, exclude: Sequence[str]) -> DataFrame:
    """period, index, change of the weighted aggregate without the named components."""
    kept = weights.filter(~F.col("component").isin(*exclude))
    whole = kept.agg(F.sum("weight").alias("whole"))
    total = components.join(kept, "component").groupBy("period").agg(F.sum(F.col("weight") * F.col("index")).alias("s")).join(F.broadcast(whole))  # one row
    total = total.select("period", (F.col("s") / F.col("whole")).alias("index"))
    return total.withColumn("change", (F.col("index") / F.lag("index").over(Window.orderBy("period")) - 1) * 100)


def _ranked(components: DataFrame, weights: DataFrame, horizon: int) -> DataFrame:
    x = changes(components, weights, horizon)
    share = x.withColumn("share", F.col("effective") / F.sum("effective").over(Window.partitionBy("period")))
    return share.withColumn("upper", F.sum("share").over(Window.partitionBy("period").orderBy("change", "component")))


def trimmed_mean(components: DataFrame, weights: DataFrame, trim: float = 0.15, horizon: int = 1) -> DataFrame:
    """period, change: mean without the share `trim` of weight at either end; the weight at an edge counts in part."""
    kept = F.greatest(F.least("upper", F.lit(1 - trim)) - F.greatest(F.col("upper") - F.col("share"), F.lit(trim)), F.lit(0.0))
    k = _ranked(components, weights, horizon).withColumn("kept", kept)
    return k.groupBy("period").agg((F.sum(F.col("kept") * F.col("change")) / F.sum("kept")).alias("change"))


def weighted_median(components: DataFrame, weights: DataFrame, horizon: int = 1) -> DataFrame:
    """period, change: the first change where half the weight is reached, halfway to the next if it is reached exactly."""
    k = _ranked(components, weights, horizon).withColumn("next", F.lead("change").over(Window.partitionBy("period").orderBy("change", "upper")))
    m = k.filter("upper >= 0.5 - 1e-12").groupBy("period").agg(F.min_by(F.struct("change", "next", "upper"), "upper").alias("m"))
    exact = (F.abs(F.col("m.upper") - 0.5) <= 1e-12) & F.col("m.next").isNotNull()
    return m.select("period", F.when(exact, (F.col("m.change") + F.col("m.next")) / 2).otherwise(F.col("m.change")).alias("change"))


def variance_weighted(components: DataFrame, weights: DataFrame, window: int = 24, horizon: int = 1) -> DataFrame:
    """period, change: weights over the variance of the last `window` changes; a zero deviation takes the period's least positive one."""
    w = Window.partitionBy("component").orderBy("period").rowsBetween(-window, -1)
    x = changes(components, weights, horizon).withColumn("sd", F.when(F.count("change").over(w) == window, F.stddev_samp("change").over(w)))
    least = F.min(F.when(F.col("sd") > 0, F.col("sd"))).over(Window.partitionBy("period"))
    x = x.withColumn("least", least).filter("sd is not null").withColumn("vw", F.col("weight") / F.pow(F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.col("least")), F.lit(2.0)))
    return x.filter("vw is not null").groupBy("period").agg((F.sum(F.col("vw") * F.col("change")) / F.sum("vw")).alias("change"))


def base_effects(series: DataFrame, per_year: int = 12) -> DataFrame:
    """period, yoy, its change on the period before, and that change split: this period's movement and the base effect."""
    w = Window.orderBy("period")
    s = series.select("period", "index", F.lag("index").over(w).alias("l1"), F.lag("index", per_year).over(w).alias("l12"), F.lag("index", per_year + 1).over(w).alias("l13"))
    i, l1, l12, l13 = (F.col(c) for c in ("index", "l1", "l12", "l13"))
    return s.filter("l13 is not null").select(
        "period", ((i / l12 - 1) * 100).alias("yoy"), ((i / l12 - l1 / l13) * 100).alias("change"), ((i / l12 - l1 / l12) * 100).alias("this_period"), ((l1 / l12 - l1 / l13) * 100).alias("base_effect")
    )


def diffusion(components: DataFrame, weights: DataFrame, horizon: int = 1) -> DataFrame:
    """period and the shares of components rising, unchanged, falling, the diffusion index, the weight share rising."""
    c = F.col("change")

    def share(condition):
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    return changes(components, weights, horizon).groupBy("period").agg(
        share(c > 0).alias("rising"),
        share(c == 0).alias("unchanged"),
        share(c < 0).alias("falling"),
        (F.avg(F.when(c > 0, 1.0).when(c == 0, 0.5).otherwise(0.0)) * 100).alias("diffusion"),
        (F.sum(F.when(c > 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("rising_weight"),
    )


def dispersion(components: DataFrame, weights: DataFrame, horizon: int = 1) -> DataFrame:
    """period, weighted mean, population deviation and skewness of the changes."""
    w = Window.partitionBy("period")
    x = changes(components, weights, horizon).withColumn("mean", F.sum(F.col("weight") * F.col("change")).over(w) / F.sum("weight").over(w))
    gap = F.col("change") - F.col("mean")
    m = x.groupBy("period").agg(
        F.max("mean").alias("mean"),
        F.sqrt(F.sum(F.col("weight") * F.pow(gap, F.lit(2.0))) / F.sum("weight")).alias("sd"),
        (F.sum(F.col("weight") * F.pow(gap, F.lit(3.0))) / F.sum("weight")).alias("m3"),
    )
    return m.select("period", "mean", "sd", (F.col("m3") / F.nullif(F.pow("sd", F.lit(3.0)), F.lit(0.0))).alias("skewness"))


def change_frequency(panel: DataFrame, group: str = "category", price: str = "price") -> DataFrame:
    """group, comparisons (of consecutive months), changes, frequency, duration in months."""
    w = Window.partitionBy("item_id").orderBy("period")
    g = panel.filter(F.col(price) > 0).select(group, F.col(price).alias("p"), F.lag(price).over(w).alias("p1"), F.months_between("period", F.lag("period").over(w)).alias("gap"))
    f = g.filter("gap = 1").groupBy(group).agg(F.count("*").alias("comparisons"), F.count_if(F.abs(F.col("p") - F.col("p1")) > 1e-9).alias("changes"))
    share = F.col("changes") / F.col("comparisons")
    return f.select(group, "comparisons", "changes", share.alias("frequency"), F.when(share < 1, -1 / F.ln(1 - share)).alias("duration"))


def tree_levels(panel: DataFrame, tree: DataFrame) -> DataFrame:
    """code, period, index, weight of every node of a tree (code, parent) of any depth over items' fixed-base relatives."""
    base = panel.groupBy("item_id").agg(F.min_by("price", "period").alias("p0"), F.avg("expenditure").alias("weight"))
    levels = staged(panel.select("item_id", "period", "price").join(base, "item_id").select(F.col("item_id").alias("code"), "period", (100 * F.col("price") / F.col("p0")).alias("index"), "weight"), "leaves")
    weights = levels.groupBy("code").agg(F.max("weight").alias("weight"))
    return aggregate_tree(levels.drop("weight"), weights, tree).select("code", "period", "index", "weight")
