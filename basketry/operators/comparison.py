"""Multilateral indices beside each other: fixed-base extension, seasonal forms, one for each group, drift, comparison."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.operators import index, multilateral
from basketry.sources.staging import staged


def matched_share(panel: DataFrame, by: str = "category") -> DataFrame:
    """by, items, always, share: the share of expenditure in items that are sold in every period of their group."""
    p = staged(multilateral.unit_value_panel(panel, by), "units")
    items = p.groupBy(by, "item_id").agg(F.count("*").alias("n"), F.sum("expenditure").alias("e"))
    alike = items.groupBy(by, "n").agg(F.count("*").alias("items"), F.sum("e").alias("e"))  # before the join: groups are few and large
    whole = p.groupBy(by).agg(F.count_distinct("period").alias("periods"))
    every = F.col("n") == F.col("periods")
    out = alike.join(whole, by).groupBy(by).agg(F.sum("items").alias("items"), F.coalesce(F.sum(F.when(every, F.col("items"))), F.lit(0)).alias("always"), F.coalesce(F.sum(F.when(every, F.col("e"))), F.lit(0.0)).alias("a"), F.sum("e").alias("e"))
    return out.select(by, "items", "always", F.when(F.col("e") > 0, F.col("a") / F.col("e")).alias("share"))


# --- extension from fixed bases ---


def anchors(periods: Sequence[date], month: int, window: int) -> list[int]:
    """The positions at which a window starts: the first, each in that month, and wherever the window would be full."""
    out = [0]
    for k in range(1, len(periods)):
        if periods[k].month == month or k - out[-1] >= window - 1:
            out.append(k)
    return out


def extend_fixed_base(panel: DataFrame, splice: str = "fbew", *, block: str = "fisher", window: int = 25, month: int = 12, base_value: float = 100.0) -> DataFrame:
    """period, anchor, index, spread: GEKS over windows from an anchor to the period, linked at the anchor or before.

    fbew takes the level against the anchor, fbmw the movement from the period before. The spread is what linking at
    the other periods of the window could have changed. A window that does not compare leaves null, and so do those
    linked to it. All windows are one job; the driver sees the distinct periods only.
    """
    spark = panel.sparkSession
    periods = sorted(r["period"] for r in panel.select("period").distinct().collect())
    starts = anchors(periods, month, window)
    of = [max((a for a in starts if a < k), default=0) for k in range(len(periods))]
    schema = "window int, period date, current date, anchor date, before date, starts boolean"
    rows = [(k, periods[j], periods[k], periods[of[k]], periods[max(k - 1, 0)], k in starts) for k in range(len(periods)) for j in range(of[k], k + 1)]
    table = spark.createDataFrame(rows, schema)
    levels = multilateral.geks(panel, block, windows=table.select("window", "period"))
    at = table.join(levels.withColumnRenamed("index", "level"), ["window", "period"], "left")
    link = F.col("anchor") if splice == "fbew" else F.col("before")

    def when(place) -> F.Column:
        return F.max(F.when(F.col("period") == place, F.col("level")))

    moves = at.groupBy("current", "anchor", "starts").agg(F.ln(when(F.col("current")) / when(link)).alias("move"))
    run = Window.orderBy("current")  # one row a period
    if splice == "fbew":
        held = moves.filter("starts").select(F.col("current").alias("anchor"), F.sum("move").over(run).alias("held"), F.sum(F.col("move").isNull().cast("int")).over(run).alias("broken"))
        out = moves.join(held, "anchor", "left").select("current", "anchor", F.when(F.col("broken") == 0, F.col("held") + F.col("move")).alias("log"))
    else:
        out = moves.select("current", "anchor", F.when(F.sum(F.col("move").isNull().cast("int")).over(run) == 0, F.sum("move").over(run)).alias("log"))
    found = out.select(F.col("current").alias("period"), "anchor", (base_value * F.exp("log")).alias("index"))
    new = at.filter("period = current").select("window", F.col("level").alias("new"))
    other = at.filter("period < current").join(found.select("period", F.col("index").alias("old")), "period").join(new, "window")
    spread = other.groupBy(F.col("current").alias("period")).agg((F.max(F.col("old") * F.col("new") / F.col("level")) - F.min(F.col("old") * F.col("new") / F.col("level"))).alias("spread"))
    return found.join(spread, "period", "left").select("period", "anchor", "index", F.when(F.col("index").isNotNull(), F.coalesce("spread", F.lit(0.0))).alias("spread"))


# --- seasonal forms ---


def seasonal(panel: DataFrame, block: str = "fisher", per_year: int = 12, base_value: float = 100.0) -> DataFrame:
    """period, season, level, year_over_year, rolling_year: each calendar month (per_year 12) or quarter (4) on its own.

    The level is the season's own GEKS over the years, year_over_year its ratio to the year before, and rolling_year the
    compounded geometric mean of the last per_year of these. Seasons of one year have no rows, `skipped_seasons` tells.
    """
    levels = multilateral.geks(_in_seasons(panel, per_year), block, by="season", base_value=base_value)
    many = Window.partitionBy("season")
    s = levels.withColumn("_years", F.count("*").over(many)).filter("_years > 1")
    before = F.lag("index").over(many.orderBy("period"))
    s = s.select("period", "season", F.col("index").alias("level"), F.when(before > 0, base_value * F.col("index") / before).alias("year_over_year"))
    w = Window.orderBy("period")  # one row a period
    known = s.filter("year_over_year > 0").select("period", F.ln(F.col("year_over_year") / base_value).alias("log"))
    last = w.rowsBetween(1 - per_year, 0)
    mean = known.select("period", F.when(F.count("log").over(last) == per_year, F.avg("log").over(last)).alias("mean"))
    rolled = mean.filter("mean is not null").select("period", (base_value * F.exp(F.sum("mean").over(w))).alias("rolling_year"))
    return s.join(rolled, "period", "left")


def _in_seasons(panel: DataFrame, per_year: int) -> DataFrame:
    parts = {12: F.month("period"), 4: F.quarter("period")}
    if per_year not in parts:
        raise ValueError("a year has 12 or 4 seasons here")
    return panel.withColumn("season", parts[per_year])


def skipped_seasons(panel: DataFrame, block: str = "fisher", per_year: int = 12) -> DataFrame:
    """season, reason: seasons of a single year, and those in which no period compares with all the others."""
    p = _in_seasons(panel, per_year)
    found = multilateral.geks(p, block, by="season").select("season").distinct()
    years = p.groupBy("season").agg(F.count_distinct("period").alias("years"))
    reason = F.when(F.col("years") < 2, F.lit("there is one year of it only")).otherwise("no period compares with all others")
    return years.filter("years < 2").unionByName(years.filter("years > 1").join(found, "season", "left_anti")).select("season", reason.alias("reason"))


# --- groups, drift, comparison ---


def by_group(panel: DataFrame, block: str = "fisher", group: str = "category") -> DataFrame:
    """series, period, index: GEKS of every group, and `All items` by the groups' weights; groups without a bridge have no rows.

    The weights are those of the groups that have an index, so a group that is left out does not lower the level.
    """
    own = multilateral.geks(panel, block, by=group)
    weights = index.category_weights(panel, group).join(own.select(group).distinct(), group, "left_semi")
    total = index.weighted_all_items(own, weights, group)
    return own.select(F.col(group).alias("series"), "period", "index").unionByName(total.select(F.lit("All items").alias("series"), "period", "index"))


def skipped_groups(panel: DataFrame, block: str = "fisher", group: str = "category") -> DataFrame:
    """group, periods: groups in which no period compares with all others."""
    found = multilateral.geks(panel, block, by=group).select(group).distinct()
    return panel.groupBy(group).agg(F.count_distinct("period").alias("periods")).join(found, group, "left_anti")


def drift(panel: DataFrame, levels: DataFrame, formula: str = "tornqvist", threshold: float = 1.0) -> DataFrame:
    """period, chained, multilateral, drift, beyond: the chained bilateral index against levels (period, index).

    The drift is in points of the base value; a multilateral index has none, so what differs was made by the links.
    """
    pooled = panel.withColumn("_all", F.lit("all"))
    chained = index.chained_index(pooled, formula, "_all").select("period", F.col("index").alias("chained"))
    j = chained.join(levels.select("period", F.col("index").alias("multilateral")), "period").filter("chained is not null and multilateral is not null")
    gap = F.col("chained") - F.col("multilateral")
    return j.select("period", "chained", "multilateral", gap.alias("drift"), (F.abs(gap) > threshold).alias("beyond"))


def compare(indices: Mapping[str, DataFrame], per_year: int = 12, base_value: float = 100.0) -> DataFrame:
    """method, periods, last, final_level, annualised, reason: where each index (period, index) ends, in one table.

    A method without a level at its end is kept, with its reason. annualised is percent a year over the steps covered.
    """
    out = None
    for name, df in indices.items():
        ends = df.agg(F.count("*").alias("periods"), F.max("period").alias("last"), F.max_by("index", "period").alias("final_level"), F.max_by("index", F.when(F.col("index").isNotNull(), -F.unix_date("period"))).alias("first_level"))
        out = ends.withColumn("method", F.lit(name)) if out is None else out.unionByName(ends.withColumn("method", F.lit(name)))
    rate = F.when(F.col("periods") > 1, (F.pow(F.col("final_level") / F.col("first_level"), F.lit(per_year) / (F.col("periods") - 1)) - 1) * 100)
    reason = F.when(F.col("periods") == 0, "no period compares with all others").when(F.col("final_level").isNull(), "the last window does not compare")
    return out.select("method", "periods", "last", "final_level", rate.alias("annualised"), reason.alias("reason"))


def spread(table: DataFrame) -> DataFrame:
    """computed, level_min, level_max, level_spread, rate_spread of the methods of `compare` that have a level."""
    t = table.filter("final_level is not null")
    return t.agg(F.count("*").alias("computed"), F.min("final_level").alias("level_min"), F.max("final_level").alias("level_max"), (F.max("final_level") - F.min("final_level")).alias("level_spread"), (F.max("annualised") - F.min("annualised")).alias("rate_spread"))
