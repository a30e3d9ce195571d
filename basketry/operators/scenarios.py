"""Methodological sensitivity: the headline under alternative choices, all compiled in one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.formulas import formula
from basketry.operators.index import category_weights, matched_pairs, period_links
from basketry.operators.quality import carry_forward, impute_by_movement, response_rates
from basketry.sources.staging import staged

FORMULAS = ("jevons", "dutot", "carli", "laspeyres", "paasche", "fisher", "tornqvist", "walsh", "geometric_laspeyres", "geometric_paasche")
IMPUTATIONS = ("none", "carry_forward", "class_mean", "targeted_mean", "overall_mean")


def scenario_links(pairs: DataFrame, formulas: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, setting, link, matched: one aggregate over the pairs gives every formula, which then become rows."""
    wide = pairs.groupBy(*keys).agg(F.count("*").alias("matched"), *[formula(f).alias(f"f_{f}") for f in formulas])
    return wide.unpivot([*keys, "matched"], [f"f_{f}" for f in formulas], "setting", "link").withColumn("setting", F.expr("substring(setting, 3)"))


def scenario_levels(grid: DataFrame, links: DataFrame, keys: Sequence[str], least: int = 2) -> DataFrame:
    """keys, category, period, level: chained levels of each scenario; grid has category, period and rank.

    The scenario is a key of the join and of the window, so one chaining serves all.
    """
    every = links.select(*keys).distinct()
    cells = grid.join(F.broadcast(every))  # a row for each setting
    j = cells.join(links, [*keys, "category", "period"], "left")
    step = F.when((F.col("matched") >= least) & (F.col("link") > 0), F.ln("link")).otherwise(0.0)
    return j.select(*keys, "category", "period", (100 * F.exp(F.sum(step).over(Window.partitionBy(*keys, "category").orderBy("period")))).alias("level"))


def headline(levels: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, headline: the aggregate of the last period that has one."""
    return levels.groupBy(*keys, "period").agg(value.alias("v")).filter("v is not null").groupBy(*keys).agg(F.max_by("v", "period").alias("headline"))


def imputed_share(imputed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, share_final, share_run, missing_final: how much of the aggregate is filled or lacking, by categories' weights.

    final is the last period, run the mean over all periods; a category that has no quote in a period counts 0 there.
    """
    rates = response_rates(imputed.withColumn("_cell", F.struct(*keys, "category")), "_cell").select("_cell.*", "period", "imputed_share", (F.col("missing") / F.col("expected")).alias("gap"))
    w = category_weights(imputed.filter(F.col(keys[0]) == "none") if keys else imputed)
    whole = w.agg(F.sum("weight").alias("whole"))
    w = w.join(F.broadcast(whole)).select("category", (F.col("weight") / F.col("whole")).alias("w"))  # one row
    by = rates.join(w, "category").groupBy(*keys, "period").agg(F.sum(F.coalesce("imputed_share", F.lit(0.0)) * F.col("w")).alias("share"), F.sum(F.col("gap") * F.col("w")).alias("missing"))
    return by.groupBy(*keys).agg(F.max_by("share", "period").alias("share_final"), F.avg("share").alias("share_run"), F.max_by("missing", "period").alias("missing_final"))


def imputed_panels(panel: DataFrame, methods: Sequence[str] = IMPUTATIONS) -> DataFrame:
    """The panel once for each method, as rows: method, price_imputed and imputation added to its columns."""
    out = None
    for m in methods:
        p = panel.withColumn("price_imputed", F.col("price_clean")).withColumn("imputation", F.lit(None).cast("string")) if m == "none" else carry_forward(panel) if m == "carry_forward" else impute_by_movement(panel, m)
        p = p.select(F.lit(m).alias("method"), *panel.columns, "price_imputed", "imputation")
        out = p if out is None else out.unionByName(p)
    return out


def sensitivity(panel: DataFrame, formulas: Sequence[str] = FORMULAS, imputations: Sequence[str] = IMPUTATIONS) -> DataFrame:
    """dimension, setting, headline, difference, status, share_final, share_run: one choice varied at a time.

    panel has category, period, item_id, price_clean, quantity and expenditure. The run is a chained Jevons without
    imputation and a geometric mean of categories, the row of dimension `run`; headline is All items in the last
    period. Elementary formulae come from one aggregate over the pairs, ways of aggregation from the run's levels, and
    imputations from panels as rows with the method as a key of pairing, chaining and aggregation: no setting is a run
    of its own, and the panel is written once. A setting without a headline has status `not applicable`.
    """
    p = staged(panel, "panel")
    grid = staged(period_links(p).select("category", "period", "rank"), "grid")
    by_formula = scenario_links(matched_pairs(p, price="price_clean"), formulas, ["category", "period"])
    levels = staged(scenario_levels(grid, by_formula, ["setting"]), "levels")
    geometric = F.exp(F.avg(F.ln("level")))
    first = headline(levels, ["setting"], geometric).select(F.when(F.col("setting") == formulas[0], "run").otherwise("elementary formula").alias("dimension"), "setting", "headline")

    run = levels.filter(F.col("setting") == formulas[0]).join(category_weights(p), "category", "left")
    w = F.when(F.col("level").isNotNull(), F.col("weight"))
    ways = {"equal arithmetic mean": F.avg("level"), "equal harmonic mean": F.count("level") / F.sum(1 / F.col("level")), "weighted arithmetic mean": F.sum(w * F.col("level")) / F.sum("weight"), "weighted geometric mean": F.exp(F.sum(w * F.ln("level")) / F.sum(w))}
    wide = run.groupBy("period").agg(*[v.alias(k) for k, v in ways.items()]).agg(*[F.max_by(F.col(k), "period").alias(k) for k in ways])
    second = wide.unpivot([], list(ways), "setting", "headline").select(F.lit("aggregation formula").alias("dimension"), "setting", "headline")

    filled = staged(imputed_panels(p, imputations), "filled")
    rows = filled.withColumn("cell", F.struct("method", "category"))
    pairs = matched_pairs(rows, "cell", "price_imputed")
    links = pairs.groupBy("cell", "period").agg(formula(formulas[0]).alias("link"), F.count("*").alias("matched")).select(F.col("cell.method").alias("method"), F.col("cell.category").alias("category"), "period", "link", "matched")
    third = headline(scenario_levels(grid, links, ["method"]), ["method"], geometric).filter("method <> 'none'").select(F.lit("imputation method").alias("dimension"), F.col("method").alias("setting"), "headline")
    shares = staged(imputed_share(filled, ["method"]), "shares")

    base = first.filter("dimension = 'run'").select(F.col("headline").alias("base"))
    out = first.unionByName(second).unionByName(third).join(F.broadcast(base))  # one row
    mine = F.when(F.col("dimension") == "imputation method", F.col("setting")).otherwise("none")
    out = out.join(F.broadcast(shares.select("method", "share_final", "share_run")), mine == F.col("method"), "left")  # a row for each method
    status = F.when(F.col("headline").isNull() | F.isnan("headline"), "not applicable").otherwise("computed")
    return out.select("dimension", "setting", "headline", (F.col("headline") - F.col("base")).alias("difference"), status.alias("status"), "share_final", "share_run")


def sensitivity_range(table: DataFrame) -> DataFrame:
    """low_setting, low, high_setting, high, spread, alternatives over the computed settings: a lower bound of the range of methods."""
    t = table.filter("status = 'computed'")
    r = t.agg(F.min_by(F.struct("dimension", "setting", "headline"), F.struct("headline", "dimension", "setting")).alias("l"), F.max_by(F.struct("dimension", "setting", "headline"), F.struct("headline", "dimension", "setting")).alias("h"), F.count_if(F.col("dimension") != "run").alias("alternatives"))
    return r.select(F.col("l.setting").alias("low_setting"), F.col("l.headline").alias("low"), F.col("h.setting").alias("high_setting"), F.col("h.headline").alias("high"), (F.col("h.headline") - F.col("l.headline")).alias("spread"), "alternatives")
