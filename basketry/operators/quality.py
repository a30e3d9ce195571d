"""Missing codes, gaps, unit faults, outlier screens and imputation, as windows over long panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_item() -> WindowSpec:
    """An item's rows in time."""
    return Window.partitionBy("item_id").orderBy("period")


def recode_missing(panel: DataFrame, codes: Sequence[float] = (0.0,)) -> DataFrame:
    """Adds price_clean (null for a missing code) and flag (missing_code or null)."""
    missing = F.col("price").isin(*codes)
    return panel.withColumn("price_clean", F.when(~missing, F.col("price"))).withColumn("flag", F.when(missing, "missing_code"))


def local_reference(price: str, window: int = 13, least: int = 3) -> Column:
    """The centred rolling median of an item's rows, null with fewer than `least` prices."""
    w = by_item().rowsBetween(-(window // 2), (window - 1) // 2)
    return F.when(F.count(price).over(w) >= least, F.percentile(price, 0.5).over(w))


def repair_units(panel: DataFrame, low: float = 1.5, high: float = 2.5) -> DataFrame:
    """Finds prices a hundred times too high or low against their reference and repairs price_clean.

    Adds reference, log10_deviation; flag is x100 or div100. The reference is the local one, else the item's median.
    """
    p = recode_missing(panel)
    middle = F.percentile("price_clean", 0.5).over(Window.partitionBy("item_id"))
    p = p.withColumn("reference", F.coalesce(local_reference("price_clean"), middle))
    dev = F.when((F.col("price_clean") > 0) & (F.col("reference") > 0), F.log10(F.col("price_clean") / F.col("reference")))
    p = p.withColumn("log10_deviation", dev)
    d = F.col("log10_deviation")
    p = p.withColumn("flag", F.coalesce("flag", F.when(d.between(low, high), "x100").when(d.between(-high, -low), "div100")))
    clean = F.when(F.col("flag") == "x100", F.col("price_clean") / 100).when(F.col("flag") == "div100", F.col("price_clean") * 100).otherwise(F.col("price_clean"))
    return p.withColumn("price_clean", clean)


def residual_faults(panel: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Rows of a repaired panel that are still far from their reference, computed anew."""
    ref = F.coalesce(local_reference("price_clean"), F.percentile("price_clean", 0.5).over(Window.partitionBy("item_id")))
    p = panel.withColumn("reference", ref)
    return p.withColumn("deviation", F.log10(F.col("price_clean") / F.col("reference"))).filter(F.abs("deviation") > tolerance)


def classify_gaps(panel: DataFrame, share: float = 0.8, months: int = 8) -> DataFrame:
    """category, systemic (periods where `share` of items lack a price), kind: seasonal, collection or sporadic."""
    c = panel.groupBy("category", "period").agg(F.avg(F.when(F.col("price_clean").isNull(), 1.0).otherwise(0.0)).alias("missing"))
    years = c.groupBy("category").agg(F.count_distinct(F.year("period")).alias("years"))
    s = F.col("missing") >= share
    g = c.groupBy("category").agg(
        F.count_if(s).alias("systemic"), F.count_distinct(F.when(s, F.year("period"))).alias("hit_years"), F.count_distinct(F.when(s, F.month("period"))).alias("hit_months")
    )
    g = g.join(years, "category")
    seasonal = (F.col("systemic") > 0) & (F.col("hit_years") >= F.greatest(F.lit(2.0), 0.6 * F.col("years"))) & (F.col("hit_months") <= months)
    return g.select("category", "systemic", F.when(seasonal, "seasonal").when(F.col("systemic") > 0, "collection").otherwise("sporadic").alias("kind"))


def price_relatives(panel: DataFrame, price: str = "price") -> DataFrame:
    """period, category, item_id, price, before, ratio, log_ratio against the item's last priced row, at any distance."""
    p = panel.filter(F.col(price) > 0).select("period", "category", "item_id", F.col(price).alias("price"), F.lag(price).over(by_item()).alias("before"))
    p = p.filter("before is not null").withColumn("ratio", F.col("price") / F.col("before"))
    return p.withColumn("log_ratio", F.ln("ratio"))


def by_cell() -> WindowSpec:
    """The quotes of a category in a period."""
    return Window.partitionBy("period", "category")


def _quartiles(value: str) -> Column:
    return F.percentile(value, [0.25, 0.5, 0.75]).over(by_cell())


def tukey_fences(relatives: DataFrame, k: float = 1.5, deadband: float = 5.0, least: int = 5) -> DataFrame:
    """Log ratios outside the quartiles by k interquartile ranges, and further than deadband % from the median."""
    r = relatives.withColumn("q", _quartiles("log_ratio")).withColumn("n", F.count("*").over(by_cell()))
    q1, m, q3 = (F.col("q")[i] for i in range(3))
    spread = q3 - q1
    outside = (F.col("log_ratio") < q1 - k * spread) | (F.col("log_ratio") > q3 + k * spread)
    return r.filter((F.col("n") >= least) & (spread > 0) & outside & (F.abs(F.exp(F.col("log_ratio") - m) - 1) * 100 > deadband)).select("period", "category", "item_id", F.lit("tukey").alias("method"), F.col("ratio").alias("statistic"))


def quartile_screen(relatives: DataFrame, k: float = 2.5, deadband: float = 5.0, least: int = 5) -> DataFrame:
    """Ratios beyond k half-spreads from the median on their side; a side without spread is unbounded."""
    r = relatives.withColumn("q", _quartiles("ratio")).withColumn("n", F.count("*").over(by_cell()))
    q1, m, q3 = (F.col("q")[i] for i in range(3))
    low, high = m - k * (m - q1), m + k * (q3 - m)
    outside = ((m - q1 > 0) & (F.col("ratio") < low)) | ((q3 - m > 0) & (F.col("ratio") > high))
    return r.filter((F.col("n") >= least) & outside & (F.abs(F.col("ratio") / m - 1) * 100 > deadband)).select("period", "category", "item_id", F.lit("quartile").alias("method"), F.col("ratio").alias("statistic"))


def hidiroglou_berthelot(relatives: DataFrame, c: float = 4.0, u: float = 0.5, floor: float = 0.05, least: int = 5) -> DataFrame:
    """Size-weighted symmetric ratios outside c spreads of their median; a spread is floor x the median at least."""
    r = relatives.withColumn("m", F.percentile("ratio", 0.5).over(by_cell())).withColumn("n", F.count("*").over(by_cell()))
    s = F.when(F.col("ratio") < F.col("m"), 1 - F.col("m") / F.col("ratio")).otherwise(F.col("ratio") / F.col("m") - 1)
    r = r.withColumn("e", s * F.pow(F.greatest("price", "before"), F.lit(u))).withColumn("q", _quartiles("e"))
    q1, m, q3 = (F.col("q")[i] for i in range(3))
    least_spread = F.abs(floor * m)
    outside = (F.col("e") < m - c * F.greatest(m - q1, least_spread)) | (F.col("e") > m + c * F.greatest(q3 - m, least_spread))
    return r.filter((F.col("n") >= least) & outside).select("period", "category", "item_id", F.lit("hb").alias("method"), F.col("e").alias("statistic"))


def ratio_screen(relatives: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    return relatives.filter((F.col("ratio") < low) | (F.col("ratio") > high)).select("period", "category", "item_id", F.lit("ratio").alias("method"), F.col("ratio").alias("statistic"))


def review_queue(relatives: DataFrame) -> DataFrame:
    """period, category, item_id, methods (sorted, joined), n_methods: one row for each quote that any screen flags."""
    flags = tukey_fences(relatives).unionByName(quartile_screen(relatives)).unionByName(hidiroglou_berthelot(relatives)).unionByName(ratio_screen(relatives))
    return flags.groupBy("period", "category", "item_id").agg(F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"), F.count_distinct("method").alias("n_methods"))


def apply_decisions(panel: DataFrame, decisions: DataFrame, price: str = "price") -> DataFrame:
    """panel with price_reviewed: null where a decision (period, item_id, decision) rejects the quote; nothing is dropped."""
    out = panel.join(decisions, ["period", "item_id"], "left")
    return out.withColumn("price_reviewed", F.when(F.coalesce(F.col("decision") == "reject", F.lit(False)), None).otherwise(F.col(price)))


def carry_forward(panel: DataFrame, price: str = "price_clean") -> DataFrame:
    """Adds price_imputed and imputation: the item's last price."""
    last = F.last(price, ignorenulls=True).over(by_item().rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("price_imputed", last).withColumn("imputation", F.when(F.col(price).isNull() & last.isNotNull(), "carry_forward"))


def _movements(panel: DataFrame, price: str, cell: str, all_periods: bool) -> DataFrame:
    """cell, period, total (running sum of mean log changes of matched items), gaps (undefined links so far).

    Links join consecutive periods of the cell; all_periods keeps periods without any price, which break the chain.
    """
    rows = panel.filter(F.col(cell).isNotNull())
    periods = (rows if all_periods else rows.filter(F.col(price).isNotNull())).select(cell, "period").distinct()
    by_cell = Window.partitionBy(cell).orderBy("period")
    periods = periods.withColumn("before", F.lag("period").over(by_cell))
    priced = rows.filter(F.col(price) > 0)
    now = priced.select(cell, "period", "item_id", F.col(price).alias("pt")).join(F.broadcast(periods), [cell, "period"])  # a row a period and cell
    then = priced.select(cell, F.col("period").alias("before"), "item_id", F.col(price).alias("p0"))
    change = now.join(then, [cell, "before", "item_id"]).groupBy(cell, "period").agg(F.avg(F.ln(F.col("pt") / F.col("p0"))).alias("f"))
    grid = periods.join(change, [cell, "period"], "left")
    gaps = F.sum(F.when(F.col("before").isNotNull() & F.col("f").isNull(), 1).otherwise(0)).over(by_cell)
    return grid.select(cell, "period", F.sum(F.coalesce("f", F.lit(0.0))).over(by_cell).alias("total"), gaps.alias("gaps"))


def impute_by_movement(panel: DataFrame, method: str = "class_mean", price: str = "price_clean") -> DataFrame:
    """Adds price_imputed and imputation: an item's last price moved on by the mean change of its cell.

    class_mean moves by category and stops at a link that no item matches; targeted_mean moves by category and
    overall_mean by the whole collection, both over such links. A cascade of fills from period to period has the
    closed form last price x exp(difference of running sums), so no loop over periods is needed.
    """
    p = panel.withColumn("_cell", F.lit("all") if method == "overall_mean" else F.col("category"))
    moves = _movements(p, price, "_cell", method == "class_mean")
    p = p.join(F.broadcast(moves), ["_cell", "period"], "left")  # a row a period and cell
    seen = by_item().rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(price).isNotNull(), F.struct(F.col(price).alias("p"), "total", "gaps")), ignorenulls=True).over(seen)
    p = p.withColumn("_last", last)
    fill = F.col("_last.p") * F.exp(F.col("total") - F.col("_last.total"))
    if method == "class_mean":
        fill = F.when(F.col("gaps") == F.col("_last.gaps"), fill)
    done = F.when(F.col(price).isNull() & fill.isNotNull(), method)
    return p.withColumn("price_imputed", F.coalesce(F.col(price), fill)).withColumn("imputation", done).drop("_cell", "_last", "total", "gaps")


def response_rates(panel: DataFrame, by: str = "category") -> DataFrame:
    """by, period, expected, observed, imputed, missing, response_rate, imputed_share of an imputed panel."""
    r = panel.groupBy(by, "period").agg(
        F.count("*").alias("expected"), F.count("price_clean").alias("observed"), F.count("imputation").alias("imputed"), F.count_if(F.col("price_imputed").isNull()).alias("missing")
    )
    return r.withColumn("response_rate", F.col("observed") / F.col("expected")).withColumn("imputed_share", F.col("imputed") / F.nullif(F.col("observed") + F.col("imputed"), F.lit(0)))


def completeness(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, null_share, severity."""
    shares = panel.agg(*[F.avg(F.when(F.col(c).isNull(), 1.0).otherwise(0.0)).alias(c) for c in columns])
    long = shares.unpivot([], list(columns), "column", "null_share")
    return long.withColumn("severity", F.when(F.col("null_share") > 0.5, "critical").when(F.col("null_share") > 0, "high").otherwise("ok"))


def structure_checks(panel: DataFrame) -> DataFrame:
    """check, n: duplicate quotes, negative prices and quantities, thin category periods, items in several categories."""
    dup = panel.groupBy("period", "item_id").agg(F.count("*").alias("n")).filter("n > 1").agg(F.lit("duplicate_quotes").alias("check"), F.count("*").alias("n"))
    neg = panel.agg(F.lit("negative_price").alias("check"), F.count_if(F.col("price") < 0).alias("n"))
    negq = panel.agg(F.lit("negative_quantity").alias("check"), F.count_if(F.col("quantity") < 0).alias("n"))
    thin = panel.groupBy("category", "period").agg(F.count("*").alias("n")).filter("n < 2").agg(F.lit("thin_cells").alias("check"), F.count("*").alias("n"))
    many = panel.groupBy("item_id").agg(F.count_distinct("category").alias("n")).filter("n > 1").agg(F.lit("several_categories").alias("check"), F.count("*").alias("n"))
    return dup.unionByName(neg).unionByName(negq).unionByName(thin).unionByName(many)


def implausible_prices(panel: DataFrame, factor: float = 1000.0) -> DataFrame:
    """Rows whose price is over `factor` times, or under 1 / factor of, their item's median positive price."""
    m = panel.filter("price > 0").groupBy("item_id").agg(F.percentile("price", 0.5).alias("median"))
    j = panel.join(m, "item_id").filter("price > 0")
    return j.filter((F.col("price") > factor * F.col("median")) | (F.col("price") < F.col("median") / factor)).select("period", "item_id", "price", "median")


def expenditure_gaps(panel: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Rows whose expenditure differs from price x quantity by more than the tolerance."""
    return panel.filter(F.abs(F.col("expenditure") - F.col("price") * F.col("quantity")) > tolerance * F.abs(F.col("expenditure")))
