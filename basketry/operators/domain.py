"""Trade, spatial, property, rent, deflation, construction, escalation, season, sampling and publication measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.formulas import BILATERAL
from basketry.operators.linalg import fixed_point_levels, two_way_dummies
from basketry.sources.staging import staged

# --- trade ---


def trade_price_index(flows: DataFrame, flow: str, name: str = "fisher") -> DataFrame:
    """period, index, matched: each period's products against the first period's."""
    f = flows.filter(F.col("flow") == flow).groupBy("period", "product").agg(F.sum("value").alias("value"), F.sum("quantity").alias("quantity")).filter("quantity > 0")
    f = f.withColumn("price", F.col("value") / F.col("quantity"))
    first = f.agg(F.min("period").alias("base"))
    base = f.join(F.broadcast(first), F.col("period") == F.col("base")).select("product", F.col("price").alias("p0"), F.col("quantity").alias("q0"))  # one row
    now = f.select("period", "product", F.col("price").alias("pt"), F.col("quantity").alias("qt"))
    return now.join(base, "product").groupBy("period").agg((100 * F.expr(BILATERAL[name])).alias("index"), F.count("*").alias("matched"))


def unit_value_index(flows: DataFrame, flow: str) -> DataFrame:
    """period, index: value over quantity of all products, first period = 100."""
    u = flows.filter(F.col("flow") == flow).groupBy("period").agg((F.sum("value") / F.sum("quantity")).alias("u"))
    return u.select("period", (100 * F.col("u") / F.first("u").over(Window.orderBy("period"))).alias("index"))


def unit_value_bias(flows: DataFrame, flow: str) -> DataFrame:
    """period, unit_value, price, gap and the composition effect (ratio of the two, percent)."""
    u = unit_value_index(flows, flow).withColumnRenamed("index", "unit_value")
    p = trade_price_index(flows, flow).select("period", F.col("index").alias("price"))
    j = u.join(p, "period")
    return j.select("period", "unit_value", "price", (F.col("unit_value") - F.col("price")).alias("gap"), ((F.col("unit_value") / F.col("price") - 1) * 100).alias("composition"))


def terms_of_trade(flows: DataFrame) -> DataFrame:
    """period, index: export over import prices."""
    e = trade_price_index(flows, "export").select("period", F.col("index").alias("e"))
    i = trade_price_index(flows, "import").select("period", F.col("index").alias("i"))
    return e.join(i, "period").select("period", (F.col("e") / F.col("i") * 100).alias("index"))


# --- space ---


def overlap(prices: DataFrame) -> DataFrame:
    """r1, r2, n: products priced in both regions."""
    p = prices.filter("price > 0").select("region", "product").distinct()
    return p.select(F.col("region").alias("r1"), "product").join(p.select(F.col("region").alias("r2"), "product"), "product").groupBy("r1", "r2").agg(F.count("*").alias("n"))


def _parities(prices: DataFrame, base: str, regions: list, levels: np.ndarray) -> DataFrame:
    levels = levels / levels[regions.index(base)]
    return prices.sparkSession.createDataFrame([(r, float(x)) for r, x in zip(regions, levels, strict=True)], "region string, parity double")


def country_product_dummy(prices: DataFrame, base: str, weighted: bool = False) -> DataFrame:
    """region, parity: regression of log prices on region and product dummies; weights are expenditure shares."""
    w = F.lit(1.0)
    if weighted:
        prices = staged(prices, "prices")
        prices = prices.join(F.broadcast(prices.groupBy("region").agg(F.sum("expenditure").alias("whole"))), "region")  # one row a region
        w = F.col("expenditure") / F.col("whole")
    cells = prices.filter("price > 0 and region is not null").select(F.col("region").alias("t"), F.col("product").alias("i"), F.ln("price").alias("y"), w.alias("w"))
    regions, effects = two_way_dummies(cells)
    return _parities(prices, base, regions, np.exp(effects))


def spatial_geary_khamis(prices: DataFrame, base: str) -> DataFrame:
    """region, parity: the fixed point of average prices and parities."""
    cells = prices.filter("price > 0 and quantity > 0").select(F.col("region").alias("t"), F.col("product").alias("i"), F.col("price").alias("p"), F.col("quantity").alias("q"))
    regions, levels = fixed_point_levels(cells)
    return _parities(prices, base, regions, levels)


# --- property and rents ---


def stratified_median(sales: DataFrame) -> DataFrame:
    """period, index: strata medians against the first period's, weighted by its value, over the strata present."""
    m = sales.filter("price > 0").groupBy("stratum", "period").agg(F.percentile("price", 0.5).alias("m"), F.sum("price").alias("value"))
    return _fixed_mix(m)


def mix_adjusted_mean(sales: DataFrame, bands: int = 3) -> DataFrame:
    """period, index: means of strata by size band, the bands being quantiles of all sales, against the first period's."""
    edges = sales.agg(F.percentile("floor_area", [i / bands for i in range(1, bands)]).alias("edges"))
    banded = sales.filter("price > 0").join(F.broadcast(edges))  # one row
    band = F.size(F.filter("edges", lambda e: e < F.col("floor_area")))
    m = banded.withColumn("stratum", F.concat_ws("|", "stratum", band.cast("string"))).groupBy("stratum", "period").agg(F.avg("price").alias("m"), F.sum("price").alias("value"))
    return _fixed_mix(m)


def _fixed_mix(cells: DataFrame) -> DataFrame:
    first = cells.agg(F.min("period").alias("first"))
    base = cells.join(F.broadcast(first), F.col("period") == F.col("first")).select("stratum", F.col("m").alias("m0"), F.col("value").alias("w"))  # one row
    j = cells.join(base, "stratum")
    return j.groupBy("period").agg((100 * F.sum(F.col("w") * F.col("m") / F.col("m0")) / F.sum("w")).alias("index"))


def appraisal_ratio(sales: DataFrame) -> DataFrame:
    """period, index: sum of prices over sum of appraisals, first period = 100."""
    r = sales.filter("price > 0 and appraisal > 0").groupBy("period").agg((F.sum("price") / F.sum("appraisal")).alias("r"))
    return r.select("period", (100 * F.col("r") / F.first("r").over(Window.orderBy("period"))).alias("index"))


def repeat_pairs(sales: DataFrame) -> DataFrame:
    """property_id, first, second, months, log_ratio of consecutive sales in different periods."""
    w = Window.partitionBy("property_id").orderBy("period", "price")
    p = sales.filter("price > 0").select("property_id", F.lag("period").over(w).alias("first"), F.col("period").alias("second"), F.ln(F.col("price") / F.lag("price").over(w)).alias("log_ratio"))
    return p.filter("first < second").withColumn("months", F.months_between("second", "first").cast("int"))


def repeat_sales(sales: DataFrame, weighted: bool = False) -> DataFrame:
    """period, index by repeat-sales regression; weighted takes variances that rise with the gap between sales.

    Pairs are counted and summed by (first, second) in Spark; the regression has one unknown for each period.
    """
    pairs = repeat_pairs(sales)
    sums = pairs.groupBy("first", "second", "months").agg(F.count("*").alias("n"), F.sum("log_ratio").alias("s"), F.sum(F.col("log_ratio") ** 2).alias("ss")).collect()
    periods = sorted({r["first"] for r in sums} | {r["second"] for r in sums})
    at = {p: k for k, p in enumerate(periods)}

    def solve(weights: dict) -> np.ndarray:
        a, b = np.zeros((len(periods), len(periods))), np.zeros(len(periods))
        for r in sums:
            i, j, w = at[r["first"]], at[r["second"]], weights.get(r["months"], 1.0)
            a[i, i] += w * r["n"]
            a[j, j] += w * r["n"]
            a[i, j] -= w * r["n"]
            a[j, i] -= w * r["n"]
            b[i] -= w * r["s"]
            b[j] += w * r["s"]
        out = np.zeros(len(periods))
        if len(periods) > 1:
            out[1:] = np.linalg.lstsq(a[1:, 1:], b[1:], rcond=None)[0]
        return out

    beta = solve({})
    if weighted and sums:
        # Squared residuals on the gap: only their sums by (first, second) enter.
        gap = np.array([r["months"] for r in sums], float)
        n = np.array([r["n"] for r in sums], float)
        fit = np.array([beta[at[r["second"]]] - beta[at[r["first"]]] for r in sums])
        e2 = np.array([r["ss"] - 2 * f * r["s"] + r["n"] * f * f for r, f in zip(sums, fit, strict=True)])
        g1, g0 = np.polyfit(gap, e2 / n, 1, w=np.sqrt(n)) if len(set(gap)) > 1 else (0.0, float(e2.sum() / n.sum()))
        floor = max(1e-12, 0.01 * float(e2.sum() / n.sum()))
        beta = solve({m: 1 / max(floor, g0 + g1 * m) for m in set(gap.astype(int).tolist())})
    return sales.sparkSession.createDataFrame([(p, float(100 * np.exp(x))) for p, x in zip(periods, beta, strict=True)], "period date, index double")


def sale_counts(sales: DataFrame) -> DataFrame:
    """stratum, period, n, with `total` for all strata."""
    return sales.rollup("period", "stratum").agg(F.count("*").alias("n")).filter("period is not null").select("period", F.coalesce("stratum", F.lit("total")).alias("stratum"), "n")


def rent_index(rents: DataFrame) -> DataFrame:
    """stratum, period, index: chained geometric means of rents of the same dwellings in consecutive periods of the table."""
    periods = rents.select("period").distinct().withColumn("before", F.lag("period").over(Window.orderBy("period")))
    now = rents.filter("rent > 0").join(F.broadcast(periods), "period").select("stratum", "period", "before", "dwelling_id", "rent")  # one row a period
    then = rents.filter("rent > 0").select(F.col("stratum"), F.col("period").alias("before"), "dwelling_id", F.col("rent").alias("r0"))
    links = now.join(then, ["stratum", "before", "dwelling_id"]).groupBy("stratum", "period").agg(F.avg(F.ln(F.col("rent") / F.col("r0"))).alias("link"), F.count("*").alias("matched"))
    grid = rents.select("stratum", "period").distinct().join(links, ["stratum", "period"], "left")
    w = Window.partitionBy("stratum").orderBy("period")
    grid = grid.withColumn("rn", F.row_number().over(w))
    broken = F.sum(F.when((F.col("rn") > 1) & F.col("link").isNull(), 1).otherwise(0)).over(w)
    level = 100 * F.exp(F.sum(F.coalesce("link", F.lit(0.0))).over(w))
    return grid.select("stratum", "period", F.when(broken == 0, level).alias("index"), "matched")


# --- deflation ---


def deflate(nominal: DataFrame, deflator: DataFrame, reference: str) -> DataFrame:
    """period, nominal, deflator, real: nominal over the deflator relative to the reference year's mean."""
    ref = deflator.filter(F.year("period") == int(reference)).agg(F.avg("index").alias("ref"))
    j = nominal.join(deflator.select("period", F.col("index").alias("deflator")), "period").join(F.broadcast(ref))  # one row
    return j.select("period", F.col("value").alias("nominal"), "deflator", (F.col("value") / (F.col("deflator") / F.col("ref"))).alias("real"))


def to_quarters(series: DataFrame, how: str = "avg") -> DataFrame:
    """period (quarter), value of months; quarters without all three months are dropped."""
    take = {"avg": F.avg("value"), "sum": F.sum("value"), "last": F.max_by("value", "period")}[how]
    q = series.groupBy(F.trunc("period", "QUARTER").alias("quarter")).agg(take.alias("value"), F.count("value").alias("n"))
    return q.filter("n = 3").select(F.col("quarter").alias("period"), "value")


def real_growth(real: DataFrame, horizon: int = 12) -> DataFrame:
    """period, exact and approximate real growth in percent over `horizon` rows."""
    w = Window.orderBy("period")

    def growth(c: str) -> Column:
        return F.col(c) / F.lag(c, horizon).over(w) - 1

    g = real.select("period", growth("nominal").alias("n"), growth("deflator").alias("d"))
    return g.select("period", (((1 + F.col("n")) / (1 + F.col("d")) - 1) * 100).alias("exact"), ((F.col("n") - F.col("d")) * 100).alias("approximate")).filter("exact is not null")


# --- construction and escalation ---


def input_cost_index(inputs: DataFrame, shares: dict[str, float]) -> DataFrame:
    """period, index: share-weighted inputs (input, period, index), first period = 100; null if an input is missing."""
    table = F.create_map(*[F.lit(x) for kv in shares.items() for x in kv])
    first = F.first("index").over(Window.partitionBy("input").orderBy("period"))
    t = inputs.filter(F.col("input").isin(*shares)).select("period", (table[F.col("input")] * F.col("index") / first).alias("x"))
    return t.groupBy("period").agg(F.when(F.count("x") == len(shares), 100 * F.sum("x") / sum(shares.values())).alias("index"))


def escalate(index: DataFrame, base_payment: float, *, lag: int = 0, share: float = 1.0, dead_band: float = 0.0, trigger: float = 0.0, cap: float | None = None, collar: float | None = None) -> DataFrame:
    """period, movement, applied, payment of an escalation clause over an index (period, index), in percent.

    The movement is measured from the first reading, lag rows back. Movements within the dead band count as 0. Once
    the movement differs from the one last set by the trigger or more, it is set anew: a fold over the periods, done
    by aggregate() over the sorted array of readings.
    """
    w = Window.orderBy("period")
    reading = F.lag("index", lag).over(w) if lag else F.col("index")
    r = index.select("period", reading.alias("reading")).filter("reading is not null")
    base = F.first("reading").over(w)
    moved = r.select("period", ((F.col("reading") / base - 1) * 100).alias("movement"))
    m = F.when(F.abs("movement") <= dead_band, 0.0).otherwise(F.col("movement"))
    rows = moved.withColumn("banded", m).agg(F.array_sort(F.collect_list(F.struct("period", "movement", "banded"))).alias("rows"))
    start = F.struct(F.lit(0.0).alias("held"), F.array().cast("array<struct<period:date,movement:double,held:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        held = F.when(F.abs(x["banded"] - acc["held"]) >= trigger, x["banded"]).otherwise(acc["held"])
        return F.struct(held.alias("held"), F.array_append(acc["out"], F.struct(x["period"].alias("period"), x["movement"].alias("movement"), held.alias("held"))).alias("out"))

    applied = share * F.col("held")
    if cap is not None:
        applied = F.least(applied, F.lit(float(cap)))
    if collar is not None:
        applied = F.greatest(applied, F.lit(-float(collar)))
    out = rows.select(F.explode(F.aggregate("rows", start, step, lambda acc: acc["out"])).alias("x")).select("x.*")
    return out.select("period", "movement", applied.alias("applied"), (base_payment * (1 + applied / 100)).alias("payment"))


# --- season, sampling, publication ---


def seasonal_amplitude(series: DataFrame, window: int = 13, least: int = 6) -> DataFrame:
    """series, amplitude: range in percent of the months' mean log deviations from a centred mean."""
    w = Window.partitionBy("series").orderBy("period").rowsBetween(-(window // 2), (window - 1) // 2)
    log = F.ln("index")
    s = series.withColumn("dev", log - F.when(F.count("index").over(w) >= least, F.avg(log).over(w)))
    m = s.groupBy("series", F.month("period").alias("month")).agg(F.avg("dev").alias("f"))
    return m.groupBy("series").agg(((F.exp(F.max("f")) - F.exp(F.min("f"))) * 100).alias("amplitude"))


def strictly_seasonal(panel: DataFrame, share: float = 0.9) -> DataFrame:
    """item_id, months (in season), years: items priced in two years or more, but never in some month of the collection."""
    every = panel.select(F.month("period").alias("m")).distinct().agg(F.count("*").alias("all_months"))
    i = panel.filter("price > 0").groupBy("item_id").agg(F.count_distinct(F.month("period")).alias("months"), F.count_distinct(F.year("period")).alias("years"))
    return i.join(F.broadcast(every)).filter((F.col("years") >= 2) & (F.col("months") < F.col("all_months")) & (F.col("months") <= share * F.col("all_months"))).select("item_id", "months", "years")  # one row


def rothwell(panel: DataFrame, base_year: int) -> DataFrame:
    """period, index: base-year quantities at current over mean base-year prices, items of the base year only."""
    base = panel.filter((F.year("period") == base_year) & (F.col("price") > 0)).groupBy("item_id").agg(F.avg("price").alias("p0"), F.avg("quantity").alias("q0"))
    j = panel.filter("price > 0").join(base, "item_id")
    return j.groupBy("period").agg((100 * F.sum(F.col("q0") * F.col("price")) / F.sum(F.col("q0") * F.col("p0"))).alias("index"))


def churn(panel: DataFrame) -> DataFrame:
    """item_id, first, last, periods, entry_price, exit_price."""
    return panel.filter("price > 0").groupBy("item_id").agg(
        F.min("period").alias("first"), F.max("period").alias("last"), F.count("*").alias("periods"), F.min_by("price", "period").alias("entry_price"), F.max_by("price", "period").alias("exit_price")
    )


def matched_relatives(panel: DataFrame, start: str, end: str) -> DataFrame:
    """category, item_id, log_relative of items priced at both ends."""
    def at(day: str) -> Column:
        return F.max(F.when(F.col("period") == F.to_date(F.lit(day)), F.col("price")))

    r = panel.filter("price > 0").groupBy("category", "item_id").agg(at(start).alias("a"), at(end).alias("b"))
    return r.filter("a is not null and b is not null").select("category", "item_id", F.ln(F.col("b") / F.col("a")).alias("log_relative"))


def suppress(table: DataFrame, group: str, value: str, count: str, least: int = 3) -> DataFrame:
    """Adds suppressed (primary, secondary or null) and published: small cells and, where a group has just one, its least other value."""
    t = table.withColumn("_p", F.col(count) < least)
    t = t.withColumn("_k", F.count_if(F.col("_p")).over(Window.partitionBy(group)))
    rank = F.row_number().over(Window.partitionBy(group, "_p").orderBy(value, *[c for c in table.columns if c not in (value,)]))
    how = F.when(F.col("_p"), "primary").when((F.col("_k") == 1) & (rank == 1), "secondary")
    t = t.withColumn("suppressed", how)
    return t.withColumn("published", F.when(F.col("suppressed").isNull(), F.col(value))).drop("_p", "_k")


def revision_triangle(vintages: DataFrame) -> DataFrame:
    """period, vintage, value, revision: the change against the vintage before."""
    before = F.lag("value").over(Window.partitionBy("period").orderBy("vintage"))
    return vintages.select("period", "vintage", "value", (F.col("value") - before).alias("revision"))


def content_hash(df: DataFrame) -> DataFrame:
    """rows, hash: independent of the order of rows; a sum of row hashes, so nothing is gathered.

    A row's hash are the first 15 hexadecimal digits of the MD5 of its cells as text, in the order of column names.
    """
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(df.columns)]
    h = F.conv(F.substring(F.md5(F.concat_ws("\x1f", *cells)), 1, 15), 16, 10)
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(20,0)")).cast("string").alias("hash"))


def sanitised(df: DataFrame) -> DataFrame:
    """Text cells that a spreadsheet would run as formulae get an apostrophe in front."""
    return df.select(*[F.when(F.col(c).rlike(r"^[=+\-@\t]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes])
