"""Queries for deflation of many series, parities, owner-occupied housing and tender prices."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import deflation, domain, housing, index
from basketry.plans import domain as single
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels
from basketry.sources.staging import staged

YEAR = "1997"
BILL = {"PROMO": 12.0, "ECONOMY": 30.0, "SMALL": 5.0}
UPKEEP = {"depreciation": 1.5, "maintenance": 1.0, "tax": 0.5}


def _regional_lines(s, d):
    """region (key of the supplier's region), l_shipdate, l_extendedprice, l_quantity."""
    lines = panels.table(s, d, "lineitem").select("l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    places = panels.table(s, d, "supplier").select("s_suppkey", "s_nationkey").join(panels.table(s, d, "nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
    return lines.join(places, lines.l_suppkey == places.s_suppkey).select(F.col("n_regionkey").alias("region"), "l_shipdate", "l_extendedprice", "l_quantity")


def _regional(s, d):
    j = _regional_lines(s, d)
    return j.groupBy(F.concat(F.lit("region|"), F.col("region").cast("string")).alias("series"), "region", panels.month("l_shipdate").alias("period")).agg(F.sum("l_extendedprice").alias("value"))


def _nominal(s, d):
    """series, deflator, period, value: types and regions by month, rents by quarter, parts in the months they are sold."""
    dense, sparse, rents = panels.dense_panel(s, d), panels.sparse_panel(s, d), panels.dwelling_rents(s, d)
    out = dense.groupBy(F.concat(F.lit("type|"), "category").alias("series"), F.col("category").alias("deflator"), "period").agg(F.sum("expenditure").alias("value"))
    out = out.unionByName(rents.groupBy(F.concat(F.lit("rent|"), "stratum").alias("series"), F.lit("All items").alias("deflator"), "period").agg(F.avg("rent").alias("value")))
    out = out.unionByName(sparse.select(F.concat(F.lit("part|"), "item_id").alias("series"), F.col("category").alias("deflator"), "period", F.col("expenditure").alias("value")))
    by = F.when(F.col("region") == 1, "from July").when(F.col("region") == 2, "with a zero").when(F.col("region") == 3, "none").otherwise("All items")
    return staged(out.unionByName(_regional(s, d).select("series", by.alias("deflator"), "period", "value")), "nominal")


def _deflators(s, d):
    """deflator, period, index: types, All items, one that starts late and one with a zero."""
    found = index.all_series(panels.dense_panel(s, d)).withColumnRenamed("series", "deflator")
    total = found.filter("deflator = 'All items'")
    late = total.filter("period >= '1995-07-01'").withColumn("deflator", F.lit("from July"))
    zero = total.withColumn("deflator", F.lit("with a zero")).withColumn("index", F.when(F.col("period") == "1999-01-01", 0.0).otherwise(F.col("index")))
    return staged(found.unionByName(late).unionByName(zero), "deflators")


def _real(s, d, partial=True):
    return deflation.deflate(_nominal(s, d), _deflators(s, d), YEAR, allow_partial=partial)


def _parities(s, d):
    """series, period (year), ppp, rate: unit values and mean line values of a region over region 0's; none for region 3, nor for region 4 in 1999."""
    j = _regional_lines(s, d).groupBy("region", F.trunc(F.to_date("l_shipdate"), "YEAR").alias("period")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("u"), F.avg("l_extendedprice").alias("m"))
    j = staged(j, "parities")
    base = j.filter("region = 0").select("period", F.col("u").alias("u0"), F.col("m").alias("m0"))
    out = j.filter("region <> 3 and not (region = 4 and year(period) = 1999)").join(base, "period")
    return out.select(F.concat(F.lit("region|"), F.col("region").cast("string")).alias("series"), "period", (F.col("u") / F.col("u0")).alias("ppp"), (F.col("m") / F.col("m0")).alias("rate"))


def _homes(s, d, what="price"):
    return panels.dwelling_sales(s, d).groupBy(F.col("stratum").alias("series"), "period").agg(F.avg(what).alias("value"))


def _interest(s, d):
    """period (quarter), rate: a hundred times the mean discount."""
    return panels.table(s, d, "lineitem").groupBy(panels.quarter("l_shipdate").alias("period")).agg((100 * F.avg("l_discount")).alias("rate"))


def _outlays(s, d):
    orders = panels.table(s, d, "orders").select("o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    j = orders.join(panels.table(s, d, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy(F.col("c_mktsegment").alias("series"), panels.quarter("o_orderdate").alias("period"), F.col("o_orderpriority").alias("kind")).agg(F.sum("o_totalprice").alias("value"))


def _tenders(s, d):
    """series (brand), period, item (type), rate."""
    return panels.dense_panel(s, d).select(F.element_at(F.split("item_id", "\\|"), 1).alias("series"), "period", F.col("category").alias("item"), F.col("price").alias("rate"))


def _gap(s, d):
    costs = domain.input_cost_index(index.chained_index(panels.dense_panel(s, d)).select(F.col("category").alias("input"), "period", "index"), single.SHARES)
    prices = housing.output_price_index(_tenders(s, d).withColumn("series", F.lit("all")), BILL)
    return housing.output_over_input(costs.withColumn("series", F.lit("all")), prices)


def _rent_index(s, d):
    return domain.rent_index(panels.dwelling_rents(s, d)).select(F.col("stratum").alias("series"), "period", F.col("index").alias("value"))


def queries() -> dict:
    return {
        "df_freq": lambda s, d: deflation.frequencies(_nominal(s, d)),
        "df_align": lambda s, d: deflation.refusals(_nominal(s, d), _deflators(s, d), YEAR),
        "df_align_partial": lambda s, d: deflation.refusals(_nominal(s, d), _deflators(s, d), "1995", allow_partial=True),
        "df_ref": lambda s, d: rounded(deflation.reference_levels(_deflators(s, d), "1995")),
        "df_const": lambda s, d: rounded(_real(s, d), 4),
        "df_wage": lambda s, d: deflation.labels(_nominal(s, d), _deflators(s, d), YEAR, "real wage", allow_partial=True),
        "df_real_growth": lambda s, d: rounded(deflation.growth(_real(s, d, partial=False), 12)),
        "df_volume": lambda s, d: rounded(deflation.volume_index(_real(s, d), YEAR)),
        "df_spans": lambda s, d: rounded(deflation.to_frequency(_nominal(s, d), "Q", "sum"), 4),
        "df_spans_refused": lambda s, d: deflation.conversion_refusals(_nominal(s, d), "M"),
        "df_ppp": lambda s, d: rounded(deflation.convert(staged(_regional(s, d), "regional"), _parities(s, d), broadcast_annual=True), 4),
        "df_ppp_refused": lambda s, d: deflation.parity_refusals(staged(_regional(s, d), "regional"), _parities(s, d), broadcast_annual=True),
        "df_pli": lambda s, d: rounded(deflation.price_levels(_parities(s, d).drop("rate"), _parities(s, d).drop("ppp"))),
        "hs_requiv": lambda s, d: rounded(housing.rental_equivalence(_rent_index(s, d))),
        "hs_netacq": lambda s, d: rounded(housing.net_acquisitions(_homes(s, d), 0.3, _homes(s, d, "appraisal"))),
        "hs_usercost": lambda s, d: rounded(housing.user_cost(staged(_homes(s, d), "homes"), staged(_interest(s, d), "interest"), years=2, **UPKEEP)),
        "hs_payments": lambda s, d: rounded(housing.payments(staged(_outlays(s, d), "outlays")), 4),
        "cn_output": lambda s, d: rounded(housing.output_price_index(_tenders(s, d), BILL)),
        "cn_gap": lambda s, d: rounded(_gap(s, d)),
    }


def _freq(table: str, name: str = "series", value: str = "value") -> str:
    return f"""(SELECT {name}, count(*) AS periods, CAST(min(step) AS INT) AS shortest, CAST(max(step) AS INT) AS longest,
      CASE WHEN min(step) = max(step) THEN CASE min(step) WHEN 1 THEN 'M' WHEN 3 THEN 'Q' WHEN 12 THEN 'A' END END AS frequency
      FROM (SELECT {name}, year(period) * 12 + month(period) - lag(year(period) * 12 + month(period)) OVER (PARTITION BY {name} ORDER BY period) AS step FROM {table} WHERE {value} IS NOT NULL) GROUP BY 1)"""


WORD = "CASE {} WHEN 'M' THEN 'monthly' WHEN 'Q' THEN 'quarterly' WHEN 'A' THEN 'annual' END"


def _shape(t: str, what: str) -> str:
    return f"WHEN {t}.periods < 2 THEN '{what} has fewer than two periods' WHEN {t}.frequency IS NULL THEN '{what} has steps of ' || {t}.shortest || ' to ' || {t}.longest || ' months'"


def _level(year: str) -> str:
    return f"""(SELECT deflator, CASE WHEN found = expected THEN mean END AS level, found, expected FROM (SELECT deflator, avg(ix) FILTER (WHERE year(period) = {year}) AS mean, count(*) FILTER (WHERE year(period) = {year}) AS found FROM defl GROUP BY 1)
      JOIN (SELECT deflator, CAST(CASE frequency WHEN 'M' THEN 12 WHEN 'Q' THEN 4 WHEN 'A' THEN 1 END AS BIGINT) AS expected FROM {_freq('defl', 'deflator', 'ix')}) USING (deflator))"""


def _refused(year: str, partial: bool) -> str:
    gaps = "" if partial else "WHEN g.gaps > 0 THEN 'the deflator lacks ' || g.gaps || ' periods of the series'"
    return f"""(SELECT * FROM (SELECT n.series, CASE {_shape('o', 'the series')} WHEN lowest IS NULL THEN 'the deflator is unknown' {_shape('t', 'the deflator')}
      WHEN o.frequency <> t.frequency THEN 'the series is ' || {WORD.format('o.frequency')} || ', the deflator ' || {WORD.format('t.frequency')}
      WHEN lowest <= 0 THEN 'the deflator has values of 0 or less' {gaps}
      WHEN v.level IS NULL THEN 'of the reference {year} the deflator has ' || v.found || ' of ' || v.expected || ' periods' END AS reason
      FROM (SELECT DISTINCT series, deflator FROM nom) n JOIN {_freq('nom')} o ON o.series = n.series LEFT JOIN {_freq('defl', 'deflator', 'ix')} t ON t.deflator = n.deflator
      LEFT JOIN (SELECT deflator, min(ix) AS lowest FROM defl GROUP BY 1) l ON l.deflator = n.deflator LEFT JOIN {_level(year)} v ON v.deflator = n.deflator
      LEFT JOIN (SELECT series, count(*) AS gaps FROM nom WHERE NOT EXISTS (SELECT 1 FROM defl WHERE defl.deflator = nom.deflator AND defl.period = nom.period) GROUP BY 1) g ON g.series = n.series) WHERE reason IS NOT NULL)"""


def oracle_sql() -> dict[str, str]:
    month, quarter = sql.MONTH.format("l_shipdate"), sql.QUARTER.format("l_shipdate")
    lines = """lines AS (SELECT n_regionkey AS region, l_shipdate, l_extendedprice, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
      reg AS (SELECT 'region|' || region AS series, region, {0} AS period, sum(l_extendedprice) AS value FROM lines GROUP BY 1, 2, 3)""".format(month)
    both = f"""{sql.chained()}, {sql.SERIES}, {sql.RENTS}, {lines},
      nom AS (SELECT 'type|' || category AS series, category AS deflator, period, sum(expenditure) AS value FROM panel GROUP BY 1, 2, 3
        UNION ALL SELECT 'rent|' || stratum, 'All items', period, avg(rent) FROM rents GROUP BY 1, 2, 3
        UNION ALL SELECT 'part|' || l_partkey, p_type, {month}, sum(l_extendedprice) FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3
        UNION ALL SELECT series, CASE region WHEN 1 THEN 'from July' WHEN 2 THEN 'with a zero' WHEN 3 THEN 'none' ELSE 'All items' END, period, value FROM reg),
      defl AS (SELECT series AS deflator, period, level AS ix FROM series UNION ALL SELECT 'from July', period, level FROM series WHERE series = 'All items' AND period >= DATE '1995-07-01'
        UNION ALL SELECT 'with a zero', period, CASE WHEN period = DATE '1999-01-01' THEN 0 ELSE level END FROM series WHERE series = 'All items')"""

    def real(partial: bool) -> str:
        return f"""{both}, re AS (SELECT n.series, n.period, n.value AS nominal, 100 * ix / level AS deflator, n.value / (ix / level) AS re FROM nom n JOIN defl d ON d.deflator = n.deflator AND d.period = n.period
          JOIN {_level(YEAR)} v ON v.deflator = n.deflator WHERE n.series NOT IN (SELECT series FROM {_refused(YEAR, partial)}))"""

    par = f"""{lines}, u AS (SELECT region, CAST(date_trunc('year', l_shipdate) AS DATE) AS period, sum(l_extendedprice) / sum(l_quantity) AS u, avg(l_extendedprice) AS m FROM lines GROUP BY 1, 2),
      par AS (SELECT 'region|' || a.region AS series, a.period, a.u / b.u AS ppp, a.m / b.m AS rate FROM u a JOIN u b ON a.period = b.period AND b.region = 0 WHERE a.region <> 3 AND NOT (a.region = 4 AND year(a.period) = 1999))"""
    no_parity = f"""(SELECT * FROM (SELECT o.series, CASE {_shape('o', 'the series')} WHEN lowest IS NULL THEN 'there is no parity' {_shape('t', 'the parity')} WHEN o.frequency <> t.frequency AND t.frequency <> 'A' THEN 'unlike'
      WHEN g.gaps > 0 THEN g.gaps || ' periods have no parity' WHEN lowest <= 0 THEN 'the parity has values of 0 or less' END AS reason
      FROM {_freq('reg')} o LEFT JOIN {_freq('par', value='ppp')} t ON t.series = o.series LEFT JOIN (SELECT series, min(ppp) AS lowest FROM par GROUP BY 1) l ON l.series = o.series
      LEFT JOIN (SELECT series, count(*) AS gaps FROM reg WHERE NOT EXISTS (SELECT 1 FROM par p WHERE p.series = reg.series AND year(p.period) = year(reg.period)) GROUP BY 1) g ON g.series = o.series) WHERE reason IS NOT NULL)"""
    homes = f"{sql.DWELLINGS}, homes AS (SELECT stratum AS series, period, avg(price) AS price, avg(appraisal) AS land FROM sales GROUP BY 1, 2), hb AS (SELECT series, period, 100 * price / first_value(price) OVER w AS price, 100 * land / first_value(land) OVER w AS land FROM homes WINDOW w AS (PARTITION BY series ORDER BY period))"
    quantity = "CASE item " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in BILL.items()) + " END"
    items = ", ".join(f"'{k}'" for k in BILL)

    def tenders(of: str) -> str:
        return f"""tm AS (SELECT {of} AS series, period, category AS item, avg(price) AS rate FROM panel WHERE category IN ({items}) GROUP BY 1, 2, 3),
          tc AS (SELECT series, period, CASE WHEN count(*) = {len(BILL)} THEN sum({quantity} * rate) END AS cost FROM tm GROUP BY 1, 2),
          tx AS (SELECT series, period, 100 * cost / (SELECT min_by(cost, period) FROM tc b WHERE b.series = tc.series AND cost IS NOT NULL) AS v FROM tc)"""

    return {
        "df_freq": f"WITH {both} SELECT * FROM {_freq('nom')}",
        "df_align": f"WITH {both} SELECT * FROM {_refused(YEAR, False)}",
        "df_align_partial": f"WITH {both} SELECT * FROM {_refused('1995', True)}",
        "df_ref": f"WITH {both} SELECT deflator, round(level, 6) AS level, found, expected FROM {_level('1995')}",
        "df_const": f"WITH {real(True)} SELECT series, period, round(nominal, 4) AS nominal, round(deflator, 4) AS deflator, round(re, 4) AS real FROM re",
        "df_wage": f"""WITH {both} SELECT n.series, deflator_name AS label, left_out FROM (SELECT nom.series, any_value(nom.series || ', real wage in prices of {YEAR}, deflated by ' || nom.deflator || ' ({YEAR} = 100), ' || {WORD.format('f.frequency')}) AS deflator_name,
          count(*) FILTER (WHERE d.period IS NULL) AS left_out FROM nom JOIN {_freq('nom')} f ON f.series = nom.series LEFT JOIN defl d ON d.deflator = nom.deflator AND d.period = nom.period GROUP BY 1) n WHERE n.series NOT IN (SELECT series FROM {_refused(YEAR, True)})""",
        "df_real_growth": f"""WITH {real(False)}, g AS (SELECT series, period, nominal / lag(nominal, 12) OVER w - 1 AS n, deflator / lag(deflator, 12) OVER w - 1 AS p FROM re WINDOW w AS (PARTITION BY series ORDER BY period))
          SELECT series, period, round(100 * n, 6) AS nominal_growth, round(100 * p, 6) AS inflation, round(100 * ((1 + n) / (1 + p) - 1), 6) AS real_growth, round(100 * (n - p), 6) AS approximation, round(100 * (n - p - ((1 + n) / (1 + p) - 1)), 6) AS error FROM g WHERE n IS NOT NULL""",
        "df_volume": f"""WITH {real(True)} SELECT series, period, round(100 * re / base, 6) AS "index" FROM re JOIN (SELECT series, avg(re) AS base FROM re WHERE year(period) = {YEAR} GROUP BY 1 HAVING count(*) = 12) USING (series)""",
        "df_spans": f"""WITH {both} SELECT series, {sql.QUARTER.format('period')} AS period, round(sum(value), 4) AS value FROM nom JOIN {_freq('nom')} f USING (series) WHERE frequency IN ('M', 'Q') GROUP BY 1, 2, frequency HAVING count(*) = CASE frequency WHEN 'M' THEN 3 ELSE 1 END""",
        "df_spans_refused": f"""WITH {both} SELECT * FROM (SELECT series, CASE {_shape('f', 'the series')} WHEN frequency <> 'M' THEN 'the series is ' || {WORD.format('frequency')} || ', monthly periods would be invented' END AS reason FROM {_freq('nom')} f) WHERE reason IS NOT NULL""",
        "df_ppp": f"""WITH {par} SELECT r.series, r.period, round(value, 4) AS value, round(ppp, 4) AS ppp, round(value / ppp, 4) AS converted FROM reg r JOIN par p ON p.series = r.series AND year(p.period) = year(r.period) WHERE r.series NOT IN (SELECT series FROM {no_parity})""",
        "df_ppp_refused": f"WITH {par} SELECT * FROM {no_parity}",
        "df_pli": f"""WITH {par} SELECT series, period, round(100 * ppp / rate, 6) AS "index" FROM par WHERE series IN (SELECT series FROM {_freq('par', value='ppp')} WHERE frequency IS NOT NULL)""",
        "hs_requiv": f"""SELECT series, period, round(100 * v / first_value(v) OVER (PARTITION BY series ORDER BY period), 6) AS "index" FROM (SELECT stratum AS series, period, "index" AS v FROM ({single.oracle_sql()['hs_rent']})) WHERE v IS NOT NULL""",
        "hs_netacq": f"""WITH {homes} SELECT series, period, round(price, 6) AS price, round(land, 6) AS land, round((price - 0.3 * land) / 0.7, 6) AS "index" FROM hb""",
        "hs_usercost": f"""WITH {homes}, rt AS (SELECT {quarter} AS period, 100 * avg(l_discount) AS rate FROM lineitem GROUP BY 1),
          g AS (SELECT series, period, price, rate, 100 * (price / lag(price, 4) OVER w - 1) AS realised, 100 * (pow(price / lag(price, 8) OVER w, 0.5) - 1) AS far FROM hb JOIN rt USING (period) WINDOW w AS (PARTITION BY series ORDER BY period)),
          e AS (SELECT *, coalesce(far, avg(realised) OVER (PARTITION BY series ORDER BY period ROWS UNBOUNDED PRECEDING), 0) AS expected FROM g),
          c AS (SELECT *, price * (rate + 3 - expected) / 100 AS cost, price * (rate + 3 - coalesce(realised, 0)) / 100 AS rc FROM e)
          SELECT series, period, round(price, 6) AS price, round(rate, 6) AS rate, round(expected, 6) AS expected, round(cost, 6) AS cost, round(rc, 6) AS realised_cost, round(100 * cost / first_value(cost) OVER (PARTITION BY series ORDER BY period), 6) AS "index" FROM c""",
        "hs_payments": f"""WITH o AS (SELECT c_mktsegment AS series, {sql.QUARTER.format('o_orderdate')} AS period, o_orderpriority AS kind, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey),
          t AS (SELECT series, period, sum(v) AS total FROM o GROUP BY 1, 2 HAVING count(DISTINCT kind) = (SELECT count(DISTINCT kind) FROM o a WHERE a.series = o.series))
          SELECT series, period, round(total, 4) AS total, round(100 * total / first_value(total) OVER (PARTITION BY series ORDER BY period), 4) AS "index" FROM t""",
        "cn_output": f"""WITH {sql.DENSE}, {tenders("split_part(item_id, '|', 1)")} SELECT series, period, round(v, 6) AS "index" FROM tx""",
        "cn_gap": f"""WITH {sql.chained()}, {tenders("'all'")}, f AS (SELECT category, period, level / first_value(level) OVER (PARTITION BY category ORDER BY period) * CASE category WHEN 'PROMO' THEN 0.3 WHEN 'ECONOMY' THEN 0.45 ELSE 0.25 END AS x FROM ix WHERE category IN ('PROMO', 'ECONOMY', 'STANDARD')),
          i AS (SELECT period, 100 * sum(x) AS c FROM f GROUP BY 1 HAVING count(x) = 3), j AS (SELECT series, i.period, 100 * c / first_value(c) OVER w AS a, 100 * v / first_value(v) OVER w AS b FROM i JOIN tx ON tx.period = i.period WHERE v IS NOT NULL WINDOW w AS (ORDER BY i.period))
          SELECT series, period, round(a, 6) AS input, round(b, 6) AS output, round(100 * b / a, 6) AS gap FROM j""",
    }
