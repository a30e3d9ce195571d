"""Queries for trade, space, property, rents, deflation, escalation, season, sampling and publication."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from basketry.functions.formulas import BILATERAL
from basketry.operators import domain, index, quality
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels


def _total(s, d):
    return index.all_series(panels.dense_panel(s, d)).filter("series = 'All items'").select("period", "index")


def _income(s, d):
    """Monthly expenditure as a nominal series."""
    return panels.dense_panel(s, d).groupBy("period").agg(F.sum("expenditure").alias("value"))


def _inputs(s, d):
    return index.chained_index(panels.dense_panel(s, d)).select(F.col("category").alias("input"), "period", "index")


def _deflated(s, d):
    return domain.deflate(_income(s, d), _total(s, d), "1997")


def _cells(s, d):
    p = panels.sparse_panel(s, d)
    return p.groupBy("category", "period").agg(F.count("*").alias("n"), F.sum("expenditure").alias("value"))


def _vintages(s, d):
    """The All items series as compiled at the end of four successive years."""
    p = panels.dense_panel(s, d)
    parts = []
    for v in (1997, 1998, 1999, 2000):
        seen = p.filter(F.year("period") <= v)
        parts.append(index.geometric_all_items(index.chained_index(seen, "dutot" if v < 1999 else "jevons")).select("period", F.lit(v).alias("vintage"), F.col("index").alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _price(name, s, d):
    return rounded(domain.trade_price_index(panels.trade_flows(s, d), "export", name))


SHARES = {"PROMO": 0.3, "ECONOMY": 0.45, "STANDARD": 0.25}


def queries() -> dict:
    out = {f"tr_price_{n}": partial(_price, n) for n in ("laspeyres", "paasche", "fisher")}
    return out | {
        "tr_uv": lambda s, d: rounded(domain.unit_value_index(panels.trade_flows(s, d), "import")),
        "tr_bias": lambda s, d: rounded(domain.unit_value_bias(panels.trade_flows(s, d), "export")),
        "tr_tot": lambda s, d: rounded(domain.terms_of_trade(panels.trade_flows(s, d))),
        "sx_overlap": lambda s, d: domain.overlap(panels.regional_prices(s, d)),
        "sx_cpd": lambda s, d: rounded(domain.country_product_dummy(panels.regional_prices(s, d), "NATION_0")),
        "sx_wcpd": lambda s, d: rounded(domain.country_product_dummy(panels.regional_prices(s, d), "NATION_0", weighted=True)),
        "sx_gk": lambda s, d: rounded(domain.spatial_geary_khamis(panels.regional_prices(s, d), "NATION_0")),
        "pr_stratmedian": lambda s, d: rounded(domain.stratified_median(panels.dwelling_sales(s, d))),
        "pr_mixmean": lambda s, d: rounded(domain.mix_adjusted_mean(panels.dwelling_sales(s, d))),
        "pr_spar": lambda s, d: rounded(domain.appraisal_ratio(panels.dwelling_sales(s, d))),
        "pr_pairs": lambda s, d: rounded(domain.repeat_pairs(panels.dwelling_sales(s, d))),
        "pr_repeat": lambda s, d: rounded(domain.repeat_sales(panels.dwelling_sales(s, d))),
        "pr_repeat_weighted": lambda s, d: rounded(domain.repeat_sales(panels.dwelling_sales(s, d), weighted=True)),
        "pr_counts": lambda s, d: domain.sale_counts(panels.dwelling_sales(s, d)),
        "hs_rent": lambda s, d: rounded(domain.rent_index(panels.dwelling_rents(s, d))),
        "df_deflate": lambda s, d: rounded(_deflated(s, d), 4),
        "df_tofreq": lambda s, d: rounded(domain.to_quarters(_income(s, d)), 4),
        "df_growth": lambda s, d: rounded(domain.real_growth(_deflated(s, d))),
        "cn_input": lambda s, d: rounded(domain.input_cost_index(_inputs(s, d), SHARES)),
        "es_apply": lambda s, d: rounded(domain.escalate(_total(s, d), 100_000.0, lag=2, share=0.8, dead_band=0.5, trigger=1.0, cap=5.0, collar=3.0)),
        "se_items": lambda s, d: domain.strictly_seasonal(panels.sparse_panel(s, d)),
        "se_rothwell": lambda s, d: rounded(domain.rothwell(panels.dense_panel(s, d), 1996)),
        "dg_season": lambda s, d: rounded(domain.seasonal_amplitude(index.all_series(panels.dense_panel(s, d)))),
        "dg_churn": lambda s, d: rounded(domain.churn(panels.sparse_panel(s, d))),
        "un_relatives": lambda s, d: rounded(domain.matched_relatives(panels.dense_panel(s, d), "1995-01-01", "1998-01-01")),
        "dis_primary": lambda s, d: rounded(domain.suppress(_cells(s, d).select("category", "period", "n", "value"), "category", "value", "n", 130).filter("suppressed = 'primary'").drop("published")),
        "dis_secondary": lambda s, d: rounded(domain.suppress(_cells(s, d), "period", "value", "n", 100)),
        "rv_triangle": lambda s, d: rounded(domain.revision_triangle(_vintages(s, d))),
        "snk_hash": lambda s, d: domain.content_hash(panels.table(s, d, "lineitem")),
        "snk_sanitise": lambda s, d: domain.sanitised(panels.table(s, d, "nation").withColumn("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("="), "n_name")).otherwise(F.col("n_name")))),
    }


def oracle_sql() -> dict[str, str]:
    chain = sql.chained()
    columns = ("l_discount", "l_extendedprice", "l_linenumber", "l_linestatus", "l_orderkey", "l_partkey", "l_quantity", "l_returnflag", "l_shipdate", "l_suppkey", "l_tax")
    hashed = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(30))" for c in columns)
    total = f"{chain}, tot AS (SELECT period, exp(avg(ln(level))) AS level FROM ix GROUP BY 1)"
    price = """{0}, x_{1} AS (SELECT period, product, value, quantity, value / quantity AS price FROM flows WHERE flow = '{1}'),
      b_{1} AS (SELECT product, price AS p0, quantity AS q0 FROM x_{1} WHERE period = (SELECT min(period) FROM x_{1})),
      i_{1} AS (SELECT period, 100 * {2} AS v, count(*) AS matched FROM (SELECT n.period, n.price AS pt, n.quantity AS qt, p0, q0 FROM x_{1} n JOIN b_{1} b ON n.product = b.product) GROUP BY 1)"""
    fisher = BILATERAL["fisher"]
    out = {f"tr_price_{n}": f"WITH {price.format(sql.TRADE, 'export', BILATERAL[n])} SELECT period, round(v, 6) AS \"index\", matched FROM i_export" for n in ("laspeyres", "paasche", "fisher")}
    uv = "{0}, u_{1} AS (SELECT period, 100 * u / first_value(u) OVER (ORDER BY period) AS v FROM (SELECT period, sum(value) / sum(quantity) AS u FROM flows WHERE flow = '{1}' GROUP BY 1))"
    both = price.format(sql.TRADE, "export", fisher)
    fixed = """, f AS (SELECT stratum, m AS m0, value AS w FROM c WHERE period = (SELECT min(period) FROM c))
      SELECT period, round(100 * sum(w * m / m0) / sum(w), 6) AS "index" FROM c JOIN f USING (stratum) GROUP BY 1"""
    pairs = f"""{sql.DWELLINGS}, q AS (SELECT property_id, lag(period) OVER w AS "first", period AS "second", ln(price / lag(price) OVER w) AS r FROM sales WHERE price > 0 WINDOW w AS (PARTITION BY property_id ORDER BY period, price))"""
    income = "inc AS (SELECT period, sum(expenditure) AS value FROM panel GROUP BY 1)"
    deflated = f"{total}, {income}, df AS (SELECT inc.period, value AS nominal, level AS deflator, value / (level / (SELECT avg(level) FROM tot WHERE year(period) = 1997)) AS re FROM inc JOIN tot ON inc.period = tot.period)"
    cells = f"{sql.SPARSE}, c AS (SELECT category, period, count(*) AS n, sum(expenditure) AS value FROM panel GROUP BY 1, 2)"
    return out | {
        "tr_uv": f"WITH {uv.format(sql.TRADE, 'import')} SELECT period, round(v, 6) AS \"index\" FROM u_import",
        "tr_bias": f"""WITH {both}, {uv.format('z AS (SELECT 1)', 'export')} SELECT u.period, round(u.v, 6) AS unit_value, round(i.v, 6) AS price, round(u.v - i.v, 6) AS gap, round((u.v / i.v - 1) * 100, 6) AS composition FROM u_export u JOIN i_export i ON u.period = i.period""",
        "tr_tot": f"""WITH {both}, {price.format('z AS (SELECT 1)', 'import', fisher)} SELECT e.period, round(e.v / i.v * 100, 6) AS "index" FROM i_export e JOIN i_import i ON e.period = i.period""",
        "sx_overlap": f"WITH {sql.REGIONAL} SELECT a.region AS r1, b.region AS r2, count(*) AS n FROM regional a JOIN regional b ON a.product = b.product WHERE a.price > 0 AND b.price > 0 GROUP BY 1, 2",
        "pr_stratmedian": f"WITH {sql.DWELLINGS}, c AS (SELECT stratum, period, quantile_cont(price, 0.5) AS m, sum(price) AS value FROM sales GROUP BY 1, 2){fixed}",
        "pr_mixmean": f"""WITH {sql.DWELLINGS}, e AS (SELECT quantile_cont(CAST(floor_area AS DOUBLE), 1.0 / 3) AS e1, quantile_cont(CAST(floor_area AS DOUBLE), 2.0 / 3) AS e2 FROM sales),
          c AS (SELECT stratum || '|' || CAST(CAST(e1 < floor_area AS INT) + CAST(e2 < floor_area AS INT) AS VARCHAR) AS stratum, period, avg(price) AS m, sum(price) AS value FROM sales, e GROUP BY 1, 2){fixed}""",
        "pr_spar": f"""WITH {sql.DWELLINGS}, r AS (SELECT period, sum(price) / sum(appraisal) AS r FROM sales WHERE price > 0 AND appraisal > 0 GROUP BY 1) SELECT period, round(100 * r / first_value(r) OVER (ORDER BY period), 6) AS "index" FROM r""",
        "pr_pairs": f"""WITH {pairs} SELECT property_id, "first", "second", round(r, 6) AS log_ratio, CAST(date_diff('month', "first", "second") AS INT) AS months FROM q WHERE "first" < "second" """,
        "pr_counts": f"WITH {sql.DWELLINGS} SELECT period, stratum, count(*) AS n FROM sales GROUP BY 1, 2 UNION ALL SELECT period, 'total', count(*) FROM sales GROUP BY 1",
        "hs_rent": f"""WITH {sql.RENTS}, p AS (SELECT period, lag(period) OVER (ORDER BY period) AS before FROM (SELECT DISTINCT period FROM rents)),
          l AS (SELECT n.stratum, n.period, avg(ln(n.rent / t.rent)) AS link, count(*) AS matched FROM rents n JOIN p ON n.period = p.period JOIN rents t ON t.period = p.before AND t.stratum = n.stratum AND t.dwelling_id = n.dwelling_id WHERE n.rent > 0 AND t.rent > 0 GROUP BY 1, 2),
          g AS (SELECT x.stratum, x.period, link, matched, row_number() OVER (PARTITION BY x.stratum ORDER BY x.period) AS rn FROM (SELECT DISTINCT stratum, period FROM rents) x LEFT JOIN l ON x.stratum = l.stratum AND x.period = l.period),
          h AS (SELECT *, sum(CASE WHEN rn > 1 AND link IS NULL THEN 1 ELSE 0 END) OVER w AS broken, sum(coalesce(link, 0)) OVER w AS s FROM g WINDOW w AS (PARTITION BY stratum ORDER BY period))
          SELECT stratum, period, round(CASE WHEN broken = 0 THEN 100 * exp(s) END, 6) AS "index", matched FROM h""",
        "df_deflate": f"WITH {deflated} SELECT period, round(nominal, 4) AS nominal, round(deflator, 4) AS deflator, round(re, 4) AS real FROM df",
        "df_tofreq": f"WITH {sql.DENSE}, {income} SELECT {sql.QUARTER.format('period')} AS period, round(avg(value), 4) AS value FROM inc GROUP BY 1 HAVING count(value) = 3",
        "df_growth": f"""WITH {deflated}, g AS (SELECT period, nominal / lag(nominal, 12) OVER w - 1 AS n, deflator / lag(deflator, 12) OVER w - 1 AS d FROM df WINDOW w AS (ORDER BY period))
          SELECT period, round(((1 + n) / (1 + d) - 1) * 100, 6) AS exact, round((n - d) * 100, 6) AS approximate FROM g WHERE n IS NOT NULL""",
        "cn_input": f"""WITH {chain}, f AS (SELECT category, period, level / first_value(level) OVER (PARTITION BY category ORDER BY period) * CASE category WHEN 'PROMO' THEN 0.3 WHEN 'ECONOMY' THEN 0.45 ELSE 0.25 END AS x FROM ix WHERE category IN ('PROMO', 'ECONOMY', 'STANDARD'))
          SELECT period, round(CASE WHEN count(x) = 3 THEN 100 * sum(x) END, 6) AS "index" FROM f GROUP BY 1""",
        "es_apply": f"""WITH RECURSIVE {total}, r AS (SELECT period, lag(level, 2) OVER (ORDER BY period) AS v FROM tot), m AS (SELECT period, row_number() OVER (ORDER BY period) AS k, (v / first_value(v) OVER (ORDER BY period) - 1) * 100 AS mv FROM r WHERE v IS NOT NULL),
          b AS (SELECT *, CASE WHEN abs(mv) <= 0.5 THEN 0.0 ELSE mv END AS bm FROM m),
          f AS (SELECT period, k, mv, CASE WHEN abs(bm) >= 1 THEN bm ELSE 0.0 END AS held FROM b WHERE k = 1 UNION ALL SELECT b.period, b.k, b.mv, CASE WHEN abs(b.bm - f.held) >= 1 THEN b.bm ELSE f.held END FROM f JOIN b ON b.k = f.k + 1)
          SELECT period, round(mv, 6) AS movement, round(greatest(least(0.8 * held, 5.0), -3.0), 6) AS applied, round(100000 * (1 + greatest(least(0.8 * held, 5.0), -3.0) / 100), 6) AS payment FROM f""",
        "se_items": f"""WITH {sql.SPARSE}, a AS (SELECT count(DISTINCT month(period)) AS am FROM panel), i AS (SELECT item_id, count(DISTINCT month(period)) AS months, count(DISTINCT year(period)) AS years FROM panel WHERE price > 0 GROUP BY 1)
          SELECT item_id, months, years FROM i, a WHERE years >= 2 AND months < am AND months <= 0.9 * am""",
        "se_rothwell": f"""WITH {sql.DENSE}, b AS (SELECT item_id, avg(price) AS p0, avg(quantity) AS q0 FROM panel WHERE year(period) = 1996 AND price > 0 GROUP BY 1)
          SELECT period, round(100 * sum(q0 * price) / sum(q0 * p0), 6) AS "index" FROM panel JOIN b USING (item_id) WHERE price > 0 GROUP BY 1""",
        "dg_season": f"""WITH {chain}, {sql.SERIES}, d AS (SELECT series, period, ln(level) - CASE WHEN count(level) OVER f >= 6 THEN avg(ln(level)) OVER f END AS dev FROM series WINDOW f AS (PARTITION BY series ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
          m AS (SELECT series, month(period) AS mo, avg(dev) AS f FROM d GROUP BY 1, 2) SELECT series, round((exp(max(f)) - exp(min(f))) * 100, 6) AS amplitude FROM m GROUP BY 1""",
        "dg_churn": f"""WITH {sql.SPARSE} SELECT item_id, min(period) AS "first", max(period) AS "last", count(*) AS periods, round(min_by(price, period), 6) AS entry_price, round(max_by(price, period), 6) AS exit_price FROM panel WHERE price > 0 GROUP BY 1""",
        "un_relatives": f"""WITH {sql.DENSE}, r AS (SELECT category, item_id, max(CASE WHEN period = DATE '1995-01-01' THEN price END) AS a, max(CASE WHEN period = DATE '1998-01-01' THEN price END) AS b FROM panel WHERE price > 0 GROUP BY 1, 2)
          SELECT category, item_id, round(ln(b / a), 6) AS log_relative FROM r WHERE a IS NOT NULL AND b IS NOT NULL""",
        "dis_primary": f"WITH {cells} SELECT category, period, n, round(value, 6) AS value, 'primary' AS suppressed FROM c WHERE n < 130",
        "dis_secondary": f"""WITH {cells}, k AS (SELECT *, n < 100 AS p, count(*) FILTER (WHERE n < 100) OVER (PARTITION BY period) AS np, row_number() OVER (PARTITION BY period, n < 100 ORDER BY value) AS rk FROM c),
          s AS (SELECT *, CASE WHEN p THEN 'primary' WHEN np = 1 AND rk = 1 THEN 'secondary' END AS suppressed FROM k)
          SELECT category, period, n, round(value, 6) AS value, suppressed, round(CASE WHEN suppressed IS NULL THEN value END, 6) AS published FROM s""",
        "snk_hash": f"""SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {hashed})), 1, 15) AS HUGEINT)) AS VARCHAR) AS hash FROM lineitem""",
        "snk_sanitise": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN '''=' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation",
    }
