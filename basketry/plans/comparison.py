"""Queries for multilateral indices beside each other."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from basketry.operators import comparison, multilateral
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels
from basketry.sources.staging import staged


def _dense(s, d):
    return staged(panels.dense_panel(s, d), "dense")


def _thin(s, d):
    """The sparse panel with two types sold as items of one month each, and no January but that of 1997."""
    p = panels.sparse_panel(s, d).filter("month(period) <> 1 or year(period) = 1997")
    lone = F.col("category").isin("PROMO", "SMALL")
    return staged(p.withColumn("item_id", F.when(lone, F.concat_ws("|", "item_id", "period")).otherwise(F.col("item_id"))), "thin")


def _fixed(splice, s, d):
    return rounded(comparison.extend_fixed_base(_dense(s, d), splice))


def _compared(s, d):
    p = _dense(s, d)
    parts = {"geks_fisher": multilateral.geks(p), "geks_tornqvist": multilateral.geks(p, "tornqvist")}
    parts |= {n: comparison.extend_fixed_base(p, n).select("period", "index") for n in ("fbew", "fbmw")}
    parts["lone items"] = multilateral.geks(p.withColumn("item_id", F.concat_ws("|", "item_id", "period")))
    return comparison.compare(parts)


def queries() -> dict:
    return {
        "ml_mes": lambda s, d: rounded(comparison.matched_share(panels.sparse_panel(s, d))),
        "ml_fbew": partial(_fixed, "fbew"),
        "ml_fbmw": partial(_fixed, "fbmw"),
        "ml_seasonal": lambda s, d: rounded(comparison.seasonal(_dense(s, d))),
        "ml_seasonal_quarters": lambda s, d: rounded(comparison.seasonal(staged(panels.dense_panel(s, d).withColumn("period", F.trunc("period", "QUARTER")), "quarters"), per_year=4)),
        "ml_seasonal_skipped": lambda s, d: comparison.skipped_seasons(_thin(s, d)),
        "ml_all": lambda s, d: rounded(comparison.by_group(_dense(s, d), "tornqvist")),
        "ml_all_skipped": lambda s, d: comparison.skipped_groups(_thin(s, d)),
        "ml_drift": lambda s, d: rounded(_drift(s, d)),
        "ml_compare": lambda s, d: rounded(_compared(s, d), 5),
        "ml_spread": lambda s, d: rounded(comparison.spread(_compared(s, d)), 5),
    }


def _drift(s, d):
    p = _dense(s, d)
    return comparison.drift(p, multilateral.geks(p, "tornqvist"))


BLOCK = {
    "fisher": "0.5 * ln(sum(pb * qa) / sum(pa * qa) * sum(pb * qb) / sum(pa * qb))",
    "tornqvist": "0.5 * (sum(ea * ln(pb / pa)) / sum(ea) + sum(eb * ln(pb / pa)) / sum(eb))",
}


def _geks(name: str, rows: str, block: str = "fisher") -> str:
    """CTEs up to `name` (k, period, v): GEKS of each k of rows (k, period, item_id, e, q), with bridges that compare with all."""
    return f"""{name}_u AS (SELECT k, period, item_id, sum(e) AS e, sum(q) AS q, sum(e) / sum(q) AS p FROM {rows} GROUP BY 1, 2, 3 HAVING sum(q) > 0),
      {name}_p AS (SELECT DISTINCT k, period FROM {name}_u),
      {name}_t AS (SELECT k, s, t, {BLOCK[block]} AS r FROM (SELECT a.k, a.period AS s, b.period AS t, a.p AS pa, b.p AS pb, a.q AS qa, b.q AS qb, a.e AS ea, b.e AS eb FROM {name}_u a JOIN {name}_u b ON a.k = b.k AND a.item_id = b.item_id AND a.period < b.period) GROUP BY 1, 2, 3 HAVING count(*) >= 2),
      {name}_b AS (SELECT k, s, t, r FROM {name}_t UNION ALL SELECT k, t, s, -r FROM {name}_t UNION ALL SELECT k, period, period, 0.0 FROM {name}_p),
      {name}_n AS (SELECT k, count(*) AS n, min(period) AS t0 FROM {name}_p GROUP BY 1),
      {name}_w AS (SELECT b.k, b.s, t0 FROM {name}_b b JOIN {name}_n n ON n.k = b.k GROUP BY b.k, b.s, t0, n HAVING count(*) = n),
      {name} AS (SELECT b.k, b.t AS period, 100 * exp(avg(b.r - z.r)) AS v FROM {name}_b b JOIN {name}_w w ON w.k = b.k AND w.s = b.s JOIN {name}_b z ON z.k = b.k AND z.s = b.s AND z.t = w.t0 GROUP BY 1, 2)"""


def _rows(key: str, period: str = "period") -> str:
    return f"(SELECT {key} AS k, {period} AS period, item_id, expenditure AS e, quantity AS q FROM panel WHERE price > 0)"


def _seasons(key: str, per_year: int, period: str) -> str:
    return f"""WITH {sql.DENSE}, {_geks('g', _rows(key, period))},
      y AS (SELECT period, CAST(k AS INT) AS season, v AS level, 100 * v / lag(v) OVER (PARTITION BY k ORDER BY period) AS yoy FROM g WHERE k IN (SELECT k FROM g GROUP BY 1 HAVING count(*) > 1)),
      m AS (SELECT period, avg(ln(yoy / 100)) OVER w AS m, count(*) OVER w AS n FROM y WHERE yoy IS NOT NULL WINDOW w AS (ORDER BY period ROWS BETWEEN {per_year - 1} PRECEDING AND CURRENT ROW)),
      r AS (SELECT period, 100 * exp(sum(m) OVER (ORDER BY period)) AS rolling FROM m WHERE n = {per_year})
      SELECT period, season, round(level, 6) AS level, round(yoy, 6) AS year_over_year, round(rolling, 6) AS rolling_year FROM y LEFT JOIN r USING (period)"""


def oracle_sql() -> dict[str, str]:
    thin = f"""full_ AS (SELECT * FROM ({sql.unit_values('CAST(l_partkey AS VARCHAR)')})), panel AS (SELECT period, category, CASE WHEN category IN ('PROMO', 'SMALL') THEN item_id || '|' || period ELSE item_id END AS item_id, expenditure, quantity, price
      FROM full_ WHERE month(period) <> 1 OR year(period) = 1997)"""
    windows = f"""pn AS (SELECT period, row_number() OVER (ORDER BY period) AS i FROM (SELECT DISTINCT period FROM panel)), an AS (SELECT * FROM pn WHERE i = 1 OR month(period) = 12),
      cu AS (SELECT i AS k, period AS current, coalesce((SELECT max(a.i) FROM an a WHERE a.i < pn.i), 1) AS ai FROM pn),
      wr AS (SELECT k, p.period, p.item_id, p.expenditure AS e, p.quantity AS q FROM cu JOIN pn ON pn.i BETWEEN cu.ai AND cu.k JOIN panel p ON p.period = pn.period WHERE p.price > 0),
      {_geks('g', 'wr')}, lv AS (SELECT k, i, v FROM g JOIN pn USING (period))"""

    def fixed(splice: str) -> str:
        at = "ai" if splice == "fbew" else "greatest(cu.k - 1, 1)"
        run = "SELECT m.k, m.current, m.ai, m.move + coalesce((SELECT sum(a.move) FROM m a WHERE a.k <= m.ai AND a.k IN (SELECT i FROM an)), 0) AS lg FROM m" if splice == "fbew" else "SELECT k, current, ai, sum(move) OVER (ORDER BY k) AS lg FROM m"
        return f"""m AS (SELECT cu.k, current, ai, ln(b.v / a.v) AS move FROM cu LEFT JOIN lv b ON b.k = cu.k AND b.i = cu.k LEFT JOIN lv a ON a.k = cu.k AND a.i = {at}),
          rs AS (SELECT k, current, ai, 100 * exp(lg) AS v FROM ({run})),
          sp AS (SELECT l.k, max(r.v * n.v / l.v) - min(r.v * n.v / l.v) AS spread FROM lv l JOIN lv n ON n.k = l.k AND n.i = l.k JOIN rs r ON r.k = l.i WHERE l.i < l.k GROUP BY 1)"""

    def base(splice: str) -> str:
        return f"""WITH {sql.DENSE}, {windows}, {fixed(splice)} SELECT current AS period, pn.period AS anchor, round(v, 6) AS "index", round(CASE WHEN v IS NOT NULL THEN coalesce(spread, 0) END, 6) AS spread FROM rs JOIN pn ON pn.i = rs.ai LEFT JOIN sp USING (k)"""

    def end(name: str, rows: str) -> str:
        return f"""SELECT '{name}' AS method, count(*) AS periods, max(period) AS "last", arg_max_null(v, period) AS final_level, arg_min(v, period) AS first_level FROM ({rows})"""

    lone = "(SELECT 1 AS k, period, item_id || '|' || period AS item_id, expenditure AS e, quantity AS q FROM panel WHERE price > 0)"
    nested = {n: f"SELECT current AS period, v FROM (WITH {fixed(n)} SELECT * FROM rs)" for n in ("fbew", "fbmw")}
    ends = " UNION ALL ".join([end("geks_fisher", "SELECT * FROM gf"), end("geks_tornqvist", "SELECT * FROM gt"), end("lone items", "SELECT * FROM gl"), *[end(n, q) for n, q in nested.items()]])
    compared = f"""{sql.DENSE}, {windows}, {_geks('gf', _rows('1'))}, {_geks('gt', _rows('1'), 'tornqvist')}, {_geks('gl', lone)},
      cp AS (SELECT method, periods, "last", final_level, CASE WHEN periods > 1 THEN 100 * (pow(final_level / first_level, 12 / (periods - 1)) - 1) END AS annualised, CASE WHEN periods = 0 THEN 'no period compares with all others' WHEN final_level IS NULL THEN 'the last window does not compare' END AS reason FROM ({ends}))"""
    return {
        "ml_mes": f"""WITH {sql.SPARSE}, i AS (SELECT category, item_id, count(*) AS n, sum(expenditure) AS e FROM panel WHERE price > 0 GROUP BY 1, 2), w AS (SELECT category, count(DISTINCT period) AS periods FROM panel WHERE price > 0 GROUP BY 1)
          SELECT category, count(*) AS items, count(*) FILTER (WHERE n = periods) AS always, round(coalesce(sum(e) FILTER (WHERE n = periods), 0) / sum(e), 6) AS share FROM i JOIN w USING (category) GROUP BY 1""",
        "ml_fbew": base("fbew"),
        "ml_fbmw": base("fbmw"),
        "ml_seasonal": _seasons("month(period)", 12, "period"),
        "ml_seasonal_quarters": _seasons("quarter(period)", 4, sql.QUARTER.format("period")),
        "ml_seasonal_skipped": f"""WITH {thin}, {_geks('g', _rows('month(period)'))} SELECT CAST(month(period) AS INT) AS season, CASE WHEN count(DISTINCT period) < 2 THEN 'there is one year of it only' ELSE 'no period compares with all others' END AS reason FROM panel
          GROUP BY 1 HAVING count(DISTINCT period) < 2 OR any_value(month(period)) NOT IN (SELECT k FROM g)""",
        "ml_all": f"""WITH {sql.DENSE}, {_geks('g', _rows('category'), 'tornqvist')}, {sql.WEIGHTS}, own AS (SELECT * FROM wt WHERE category IN (SELECT k FROM g))
          SELECT k AS series, period, round(v, 6) AS "index" FROM g UNION ALL SELECT 'All items', period, round(sum(weight * v) / (SELECT sum(weight) FROM own), 6) FROM g JOIN own ON category = k GROUP BY 2""",
        "ml_all_skipped": f"WITH {thin}, {_geks('g', _rows('category'))} SELECT category, count(DISTINCT period) AS periods FROM panel WHERE category NOT IN (SELECT k FROM g) GROUP BY 1",
        "ml_drift": f"""WITH {sql.DENSE}, {_geks('g', _rows('1'), 'tornqvist')}, pd AS (SELECT period, lag(period) OVER (ORDER BY period) AS before FROM (SELECT DISTINCT period FROM panel)),
          lk AS (SELECT pd.period, 0.5 * (sum(a.expenditure * ln(b.price / a.price)) / sum(a.expenditure) + sum(b.expenditure * ln(b.price / a.price)) / sum(b.expenditure)) AS r FROM pd JOIN panel b ON b.period = pd.period JOIN panel a ON a.period = pd.before AND a.item_id = b.item_id WHERE a.price > 0 AND b.price > 0 GROUP BY 1 HAVING count(*) >= 2),
          c AS (SELECT pd.period, 100 * exp(sum(coalesce(r, 0)) OVER (ORDER BY pd.period)) AS c FROM pd LEFT JOIN lk USING (period))
          SELECT period, round(c, 6) AS chained, round(v, 6) AS multilateral, round(c - v, 6) AS drift, abs(c - v) > 1 AS beyond FROM c JOIN g USING (period)""",
        "ml_compare": f"""WITH {compared} SELECT method, periods, "last", round(final_level, 5) AS final_level, round(annualised, 5) AS annualised, reason FROM cp""",
        "ml_spread": f"WITH {compared} SELECT count(*) AS computed, round(min(final_level), 5) AS level_min, round(max(final_level), 5) AS level_max, round(max(final_level) - min(final_level), 5) AS level_spread, round(max(annualised) - min(annualised), 5) AS rate_spread FROM cp WHERE final_level IS NOT NULL",
    }
