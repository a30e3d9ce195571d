"""SQL of the panel views and shared steps, for the queries' oracles."""

from __future__ import annotations

_SALES = "lineitem JOIN part ON l_partkey = p_partkey"
MONTH = "CAST(date_trunc('month', {}) AS DATE)"
QUARTER = "CAST(date_trunc('quarter', {}) AS DATE)"


def unit_values(item: str) -> str:
    return f"""SELECT *, expenditure / quantity AS price FROM (
      SELECT {MONTH.format('l_shipdate')} AS period, p_type AS category, {item} AS item_id,
             sum(l_extendedprice) AS expenditure, sum(l_quantity) AS quantity FROM {_SALES} GROUP BY 1, 2, 3)"""


DENSE = f"panel AS ({unit_values("p_brand || '|' || p_type")})"
SPARSE = f"panel AS ({unit_values('CAST(l_partkey AS VARCHAR)')})"
FAULTY = f"""clean AS ({unit_values("p_brand || '|' || p_type")}),
keyed AS (SELECT *, year(period) * 12 + month(period) + length(item_id) * 7 + ascii(substring(item_id, 8, 1)) * 3 AS k FROM clean),
panel AS (SELECT period, category, item_id, expenditure, quantity,
  CASE WHEN k % 29 = 0 THEN 0.0 WHEN k % 31 = 0 THEN price * 100 WHEN k % 37 = 0 THEN price / 100 ELSE price END AS price FROM keyed)"""
TRADE = f"""flows AS (SELECT {QUARTER.format('l_shipdate')} AS period, CASE WHEN l_linestatus = 'O' THEN 'export' ELSE 'import' END AS flow,
  p_type || '|' || p_brand AS product, sum(l_extendedprice) AS value, sum(l_quantity) AS quantity FROM {_SALES} GROUP BY 1, 2, 3)"""
REGIONAL = f"""regional AS (SELECT *, expenditure / quantity AS price FROM (SELECT n_name AS region, p_brand || '|' || p_type AS product,
  sum(l_extendedprice) AS expenditure, sum(l_quantity) AS quantity FROM {_SALES} JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2))"""
DWELLINGS = f"""sales AS (SELECT l_partkey AS property_id, {QUARTER.format('l_shipdate')} AS period, p_type AS stratum, p_size AS floor_area,
  p_retailprice AS appraisal, avg(l_extendedprice / l_quantity) AS price FROM {_SALES} GROUP BY 1, 2, 3, 4, 5)"""
RENTS = f"""rents AS (SELECT o_custkey AS dwelling_id, c_mktsegment AS stratum, {QUARTER.format('o_orderdate')} AS period, avg(o_totalprice) AS rent
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)"""

LINKED = """periods AS (SELECT DISTINCT category, period FROM panel),
linked AS (SELECT category, period, row_number() OVER w AS rank, lag(period) OVER w AS before,
  min(period) OVER (PARTITION BY category) AS base FROM periods WINDOW w AS (PARTITION BY category ORDER BY period))"""


def pairs(base: bool) -> str:
    to = "base" if base else "before"
    return f"""pairs AS (SELECT n.category, n.period, n.item_id, n.price AS pt, n.quantity AS qt, t.price AS p0, t.quantity AS q0, t.price * t.quantity AS w
  FROM panel n JOIN linked l ON n.category = l.category AND n.period = l.period
  JOIN panel t ON t.category = l.category AND t.period = l.{to} AND t.item_id = n.item_id WHERE n.price > 0 AND t.price > 0)"""


def chained(formula: str = "exp(avg(ln(pt / p0)))", panel: str = DENSE) -> str:
    """CTEs up to ix: category, period, level, matched, the chained index."""
    return f"""{panel}, {LINKED}, {pairs(False)},
lk AS (SELECT category, period, {formula} AS link, count(*) AS n FROM pairs GROUP BY 1, 2),
ix AS (SELECT l.category, l.period, CASE WHEN l.rank > 1 THEN coalesce(n, 0) END AS matched,
  100 * exp(sum(CASE WHEN n >= 2 AND link > 0 THEN ln(link) ELSE 0 END) OVER (PARTITION BY l.category ORDER BY l.period)) AS level
  FROM linked l LEFT JOIN lk ON l.category = lk.category AND l.period = lk.period)"""


FIXED = f"""{LINKED}, {pairs(True)},
lk AS (SELECT category, period, exp(avg(ln(pt / p0))) AS link, count(*) AS n FROM pairs GROUP BY 1, 2),
fx AS (SELECT l.category, l.period, coalesce(n, 0) AS matched, CASE WHEN l.rank = 1 THEN 100.0 WHEN n >= 2 THEN 100 * link END AS level
  FROM linked l LEFT JOIN lk ON l.category = lk.category AND l.period = lk.period)"""

WEIGHTS = """wt AS (SELECT category, sum(w) AS weight FROM (SELECT category, item_id, avg(expenditure) AS w FROM panel GROUP BY 1, 2) GROUP BY 1 HAVING sum(w) > 0)"""
TOTAL = """total AS (SELECT period, sum(weight * level) / (SELECT sum(weight) FROM wt) AS level FROM ix JOIN wt USING (category) GROUP BY 1)"""
SERIES = """series AS (SELECT category AS series, period, level FROM ix UNION ALL
  SELECT 'All items', period, exp(avg(ln(level))) FROM ix GROUP BY period)"""
