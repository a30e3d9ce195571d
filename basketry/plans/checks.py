"""Queries for hedonic diagnostics and for projections by smoothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import hedonic_checks, index, projections
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels
from basketry.sources.staging import staged


def _sales(s, d):
    return staged(panels.dwelling_sales(s, d), "sales")


def _power(s, d):
    sales = _sales(s, d)
    power = hedonic_checks.box_cox_power(sales, ["appraisal"], passes=2)
    return rounded(sales.agg(F.count("*").alias("n")).withColumn("power", F.lit(power)))


def _absorbed(s, d):
    sales = _sales(s, d)
    found, coefficients = hedonic_checks.absorbed_index(sales, ["appraisal"], "floor_area")
    return rounded(hedonic_checks.absorbed_residuals(sales, found, coefficients, "floor_area"))


def _series(s, d):
    return staged(index.all_series(panels.dense_panel(s, d)), "series")


def _errors(s, d):
    return staged(projections.backtest(_series(s, d)), "errors")


def _tests(s, d):
    series = _series(s, d)
    grid = projections.smoothing_grid(s).filter("id = 0")
    return rounded(projections.residual_tests(projections.smoothed(series, grid)), 4)


def queries() -> dict:
    return {
        "hd_lambda": _power,
        "hd_vif": lambda s, d: rounded(hedonic_checks.inflation(_sales(s, d), ["floor_area", "appraisal"], time=None)),
        "hd_leverage": lambda s, d: rounded(hedonic_checks.leverage(_sales(s, d), ["floor_area"], time=None).select("property_id", "period", "leverage"), 9),
        "hd_stability": lambda s, d: rounded(hedonic_checks.stability(_sales(s, d), ["appraisal"], window=8), 5),
        "hd_stability_range": lambda s, d: rounded(hedonic_checks.stability_range(hedonic_checks.stability(_sales(s, d), ["appraisal"], window=8)), 5),
        "hd_absorbed": lambda s, d: rounded(hedonic_checks.absorbed_index(_sales(s, d), ["appraisal"], "floor_area")[0]),
        "hd_absorbed_check": _absorbed,
        "fc_ets": lambda s, d: rounded(projections.accuracy(_errors(s, d)), 5),
        "pj_dm": lambda s, d: rounded(projections.diebold_mariano(_errors(s, d)), 4),
        "fc_diag": _tests,
    }


_GRID = """gr AS (SELECT CAST(row_number() OVER (ORDER BY a, t, g) - 1 AS INTEGER) AS id, alpha, beta, phi, gamma, 2 + more + CASE WHEN gamma >= 0 THEN 1 ELSE 0 END AS size
  FROM (VALUES (0, 0.1), (1, 0.3), (2, 0.5), (3, 0.7), (4, 0.9)) av(a, alpha), (VALUES (0, 0.0, 0.0, 0), (1, 0.01, 1.0, 1), (2, 0.1, 1.0, 1), (3, 0.01, 0.9, 2), (4, 0.1, 0.9, 2)) tv(t, beta, phi, more), (VALUES (0, -1.0), (1, 0.05), (2, 0.3)) gv(g, gamma)),
  gd AS (SELECT id, CAST(alpha AS DOUBLE) AS alpha, CAST(beta AS DOUBLE) AS beta, CAST(phi AS DOUBLE) AS phi, CAST(gamma AS DOUBLE) AS gamma, size FROM gr)"""
_SMOOTH = f"""{sql.chained()}, {sql.SERIES}, {_GRID}, y AS (SELECT series, ln(level) AS y, row_number() OVER (PARTITION BY series ORDER BY period) AS k FROM series WHERE level > 0),
  nt AS (SELECT series, avg(y) FILTER (WHERE k <= 12) AS m1, avg(y) FILTER (WHERE k BETWEEN 13 AND 24) AS m2, list(y ORDER BY k) FILTER (WHERE k <= 12) AS ys, count(*) AS n FROM y GROUP BY 1),
  st AS (SELECT series, id, alpha, beta, phi, gamma, size, CAST(12 AS BIGINT) AS k, m1 + 5.5 * b0 AS l, b0 AS b, CASE WHEN gamma >= 0 THEN list_transform(ys, lambda x: x - m1) ELSE list_transform(ys, lambda x: CAST(0 AS DOUBLE)) END AS s, CAST(0 AS DOUBLE) AS sse, CAST(NULL AS DOUBLE) AS e
    FROM (SELECT *, CASE WHEN phi > 0 THEN (m2 - m1) / 12 ELSE CAST(0 AS DOUBLE) END AS b0 FROM nt, gd WHERE n >= 24)
    UNION ALL SELECT series, id, alpha, beta, phi, gamma, size, k, l + phi * b + alpha * ee, phi * b + beta * ee, list_transform(s, lambda x, i: CASE WHEN i = (k - 1) % 12 + 1 THEN x + greatest(gamma, 0) * ee ELSE x END), sse + ee * ee, ee
    FROM (SELECT st.* REPLACE (y.k AS k), y.y - (l + phi * b) - s[CAST((y.k - 1) % 12 + 1 AS INTEGER)] AS ee FROM st JOIN y ON y.series = st.series AND y.k = st.k + 1))"""
_ERRORS = f"""{_SMOOTH}, sc AS (SELECT *, (k - 12) * ln(greatest(sse, 1e-300) / (k - 12)) + 2 * size + CASE WHEN k - 12 - size - 1 > 0 THEN 2 * size * (size + 1) / (k - 12 - size - 1) ELSE 1e12 END AS score FROM st WHERE k >= 36),
  be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY series, k ORDER BY round(score, 9), id) = 1),
  er AS (SELECT be.series, be.k, h AS horizon, y.y - (l + CASE WHEN phi = 0 THEN 0 WHEN phi = 1 THEN h ELSE phi * (1 - pow(phi, h)) / (1 - phi) END * b + s[CAST((be.k + h - 1) % 12 + 1 AS INTEGER)]) AS e, y.y - z.y AS bm
    FROM be, (SELECT unnest(range(1, 13)) AS h) hs JOIN y ON y.series = be.series AND y.k = be.k + h JOIN y z ON z.series = be.series AND z.k = be.k + h - 12 * ceil(h / 12.0))"""


def oracle_sql() -> dict[str, str]:
    log = f"{sql.DWELLINGS}, q AS (SELECT property_id, period, stratum, ln(price) AS y, ln(floor_area) AS x, ln(appraisal) AS z, appraisal AS a, price FROM sales WHERE price > 0 AND floor_area > 0 AND appraisal > 0)"
    slopes = f"""{log}, pd AS (SELECT DISTINCT period FROM q), wn AS (SELECT period AS a, lead(period, 7) OVER (ORDER BY period) AS b FROM pd),
      cp AS (SELECT period, count(*) AS n, avg(z) AS mz, avg(y) AS my, sum(z * y) AS zy, sum(z * z) AS zz FROM q GROUP BY 1),
      sl AS (SELECT wn.a, wn.b, sum(zy - n * mz * my) / sum(zz - n * mz * mz) AS c FROM wn JOIN cp ON period BETWEEN wn.a AND wn.b WHERE wn.b IS NOT NULL GROUP BY 1, 2 HAVING sum(n) > 9)"""
    return {
        "hd_lambda": f"""WITH {log}, g AS (SELECT -2 + k * 0.02 AS p FROM (SELECT unnest(range(0, 201)) AS k)),
          t AS (SELECT p, a, y, CASE WHEN abs(p) < 1e-9 THEN y ELSE (exp(y * p) - 1) / p END AS v FROM q, g),
          l AS (SELECT p, -count(*) / 2.0 * ln((sum(v * v) - pow(sum(v), 2) / count(*) - pow(sum(a * v) - sum(a) * sum(v) / count(*), 2) / (sum(a * a) - pow(sum(a), 2) / count(*))) / count(*)) + (p - 1) * sum(y) AS ll FROM t GROUP BY 1)
          SELECT (SELECT count(*) FROM sales) AS n, round(CAST(arg_max(p, ll) AS DOUBLE), 6) AS power FROM l""",
        "hd_vif": f"WITH {log}, c AS (SELECT corr(x, z) AS r FROM q) SELECT name, round(1 / (1 - r * r), 6) AS vif FROM c, (VALUES ('floor_area'), ('appraisal')) v(name)",
        "hd_leverage": f"WITH {log}, m AS (SELECT count(*) AS n, avg(x) AS mx, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM q) SELECT property_id, period, round(1.0 / n + (x - mx) * (x - mx) / sxx, 9) AS leverage FROM q, m",
        "hd_stability": f"WITH {slopes} SELECT a AS \"first\", b AS \"last\", 'appraisal' AS name, round(c, 5) AS coefficient FROM sl",
        "hd_stability_range": f"WITH {slopes} SELECT 'appraisal' AS name, round(min(c), 5) AS least, round(max(c), 5) AS most, round(max(c) - min(c), 5) AS range FROM sl",
        "hd_absorbed_check": f"WITH {log} SELECT period, count(*) AS n, CAST(0 AS DOUBLE) AS residual FROM q GROUP BY 1",
        "fc_ets": f"WITH RECURSIVE {_ERRORS} SELECT series, CAST(horizon AS INTEGER) AS horizon, round(sqrt(avg(e * e)) * 100, 5) AS rmse, round(sqrt(avg(bm * bm)) * 100, 5) AS benchmark_rmse, count(*) AS n FROM er GROUP BY 1, 2",
        "pj_dm": f"""WITH RECURSIVE {_ERRORS}, d AS (SELECT series, horizon, k, bm * bm - e * e AS d FROM er), mn AS (SELECT series, horizon, avg(d) AS m, count(*) AS n FROM d GROUP BY 1, 2),
          c AS (SELECT d.series, d.horizon, d.k, d - m AS c, n, greatest(0, least(d.horizon - 1, n - 2)) AS lags, m FROM d JOIN mn ON d.series = mn.series AND d.horizon = mn.horizon),
          a AS (SELECT c.series, c.horizon, sum(c.c * o.c * CASE WHEN o.k = c.k THEN 1 ELSE 2 * (1 - (c.k - o.k) / (c.lags + 1)) END) AS v FROM c JOIN c o ON c.series = o.series AND c.horizon = o.horizon AND o.k <= c.k AND c.k - o.k <= c.lags GROUP BY 1, 2)
          SELECT mn.series, CAST(mn.horizon AS INTEGER) AS horizon, n, round(CASE WHEN n >= 3 AND v > 0 THEN m / sqrt(v / n / n) * CASE WHEN n + 1 - 2 * mn.horizon > 0 THEN sqrt((n + 1 - 2 * mn.horizon + mn.horizon * (mn.horizon - 1) / n) / n) ELSE 1 END END, 4) AS statistic
          FROM mn JOIN a ON mn.series = a.series AND mn.horizon = a.horizon""",
        "fc_diag": f"""WITH RECURSIVE {_SMOOTH}, r AS (SELECT series, k, e - avg(e) OVER (PARTITION BY series) AS c, count(*) OVER (PARTITION BY series) AS n FROM st WHERE id = 0 AND e IS NOT NULL),
          ac AS (SELECT a.series, a.k - b.k AS lag, sum(a.c * b.c) AS g FROM r a JOIN r b ON a.series = b.series AND a.k - b.k BETWEEN 0 AND 12 GROUP BY 1, 2),
          lb AS (SELECT x.series, sum(pow(x.g / z.g, 2) / (n - lag)) AS q FROM ac x JOIN (SELECT series, g FROM ac WHERE lag = 0) z ON x.series = z.series JOIN (SELECT DISTINCT series, n FROM r) c ON c.series = x.series WHERE lag > 0 GROUP BY 1),
          mo AS (SELECT series, max(n) AS n, avg(c * c) AS m2, avg(c * c * c) AS m3, avg(c * c * c * c) AS m4 FROM r GROUP BY 1)
          SELECT mo.series, n, round(n * (n + 2) * q, 4) AS ljung_box, round(n / 6 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 4) AS jarque_bera FROM mo JOIN lb ON mo.series = lb.series""",
    }
