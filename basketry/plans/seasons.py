"""Queries for seasonal treatments, chain linking, projections and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import index, seasonal
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels


def _components(s, d):
    return index.chained_index(panels.sparse_panel(s, d)).select(F.col("category").alias("component"), "period", "index")


def _treated(weights):
    return lambda s, d: rounded(seasonal.chained_aggregate(_components(s, d), weights(panels.sparse_panel(s, d))))


def _series(s, d):
    return index.all_series(panels.dense_panel(s, d))


def _year_weights(s, d):
    return panels.sparse_panel(s, d).groupBy(F.col("category").alias("component"), (F.year("period") + 1).alias("year")).agg(F.sum("expenditure").alias("weight"))


def _final(name, s, d):
    p = index.all_series(panels.dense_panel(s, d), name).groupBy("series").agg(F.max_by("index", "period").alias(name))
    return p


def _method(s, d):
    a = _final("jevons", s, d).join(_final("dutot", s, d), "series").join(_final("carli", s, d), "series")
    return rounded(a.withColumn("spread", F.greatest("jevons", "dutot", "carli") - F.least("jevons", "dutot", "carli")), 5)


def _unmatched(s, d):
    p = panels.dense_panel(s, d)
    naive = p.filter("price > 0").groupBy("category", "period").agg(F.avg("price").alias("m"))
    first = naive.groupBy("category").agg(F.min_by("m", "period").alias("m0"))
    n = naive.join(first, "category").select("category", "period", (100 * F.col("m") / F.col("m0")).alias("naive"))
    return rounded(index.chained_index(p).join(n, ["category", "period"]).select("category", "period", F.col("index").alias("matched_index"), "naive", (F.col("naive") - F.col("index")).alias("gap")))


def queries() -> dict:
    return {
        "se_confine": _treated(seasonal.constant_weights),
        "se_update": _treated(seasonal.in_season_weights),
        "se_counter": lambda s, d: rounded(seasonal.counter_seasonal(panels.sparse_panel(s, d)).filter("imputation is not null").groupBy("category", "period").agg(F.count("*").alias("n"), F.avg("price_imputed").alias("mean"))),
        "se_adjust": lambda s, d: rounded(seasonal.adjust(_series(s, d))),
        "dc_chain_agg": lambda s, d: rounded(seasonal.chain_linked(_components(s, d), _year_weights(s, d))),
        "fc_naive": lambda s, d: rounded(seasonal.naive_backtest(_series(s, d))),
        "sc_build": lambda s, d: rounded(seasonal.scenario_path(_series(s, d), 10.0, 0.3, 6)),
        "dg_method": _method,
        "dg_unmatched": _unmatched,
    }


def oracle_sql() -> dict[str, str]:
    chain = sql.chained(panel=sql.SPARSE)
    item = "iw AS (SELECT category, item_id, avg(expenditure) AS w FROM panel GROUP BY 1, 2)"
    treat = """, rl AS (SELECT category, period, level / lag(level) OVER (PARTITION BY category ORDER BY period) AS r FROM ix),
      lks AS (SELECT rl.period, sum(x.w * r) / sum(x.w) AS link FROM rl JOIN x ON rl.category = x.category AND rl.period = x.period WHERE r IS NOT NULL AND x.w > 0 GROUP BY 1)
      SELECT g.period, round(100 * exp(sum(coalesce(ln(link), 0)) OVER (ORDER BY g.period)), 6) AS "index" FROM (SELECT DISTINCT period FROM ix) g LEFT JOIN lks ON g.period = lks.period"""
    dense = f"{sql.chained()}, {sql.SERIES}"
    final = "f_{1} AS (WITH {0}, {2} SELECT series, max_by(level, period) AS v FROM series GROUP BY 1)"
    from basketry.functions.formulas import ELEMENTARY as E

    return {
        "se_confine": f"WITH {chain}, {item}, cw AS (SELECT category, sum(w) AS w FROM iw GROUP BY 1), x AS (SELECT DISTINCT panel.category, period, cw.w FROM panel JOIN cw ON panel.category = cw.category){treat}",
        "se_update": f"WITH {chain}, {item}, x AS (SELECT panel.category, period, sum(iw.w) AS w FROM panel JOIN iw ON panel.category = iw.category AND panel.item_id = iw.item_id WHERE price > 0 GROUP BY 1, 2){treat}",
        "dc_chain_agg": f"""WITH {chain}, yw AS (SELECT category, year(period) + 1 AS y, sum(expenditure) AS w FROM panel GROUP BY 1, 2),
          dl AS (SELECT category, year(period) + 1 AS y, level AS link FROM ix WHERE month(period) = 12),
          wi AS (SELECT year(ix.period) AS y, ix.period, sum(w * level / link) / sum(w) AS ratio FROM ix JOIN dl ON ix.category = dl.category AND year(ix.period) = dl.y JOIN yw ON ix.category = yw.category AND year(ix.period) = yw.y GROUP BY 1, 2),
          ye AS (SELECT a.y, exp(sum(coalesce(ln(b.ratio), 0)) OVER (ORDER BY a.y)) AS start FROM (SELECT DISTINCT y FROM wi) a LEFT JOIN wi b ON b.y + 1 = a.y AND month(b.period) = 12)
          SELECT wi.period, round(100 * start * ratio, 6) AS "index" FROM wi JOIN ye ON wi.y = ye.y""",
        "fc_naive": f"""WITH {dense}, h AS (SELECT unnest(generate_series(1, 12)) AS horizon), o AS (SELECT series, level, row_number() OVER (PARTITION BY series ORDER BY period) AS k FROM series),
          e AS (SELECT a.series, 'random_walk' AS method, horizon, ln(a.level) - ln(b.level) AS e FROM o a, h, o b WHERE b.series = a.series AND b.k = a.k - horizon
            UNION ALL SELECT a.series, 'seasonal_naive', horizon, ln(a.level) - ln(b.level) FROM o a, h, o b WHERE b.series = a.series AND b.k = a.k - 12)
          SELECT series, method, CAST(horizon AS INT) AS horizon, round(sqrt(avg(e * e)) * 100, 6) AS rmse, count(*) AS n FROM e GROUP BY 1, 2, 3""",
        "dg_method": f"""WITH {final.format(sql.chained(E['jevons']), 'j', sql.SERIES)}, {final.format(sql.chained(E['dutot']), 'd', sql.SERIES)}, {final.format(sql.chained(E['carli']), 'c', sql.SERIES)}
          SELECT f_j.series, round(f_j.v, 5) AS jevons, round(f_d.v, 5) AS dutot, round(f_c.v, 5) AS carli, round(greatest(f_j.v, f_d.v, f_c.v) - least(f_j.v, f_d.v, f_c.v), 5) AS spread FROM f_j JOIN f_d ON f_j.series = f_d.series JOIN f_c ON f_j.series = f_c.series""",
        "dg_unmatched": f"""WITH {sql.chained()}, n AS (SELECT category, period, avg(price) AS m FROM panel WHERE price > 0 GROUP BY 1, 2), z AS (SELECT *, first_value(m) OVER (PARTITION BY category ORDER BY period) AS m0 FROM n)
          SELECT ix.category, ix.period, round(level, 6) AS matched_index, round(100 * m / m0, 6) AS naive, round(100 * m / m0 - level, 6) AS gap FROM ix JOIN z ON ix.category = z.category AND ix.period = z.period""",
    }
