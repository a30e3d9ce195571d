"""Queries for revisions, contributions across a link, sticky prices and ranked findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.formulas import ELEMENTARY
from basketry.operators import decompose, governance, index, quality, seasonal
from basketry.plans import domain as shared
from basketry.plans import screening, seasons, sql
from basketry.plans.rounding import rounded
from basketry.sources import panels


def _ribe(s, d):
    components, weights = seasons._components(s, d), seasons._year_weights(s, d)
    return rounded(governance.annual_contributions(components, weights, seasonal.chain_linked(components, weights)))


def _sticky(s, d):
    p = panels.dense_panel(s, d)
    kept = governance.sticky(decompose.change_frequency(p), 0.5).select("category")
    return rounded(index.weighted_all_items(index.chained_index(p).join(kept, "category", "left_semi"), index.category_weights(p).join(kept, "category", "left_semi")))


def _findings(s, d):
    repaired = quality.repair_units(panels.faulty_panel(s, d))
    faults = repaired.groupBy("flag").agg(F.count("*").alias("n"))
    return rounded(governance.findings(index.year_on_year(index.all_series(panels.dense_panel(s, d))), faults, quality.classify_gaps(repaired)), 4)


def _effect(s, d):
    """The last level of All items with quotes as reported, as repaired, and as they are."""
    raw, fixed, clean = panels.faulty_panel(s, d), quality.repair_units(panels.faulty_panel(s, d)), panels.dense_panel(s, d)

    def last(p, price, name):
        total = index.geometric_all_items(index.chained_index(p, price=price))
        return total.agg(F.max_by("index", "period").alias(name))

    return rounded(last(raw, "price", "reported").join(F.broadcast(last(fixed, "price_clean", "repaired"))).join(F.broadcast(last(clean, "price", "clean"))), 4)  # one row each


def queries() -> dict:
    return {
        "dc_ribe": _ribe,
        "dc_sticky": _sticky,
        "rv_pubcur": lambda s, d: rounded(governance.published_and_current(shared._vintages(s, d))),
        "rv_bias": lambda s, d: rounded(governance.revision_bias(shared._vintages(s, d))),
        "in_findings": _findings,
        "pipe_effect": _effect,
    }


def _vintage_sql() -> str:
    """vt: vintage, period, value of All items as compiled at the end of four years."""
    parts = []
    for v in (1997, 1998, 1999, 2000):
        seen = f"panel AS (SELECT * FROM (WITH {sql.DENSE} SELECT * FROM panel) WHERE year(period) <= {v})"
        parts.append(f"SELECT {v} AS vintage, period, exp(avg(ln(level))) AS value FROM (WITH {sql.chained(ELEMENTARY['dutot' if v < 1999 else 'jevons'], seen)} SELECT period, level FROM ix) GROUP BY period")
    return f"vt AS ({' UNION ALL '.join(parts)})"


def _last_sql(panel: str) -> str:
    """The last level of All items of a panel."""
    return f"(SELECT v FROM (WITH {sql.chained(panel=panel)} SELECT period, exp(avg(ln(level))) AS v FROM ix GROUP BY 1) ORDER BY period DESC LIMIT 1)"


GAPPED = f"""{sql.SPARSE}, spn AS (SELECT category, item_id, min(period) AS a, max(period) AS b FROM panel WHERE price > 0 GROUP BY 1, 2), pds AS (SELECT DISTINCT category, period FROM panel),
  coded AS (SELECT p.category, s.item_id, p.period, CASE WHEN x.price > 0 THEN x.price END AS pc FROM spn s JOIN pds p ON p.category = s.category AND p.period BETWEEN a AND b LEFT JOIN panel x ON x.category = s.category AND x.item_id = s.item_id AND x.period = p.period)"""


def oracle_sql() -> dict[str, str]:
    chain = sql.chained(panel=sql.SPARSE)
    repaired = f"panel AS (SELECT period, category, item_id, expenditure, quantity, fixed AS price FROM (WITH {screening.SCALE} SELECT * FROM rp))"
    filled = screening._movement_sql("category", False, False, "counter_seasonal").replace(screening.CLEAN, GAPPED)
    linked = f"""{chain}, yw AS (SELECT category, year(period) + 1 AS y, sum(expenditure) AS w FROM panel GROUP BY 1, 2),
      sh AS (SELECT category, y, w, w / sum(w) OVER (PARTITION BY y) AS s FROM yw),
      dl AS (SELECT category, year(period) AS dy, level AS link FROM ix WHERE month(period) = 12),
      wi AS (SELECT year(ix.period) AS y, ix.period, sum(w * level / link) / sum(w) AS ratio FROM ix JOIN dl ON ix.category = dl.category AND year(ix.period) = dl.dy + 1 JOIN yw ON ix.category = yw.category AND year(ix.period) = yw.y GROUP BY 1, 2),
      ye AS (SELECT a.y, exp(sum(coalesce(ln(b.ratio), 0)) OVER (ORDER BY a.y)) AS start FROM (SELECT DISTINCT y FROM wi) a LEFT JOIN wi b ON b.y + 1 = a.y AND month(b.period) = 12),
      ag AS (SELECT wi.period, year(wi.period) AS y, 100 * start * ratio AS a FROM wi JOIN ye ON wi.y = ye.y)"""
    return {
        "rv_triangle": f"WITH {_vintage_sql()} SELECT period, vintage, round(value, 6) AS value, round(value - lag(value) OVER (PARTITION BY period ORDER BY vintage), 6) AS revision FROM vt",
        "rv_pubcur": f"WITH {_vintage_sql()}, p AS (SELECT period, min_by(value, vintage) AS a, max_by(value, vintage) AS b FROM vt WHERE value IS NOT NULL GROUP BY 1) SELECT period, round(a, 6) AS published, round(b, 6) AS current, round(b - a, 6) AS revision FROM p",
        "pipe_effect": f"SELECT round({_last_sql(sql.FAULTY)}, 4) AS reported, round({_last_sql(repaired)}, 4) AS repaired, round({_last_sql(sql.DENSE)}, 4) AS clean",
        "sc_build": f"""WITH {sql.chained()}, {sql.SERIES}, b AS (SELECT series, level, row_number() OVER (PARTITION BY series ORDER BY period DESC) - 1 AS back FROM series), e AS (SELECT series, max(CASE WHEN back = 0 THEN level END) AS y0, max(CASE WHEN back = 11 THEN level END) AS y11 FROM b GROUP BY 1),
          p AS (SELECT b.series, step, level * pow(y0 / y11, (step - 1) // 12 + 1) AS base FROM (SELECT unnest(range(1, 25)) AS step) JOIN b ON back = 11 - (step - 1) % 12 JOIN e ON e.series = b.series)
          SELECT series, CAST(step AS INTEGER) AS step, round(base, 6) AS baseline, round(base * exp(ln(1.1) * 0.3 * least(step / 6.0, 1)), 6) AS scenario FROM p""",
        "se_counter": f"WITH {filled} SELECT category, period, count(*) AS n, round(avg(pi), 6) AS mean FROM imp WHERE how IS NOT NULL GROUP BY 1, 2",
        "in_findings": f"""WITH y AS (WITH {sql.chained()}, {sql.SERIES} SELECT series, period, (level / lag(level, 12) OVER (PARTITION BY series ORDER BY period) - 1) * 100 AS yoy FROM series),
          l AS (SELECT series, max_by(yoy, period) AS yoy FROM y WHERE yoy IS NOT NULL GROUP BY 1), f AS (WITH {screening.SCALE} SELECT flag, count(*) AS n FROM rp WHERE flag IN ('x100', 'div100') GROUP BY 1),
          g AS (WITH {screening.CLEAN}, c AS (SELECT category, period, avg(CASE WHEN pc IS NULL THEN 1.0 ELSE 0 END) AS m FROM coded GROUP BY 1, 2), k AS (SELECT category, count(*) FILTER (WHERE m >= 0.8) AS systemic, count(DISTINCT CASE WHEN m >= 0.8 THEN year(period) END) AS hy, count(DISTINCT CASE WHEN m >= 0.8 THEN month(period) END) AS hm, count(DISTINCT year(period)) AS y FROM c GROUP BY 1)
            SELECT category, systemic, CASE WHEN hy >= greatest(2.0, 0.6 * y) AND hm <= 8 THEN 'seasonal' ELSE 'collection' END AS kind FROM k WHERE systemic > 0)
          SELECT 'trend' AS topic, series AS subject, round(abs(yoy), 4) AS importance, printf('%s fell by %.1f %% on the year', series, abs(yoy)) AS text FROM l WHERE yoy < 0
          UNION ALL SELECT 'quality', flag, round(10 + log10(n), 4), printf('%d quotes look %s', n, CASE flag WHEN 'x100' THEN 'a hundred times too high' ELSE 'a hundred times too low' END) FROM f
          UNION ALL SELECT 'quality', category, round(5 + systemic, 4), printf('%s lacks prices in %d periods (%s)', category, systemic, kind) FROM g""",
        "dc_ribe": f"""WITH {linked}, j AS (SELECT ix.category, ix.period, ix.level AS i, p.level AS i12, l1.link AS l1, l0.link AS l0, w1.s AS w1, w0.s AS w0, a1.a AS a1, a0.a AS a0, ap.a AS a12
          FROM ix JOIN ix p ON p.category = ix.category AND p.period = ix.period - INTERVAL 12 MONTH JOIN dl l1 ON l1.category = ix.category AND l1.dy = year(ix.period) - 1 JOIN dl l0 ON l0.category = ix.category AND l0.dy = year(ix.period) - 2
          JOIN sh w1 ON w1.category = ix.category AND w1.y = year(ix.period) JOIN sh w0 ON w0.category = ix.category AND w0.y = year(ix.period) - 1
          JOIN ag a1 ON a1.y = year(ix.period) - 1 AND month(a1.period) = 12 JOIN ag a0 ON a0.y = year(ix.period) - 2 AND month(a0.period) = 12 JOIN ag ap ON ap.period = ix.period - INTERVAL 12 MONTH),
          k AS (SELECT category AS component, period, 100 * a1 / a12 * w1 * (i - l1) / l1 AS s, 100 * a0 / a12 * w0 * (l1 - i12) / l0 AS b FROM j)
          SELECT component, period, round(s, 6) AS since_link, round(b, 6) AS before_link, round(s + b, 6) AS contribution FROM k""",
        "dc_sticky": f"""WITH {sql.chained()}, {sql.WEIGHTS}, g AS (SELECT category, price, lag(price) OVER w AS p1, date_diff('month', lag(period) OVER w, period) AS gap FROM panel WHERE price > 0 WINDOW w AS (PARTITION BY item_id ORDER BY period)),
          f AS (SELECT category, count(*) AS n, count(*) FILTER (WHERE abs(price - p1) > 1e-9) AS c FROM g WHERE gap = 1 GROUP BY 1),
          k AS (SELECT category FROM f WHERE CASE WHEN c < n THEN -1 / ln(1 - c / n) > 0.5 ELSE TRUE END)
          SELECT period, round(sum(weight * level) / (SELECT sum(weight) FROM wt WHERE category IN (SELECT category FROM k)), 6) AS "index" FROM ix JOIN wt USING (category) WHERE category IN (SELECT category FROM k) GROUP BY 1""",
    }
