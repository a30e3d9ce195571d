"""Queries for quality checks, unit faults, outlier screens and imputation."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from basketry.operators import quality
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels


def _repaired(s, d):
    return quality.repair_units(panels.faulty_panel(s, d))


def _gappy(s, d):
    """The sparse panel over all months of its items' categories is too wide; gaps come from the missing codes."""
    return quality.recode_missing(panels.faulty_panel(s, d)).drop("flag")


def _screen(function, s, d):
    return rounded(function(quality.price_relatives(panels.faulty_panel(s, d))))


def _imputed(method, s, d):
    p = quality.carry_forward(_gappy(s, d)) if method == "carry_forward" else quality.impute_by_movement(_gappy(s, d), method)
    return rounded(p.select("period", "category", "item_id", "price_clean", "price_imputed", "imputation"))


def _decided(s, d):
    p = panels.faulty_panel(s, d)
    relatives = quality.price_relatives(p)
    rejected = quality.ratio_screen(relatives).select("period", "item_id", F.lit("reject").alias("decision"))
    out = quality.apply_decisions(p, rejected)
    return out.groupBy("category").agg(F.count("*").alias("quotes"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.count("price_reviewed").alias("kept"))


SCREENS = {"out_tukey": quality.tukey_fences, "out_quartile": quality.quartile_screen, "out_hb": quality.hidiroglou_berthelot, "out_ratio": quality.ratio_screen}
METHODS = {"imp_carry": "carry_forward", "imp_class": "class_mean", "imp_targeted": "targeted_mean", "imp_overall": "overall_mean"}


def queries() -> dict:
    out = {k: partial(_screen, f) for k, f in SCREENS.items()}
    out |= {k: partial(_imputed, m) for k, m in METHODS.items()}
    return out | {
        "dq_recode": lambda s, d: quality.recode_missing(panels.faulty_panel(s, d)).groupBy("category", "flag").agg(F.count("*").alias("n"), F.count("price_clean").alias("priced")),
        "dq_scale": lambda s, d: rounded(_repaired(s, d).select("period", "item_id", "flag", "reference", "log10_deviation", "price_clean")),
        "dq_summary": lambda s, d: _repaired(s, d).groupBy(F.coalesce("flag", F.lit("none")).alias("flag")).agg(F.count("*").alias("n")),
        "dq_residual": lambda s, d: rounded(quality.residual_faults(_repaired(s, d)).select("period", "item_id", "price_clean", "deviation")),
        "dq_classify": lambda s, d: quality.classify_gaps(_gappy(s, d)),
        "out_relatives": lambda s, d: rounded(quality.price_relatives(panels.faulty_panel(s, d)).select("period", "item_id", "ratio", "log_ratio")),
        "out_queue": lambda s, d: quality.review_queue(quality.price_relatives(panels.faulty_panel(s, d))),
        "out_apply": _decided,
        "imp_response": lambda s, d: rounded(quality.response_rates(quality.impute_by_movement(_gappy(s, d)))),
        "imp_summary": lambda s, d: quality.impute_by_movement(_gappy(s, d)).groupBy(F.coalesce("imputation", F.lit("observed")).alias("method")).agg(F.count("price_imputed").alias("n")),
        "val_completeness": lambda s, d: rounded(quality.completeness(_gappy(s, d), ["price_clean", "quantity", "category"])),
        "val_structural": lambda s, d: quality.structure_checks(panels.faulty_panel(s, d)),
        "val_plausibility": lambda s, d: rounded(quality.implausible_prices(panels.faulty_panel(s, d), 50.0)),
        "val_expenditure": lambda s, d: rounded(quality.expenditure_gaps(panels.faulty_panel(s, d)).select("period", "item_id", "price", "expenditure")),
    }


CLEAN = f"{sql.FAULTY}, coded AS (SELECT *, CASE WHEN price = 0 THEN NULL ELSE price END AS pc FROM panel)"
FRAME = "(PARTITION BY item_id ORDER BY period ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)"
SCALE = f"""{CLEAN}, r AS (SELECT *, coalesce(CASE WHEN count(pc) OVER f >= 3 THEN quantile_cont(pc, 0.5) OVER f END, quantile_cont(pc, 0.5) OVER (PARTITION BY item_id)) AS ref FROM coded WINDOW f AS {FRAME}),
  dv AS (SELECT *, CASE WHEN pc > 0 AND ref > 0 THEN log10(pc / ref) END AS dev FROM r),
  fl AS (SELECT *, CASE WHEN price = 0 THEN 'missing_code' WHEN dev BETWEEN 1.5 AND 2.5 THEN 'x100' WHEN dev BETWEEN -2.5 AND -1.5 THEN 'div100' END AS flag FROM dv),
  rp AS (SELECT *, CASE flag WHEN 'x100' THEN pc / 100 WHEN 'div100' THEN pc * 100 ELSE pc END AS fixed FROM fl)"""
REL = f"""{sql.FAULTY}, pr AS (SELECT *, lag(price) OVER (PARTITION BY item_id ORDER BY period) AS b FROM panel WHERE price > 0),
  rel AS (SELECT *, price / b AS ratio, ln(price / b) AS lr FROM pr WHERE b IS NOT NULL)"""
CELL = "(PARTITION BY period, category)"
SCREEN_SQL = {
    "tukey": f"""SELECT period, category, item_id, 'tukey' AS method, ratio AS statistic FROM (SELECT *, quantile_cont(lr, 0.25) OVER c AS q1, quantile_cont(lr, 0.5) OVER c AS m, quantile_cont(lr, 0.75) OVER c AS q3, count(*) OVER c AS n FROM rel WINDOW c AS {CELL})
      WHERE n >= 5 AND q3 > q1 AND (lr < q1 - 1.5 * (q3 - q1) OR lr > q3 + 1.5 * (q3 - q1)) AND abs(exp(lr - m) - 1) * 100 > 5""",
    "quartile": f"""SELECT period, category, item_id, 'quartile' AS method, ratio AS statistic FROM (SELECT *, quantile_cont(ratio, 0.25) OVER c AS q1, quantile_cont(ratio, 0.5) OVER c AS m, quantile_cont(ratio, 0.75) OVER c AS q3, count(*) OVER c AS n FROM rel WINDOW c AS {CELL})
      WHERE n >= 5 AND ((m > q1 AND ratio < m - 2.5 * (m - q1)) OR (q3 > m AND ratio > m + 2.5 * (q3 - m))) AND abs(ratio / m - 1) * 100 > 5""",
    "hb": f"""SELECT period, category, item_id, 'hb' AS method, e AS statistic FROM (SELECT *, quantile_cont(e, 0.25) OVER c AS q1, quantile_cont(e, 0.5) OVER c AS m2, quantile_cont(e, 0.75) OVER c AS q3 FROM (
      SELECT *, CASE WHEN ratio < m THEN 1 - m / ratio ELSE ratio / m - 1 END * pow(greatest(price, b), 0.5) AS e FROM (SELECT *, quantile_cont(ratio, 0.5) OVER c AS m, count(*) OVER c AS n FROM rel WINDOW c AS {CELL})) WINDOW c AS {CELL})
      WHERE n >= 5 AND (e < m2 - 4 * greatest(m2 - q1, abs(0.05 * m2)) OR e > m2 + 4 * greatest(q3 - m2, abs(0.05 * m2)))""",
    "ratio": "SELECT period, category, item_id, 'ratio' AS method, ratio AS statistic FROM rel WHERE ratio < 0.5 OR ratio > 2",
}


def _movement_sql(cell: str, every: bool, stop: bool, name: str) -> str:
    grid = "coded" if every else "coded WHERE pc IS NOT NULL"
    same = " AND u = lu" if stop else ""
    return f"""{CLEAN}, cc AS (SELECT *, {cell} AS cell FROM coded), g0 AS (SELECT DISTINCT {cell} AS cell, period FROM {grid}),
      g AS (SELECT cell, period, lag(period) OVER (PARTITION BY cell ORDER BY period) AS before FROM g0),
      ch AS (SELECT g.cell, g.period, avg(ln(n.pc / t.pc)) AS f FROM g JOIN cc n ON n.cell = g.cell AND n.period = g.period JOIN cc t ON t.cell = g.cell AND t.period = g.before AND t.item_id = n.item_id WHERE n.pc > 0 AND t.pc > 0 GROUP BY 1, 2),
      mv AS (SELECT g.cell, g.period, sum(coalesce(f, 0)) OVER w AS total, sum(CASE WHEN before IS NOT NULL AND f IS NULL THEN 1 ELSE 0 END) OVER w AS u FROM g LEFT JOIN ch ON g.cell = ch.cell AND g.period = ch.period WINDOW w AS (PARTITION BY g.cell ORDER BY g.period)),
      j AS (SELECT cc.*, total, u, last_value(CASE WHEN pc IS NOT NULL THEN struct_pack(p := pc, t := total, u := u) END IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY cc.period ROWS UNBOUNDED PRECEDING) AS l FROM cc LEFT JOIN mv ON cc.cell = mv.cell AND cc.period = mv.period),
      k AS (SELECT *, l.u AS lu, l.p * exp(total - l.t) AS fill FROM j),
      imp AS (SELECT period, category, item_id, pc, coalesce(pc, CASE WHEN TRUE{same} THEN fill END) AS pi, CASE WHEN pc IS NULL AND fill IS NOT NULL{same} THEN '{name}' END AS how FROM k)"""


def oracle_sql() -> dict[str, str]:
    out = {f"out_{k}": f"WITH {REL}, z AS ({q}) SELECT period, category, item_id, method, round(statistic, 6) AS statistic FROM z" for k, q in SCREEN_SQL.items()}
    union = " UNION ALL ".join(SCREEN_SQL.values())
    cols = "period, category, item_id, round(pc, 6) AS price_clean, round(pi, 6) AS price_imputed, how AS imputation"
    classes = _movement_sql("category", True, True, "class_mean")
    return out | {
        "imp_carry": f"""WITH {CLEAN}, imp AS (SELECT *, last_value(pc IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS pi FROM coded)
          SELECT period, category, item_id, round(pc, 6) AS price_clean, round(pi, 6) AS price_imputed, CASE WHEN pc IS NULL AND pi IS NOT NULL THEN 'carry_forward' END AS imputation FROM imp""",
        "imp_class": f"WITH {classes} SELECT {cols} FROM imp",
        "imp_targeted": f"WITH {_movement_sql('category', False, False, 'targeted_mean')} SELECT {cols} FROM imp",
        "imp_overall": f"WITH {_movement_sql(repr('all'), False, False, 'overall_mean')} SELECT {cols} FROM imp",
        "imp_response": f"""WITH {classes} SELECT category, period, count(*) AS expected, count(pc) AS observed, count(how) AS imputed, count(*) - count(pi) AS missing, round(count(pc) / count(*), 6) AS response_rate,
          round(count(how) / nullif(count(pc) + count(how), 0), 6) AS imputed_share FROM imp GROUP BY 1, 2""",
        "imp_summary": f"WITH {classes} SELECT coalesce(how, 'observed') AS method, count(pi) AS n FROM imp GROUP BY 1",
        "dq_recode": f"WITH {CLEAN} SELECT category, CASE WHEN price = 0 THEN 'missing_code' END AS flag, count(*) AS n, count(pc) AS priced FROM coded GROUP BY 1, 2",
        "dq_scale": f"WITH {SCALE} SELECT period, item_id, flag, round(ref, 6) AS reference, round(dev, 6) AS log10_deviation, round(fixed, 6) AS price_clean FROM rp",
        "dq_summary": f"WITH {SCALE} SELECT coalesce(flag, 'none') AS flag, count(*) AS n FROM rp GROUP BY 1",
        "dq_residual": f"""WITH {SCALE}, a AS (SELECT period, item_id, fixed, coalesce(CASE WHEN count(fixed) OVER f >= 3 THEN quantile_cont(fixed, 0.5) OVER f END, quantile_cont(fixed, 0.5) OVER (PARTITION BY item_id)) AS r2 FROM rp WINDOW f AS {FRAME})
          SELECT period, item_id, round(fixed, 6) AS price_clean, round(log10(fixed / r2), 6) AS deviation FROM a WHERE abs(log10(fixed / r2)) > 0.5""",
        "dq_classify": f"""WITH {CLEAN}, c AS (SELECT category, period, avg(CASE WHEN pc IS NULL THEN 1.0 ELSE 0 END) AS m FROM coded GROUP BY 1, 2),
          g AS (SELECT category, count(*) FILTER (WHERE m >= 0.8) AS systemic, count(DISTINCT CASE WHEN m >= 0.8 THEN year(period) END) AS hy, count(DISTINCT CASE WHEN m >= 0.8 THEN month(period) END) AS hm, count(DISTINCT year(period)) AS y FROM c GROUP BY 1)
          SELECT category, systemic, CASE WHEN systemic > 0 AND hy >= greatest(2.0, 0.6 * y) AND hm <= 8 THEN 'seasonal' WHEN systemic > 0 THEN 'collection' ELSE 'sporadic' END AS kind FROM g""",
        "out_relatives": f"WITH {REL} SELECT period, item_id, round(ratio, 6) AS ratio, round(lr, 6) AS log_ratio FROM rel",
        "out_queue": f"WITH {REL}, z AS ({union}) SELECT period, category, item_id, string_agg(DISTINCT method, ', ' ORDER BY method) AS methods, count(DISTINCT method) AS n_methods FROM z GROUP BY 1, 2, 3",
        "out_apply": f"""WITH {REL}, z AS (SELECT period AS p2, item_id AS i2 FROM rel WHERE ratio < 0.5 OR ratio > 2)
          SELECT category, count(*) AS quotes, count(p2) AS rejected, count(*) FILTER (WHERE p2 IS NULL AND price IS NOT NULL) AS kept FROM panel LEFT JOIN z ON period = p2 AND item_id = i2 GROUP BY 1""",
        "val_completeness": f"""WITH {CLEAN}, s AS (SELECT 'price_clean' AS "column", avg(CASE WHEN pc IS NULL THEN 1.0 ELSE 0 END) AS n FROM coded UNION ALL SELECT 'quantity', avg(CASE WHEN quantity IS NULL THEN 1.0 ELSE 0 END) FROM coded UNION ALL SELECT 'category', avg(CASE WHEN category IS NULL THEN 1.0 ELSE 0 END) FROM coded)
          SELECT "column", round(n, 6) AS null_share, CASE WHEN n > 0.5 THEN 'critical' WHEN n > 0 THEN 'high' ELSE 'ok' END AS severity FROM s""",
        "val_structural": f"""WITH {sql.FAULTY} SELECT 'duplicate_quotes' AS "check", (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY period, item_id HAVING count(*) > 1)) AS n
          UNION ALL SELECT 'negative_price', count(*) FILTER (WHERE price < 0) FROM panel UNION ALL SELECT 'negative_quantity', count(*) FILTER (WHERE quantity < 0) FROM panel
          UNION ALL SELECT 'thin_cells', (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY category, period HAVING count(*) < 2)) UNION ALL SELECT 'several_categories', (SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY item_id HAVING count(DISTINCT category) > 1))""",
        "val_plausibility": f"""WITH {sql.FAULTY}, m AS (SELECT item_id AS i2, quantile_cont(price, 0.5) AS med FROM panel WHERE price > 0 GROUP BY 1)
          SELECT period, item_id, round(price, 6) AS price, round(med, 6) AS median FROM panel JOIN m ON item_id = i2 WHERE price > 0 AND (price > 50 * med OR price < med / 50)""",
        "val_expenditure": f"WITH {sql.FAULTY} SELECT period, item_id, round(price, 6) AS price, round(expenditure, 6) AS expenditure FROM panel WHERE abs(expenditure - price * quantity) > 0.01 * abs(expenditure)",
    }
