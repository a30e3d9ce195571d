"""Queries for elementary, bilateral and compiled indices, aggregation and decomposition."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from basketry.functions.formulas import BILATERAL, ELEMENTARY
from basketry.operators import decompose, index, multilateral
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels
from basketry.sources.staging import staged


def _dense(spark, d):
    """The dense panel, written once: pairing reads it from several sides."""
    return staged(panels.dense_panel(spark, d), "dense")


def _sparse(spark, d):
    return staged(panels.sparse_panel(spark, d), "sparse")


def _links(name, spark, d):
    df = index.links(_dense(spark, d), name).filter("link is not null")
    return rounded(df.select("category", "period", F.col("link").alias("value"), F.col("matched").alias("n_items")))


def _bilateral(name, spark, d):
    return rounded(index.bilateral(_dense(spark, d), name))


def _index(spark, d, name="jevons"):
    return index.chained_index(_dense(spark, d), name)


def _components(spark, d):
    p = _dense(spark, d)
    return index.chained_index(p).select(F.col("category").alias("component"), "period", "index"), index.category_weights(p).withColumnRenamed("category", "component")


def _series(spark, d):
    return index.all_series(_dense(spark, d))


def _total(spark, d):
    return _series(spark, d).filter("series = 'All items'")


def _tree_change(spark, d):
    p = _dense(spark, d)
    return rounded(decompose.tree_levels(p, panels.type_tree(spark, d)))


def queries() -> dict:
    out = {f"el_{n}": partial(_links, n) for n in ELEMENTARY}
    out |= {f"bi_{n}": partial(_bilateral, n) for n in BILATERAL}
    out |= {
        "ix_build": lambda s, d: rounded(_index(s, d)),
        "ix_build_fixed": lambda s, d: rounded(index.fixed_base_index(_dense(s, d))),
        "ix_build_sparse": lambda s, d: rounded(index.chained_index(_sparse(s, d))),
        "ix_build_all": lambda s, d: rounded(_series(s, d)),
        "ix_weights": lambda s, d: rounded(index.category_weights(_dense(s, d)), 4),
        "ix_weighted_all": lambda s, d: rounded(index.all_series(_dense(s, d), weighted=True)),
        "ix_yoy": lambda s, d: rounded(index.year_on_year(_series(s, d)).select("series", "period", "yoy")),
        "ix_annualised": lambda s, d: rounded(index.annualised(_series(s, d))),
        "ix_tornqvist": lambda s, d: rounded(_index(s, d, "tornqvist")),
        "sp_rebase": lambda s, d: rounded(index.rebase(_series(s, d), F.to_date(F.lit("1997-01-01")))),
        "sp_splice": lambda s, d: rounded(index.splice(_series(s, d), index.all_series(_dense(s, d), "tornqvist"), F.to_date(F.lit("1998-01-01")))),
        "sp_drift_table": lambda s, d: rounded(index.chain_drift(_dense(s, d))),
        "ag_geo": lambda s, d: rounded(_total(s, d).select("period", "index")),
        "ag_weighted": lambda s, d: rounded(index.weighted_all_items(_index(s, d), index.category_weights(_dense(s, d)))),
        "ag_tree": _tree_change,
        "ag_contrib": lambda s, d: rounded(decompose.contributions(*_components(s, d), start="1996-01-01", end="1998-01-01")),
        "dc_rates": lambda s, d: rounded(decompose.rates(_series(s, d))),
        "dc_over_time": lambda s, d: rounded(decompose.contributions_over_time(*_components(s, d), horizon=12)),
        "dc_exclusion": lambda s, d: rounded(decompose.exclusion(*_components(s, d), exclude=["PROMO"])),
        "dc_trim": lambda s, d: rounded(decompose.trimmed_mean(*_components(s, d))),
        "dc_wmedian": lambda s, d: rounded(decompose.weighted_median(*_components(s, d))),
        "dc_varw": lambda s, d: rounded(decompose.variance_weighted(*_components(s, d))),
        "dc_base": lambda s, d: rounded(decompose.base_effects(_total(s, d))),
        "dc_diffusion": lambda s, d: rounded(decompose.diffusion(*_components(s, d))),
        "dc_dispersion": lambda s, d: rounded(decompose.dispersion(*_components(s, d)), 5),
        "dc_freq": lambda s, d: rounded(decompose.change_frequency(_dense(s, d))),
        "ml_pairs": lambda s, d: rounded(multilateral.log_pairs(_dense(s, d))),
        "ml_geks": lambda s, d: rounded(multilateral.geks(_dense(s, d))),
        "ml_geks_tornqvist": lambda s, d: rounded(multilateral.geks(_sparse(s, d), "tornqvist")),
        "ml_tpd": lambda s, d: rounded(multilateral.time_product_dummy(panels.sparse_panel(s, d))),
        "ml_wtpd": lambda s, d: rounded(multilateral.time_product_dummy(panels.sparse_panel(s, d), weighted=True)),
        "ml_gk": lambda s, d: rounded(multilateral.geary_khamis(panels.sparse_panel(s, d))),
        "ml_extend": lambda s, d: rounded(multilateral.extend(_dense(s, d), window=13, splice="mean")),
    }
    return out


def _rounded(sql_columns: str, ctes: str, tail: str) -> str:
    return f"WITH {ctes} SELECT {sql_columns} FROM {tail}"


def oracle_sql() -> dict[str, str]:
    r = "round({}, 6) AS {}".format
    chain, cols = sql.chained(), "category, period, "
    out = {f"el_{n}": f"WITH {sql.DENSE}, {sql.LINKED}, {sql.pairs(False)} SELECT {cols}round({e}, 6) AS value, count(*) AS n_items FROM pairs GROUP BY 1, 2" for n, e in ELEMENTARY.items()}
    ref = "ref AS (SELECT p.category AS c2, p.item_id AS i2, quantity AS qb, expenditure AS sb FROM panel p JOIN linked l ON p.category = l.category AND p.period = l.period WHERE l.rank = 2)"
    for n, e in BILATERAL.items():
        join = " JOIN ref ON category = c2 AND item_id = i2" if n in ("lowe", "young", "price_updating_effect") else ""
        out[f"bi_{n}"] = f"WITH {sql.DENSE}, {sql.LINKED}, {sql.pairs(True)}, {ref} SELECT {cols}round({e}, 6) AS value, count(*) AS n_items FROM pairs{join} GROUP BY 1, 2"
    from basketry.functions.formulas import BILATERAL as B

    torn = sql.chained(B["tornqvist"])
    ser = f"{chain}, {sql.SERIES}"
    lvl = r("level", '"index"')
    comp = f"{chain}, {sql.WEIGHTS}, c AS (SELECT category AS component, period, level, weight FROM ix JOIN wt USING (category))"
    chg = f"""{comp}, e AS (SELECT component, period, level, weight, lag(level, 1) OVER w AS before FROM c WINDOW w AS (PARTITION BY component ORDER BY period)),
      x AS (SELECT component, period, (level / before - 1) * 100 AS change, weight * before AS ew, weight FROM e WHERE before IS NOT NULL)"""
    ranked = f"""{chg}, s AS (SELECT period, change, ew, component, ew / sum(ew) OVER (PARTITION BY period) AS share FROM x),
      k AS (SELECT period, change, share, sum(share) OVER (PARTITION BY period ORDER BY change, component) AS upper FROM s)"""
    out |= {
        "ix_build": f"WITH {chain} SELECT category, period, {lvl}, matched FROM ix",
        "ix_build_fixed": f"WITH {sql.DENSE}, {sql.FIXED} SELECT category, period, {lvl}, matched FROM fx",
        "ix_build_sparse": f"WITH {sql.chained(panel=sql.SPARSE)} SELECT category, period, {lvl}, matched FROM ix",
        "ix_build_all": f"WITH {ser} SELECT series, period, {lvl} FROM series",
        "ix_weights": f"WITH {sql.DENSE}, {sql.WEIGHTS} SELECT category, round(weight, 4) AS weight FROM wt",
        "ix_weighted_all": f"WITH {chain}, {sql.WEIGHTS}, {sql.TOTAL} SELECT category AS series, period, {lvl} FROM ix UNION ALL SELECT 'All items', period, round(level, 6) FROM total",
        "ix_yoy": f"WITH {ser} SELECT series, period, round((level / lag(level, 12) OVER (PARTITION BY series ORDER BY period) - 1) * 100, 6) AS yoy FROM series",
        "ix_annualised": f"WITH {ser} SELECT series, round((pow(max_by(level, period) / min_by(level, period), 365.25 / date_diff('day', min(period), max(period))) - 1) * 100, 6) AS rate FROM series GROUP BY 1",
        "ix_tornqvist": f"WITH {torn} SELECT category, period, {lvl}, matched FROM ix",
        "sp_rebase": f"WITH {ser} SELECT series, period, round(100 * level / max(CASE WHEN period = DATE '1997-01-01' THEN level END) OVER (PARTITION BY series), 6) AS \"index\" FROM series",
        "sp_splice": f"""WITH {ser}, t AS (WITH {torn}, {sql.SERIES} SELECT * FROM series),
          f AS (SELECT o.series, o.level / n.level AS k FROM series o JOIN t n ON o.series = n.series AND o.period = n.period WHERE o.period = DATE '1998-01-01')
          SELECT series, period, {lvl} FROM series WHERE period < DATE '1998-01-01' UNION ALL
          SELECT t.series, t.period, round(t.level * k, 6) FROM t JOIN f ON t.series = f.series WHERE t.period >= DATE '1998-01-01'""",
        "sp_drift_table": f"""WITH {chain}, d AS (WITH {sql.FIXED} SELECT * FROM fx),
          b AS (SELECT ix.category, ix.period, ix.level AS c, d.level AS x FROM ix JOIN d ON ix.category = d.category AND ix.period = d.period WHERE d.level IS NOT NULL),
          z AS (SELECT category, max_by(c, period) AS c, max_by(x, period) AS x FROM b GROUP BY 1)
          SELECT category, round(c, 6) AS chained, round(x, 6) AS direct, round(c - x, 6) AS drift_pp, round((c - x) / x * 100, 6) AS drift_pct, abs(c - x) > 1 AS flagged FROM z""",
        "ag_geo": f"WITH {ser} SELECT period, {lvl} FROM series WHERE series = 'All items'",
        "ag_weighted": f"WITH {chain}, {sql.WEIGHTS}, {sql.TOTAL} SELECT period, {lvl} FROM total",
        "ag_tree": f"""WITH {sql.DENSE}, b AS (SELECT category, item_id, min_by(price, period) AS p0, avg(expenditure) AS w FROM panel GROUP BY 1, 2),
          t AS (SELECT category, sum(w) AS tw FROM b GROUP BY 1), a AS (SELECT sum(w) AS aw FROM b),
          l AS (SELECT p.period, p.category, b.item_id, b.w, 100 * p.price / b.p0 AS i FROM panel p JOIN b ON p.item_id = b.item_id AND p.category = b.category)
          SELECT item_id AS code, period, round(i, 6) AS "index", round(w, 6) AS weight FROM l
          UNION ALL SELECT l.category, period, round(sum(w * i) / max(tw), 6), round(max(tw), 6) FROM l JOIN t ON l.category = t.category GROUP BY 1, 2
          UNION ALL SELECT 'all', period, round(sum(w * i) / max(aw), 6), round(max(aw), 6) FROM l, a GROUP BY period""",
        "ag_contrib": f"""WITH {comp}, s AS (SELECT component, weight, max(CASE WHEN period = DATE '1996-01-01' THEN level END) AS a, max(CASE WHEN period = DATE '1998-01-01' THEN level END) AS b FROM c GROUP BY 1, 2)
          SELECT component, round(weight * (b - a) / sum(weight * a) OVER () * 100, 6) AS contribution FROM s""",
        "dc_rates": f"""WITH {ser}, m AS (SELECT *, CASE WHEN count(level) OVER q = 3 THEN avg(level) OVER q END AS m3 FROM series WINDOW q AS (PARTITION BY series ORDER BY period ROWS 2 PRECEDING)),
          l AS (SELECT *, lag(level) OVER w AS l1, lag(level, 12) OVER w AS l12, lag(m3, 3) OVER w AS m33, first_value(level) OVER w AS f FROM m WINDOW w AS (PARTITION BY series ORDER BY period))
          SELECT series, period, round((level / l1 - 1) * 100, 6) AS pop, round((level / l12 - 1) * 100, 6) AS yoy, round((pow(level / l1, 12) - 1) * 100, 6) AS pop_annualised,
          round((m3 / m33 - 1) * 100, 6) AS three_month, round((pow(m3 / m33, 4) - 1) * 100, 6) AS three_month_annualised, round((level / f - 1) * 100, 6) AS cumulative FROM l""",
        "dc_over_time": f"""WITH {comp}, e AS (SELECT *, lag(level, 12) OVER (PARTITION BY component ORDER BY period) AS before FROM c)
          SELECT component, period, round(weight * (level - before) / sum(weight * before) OVER (PARTITION BY period) * 100, 6) AS contribution FROM e WHERE before IS NOT NULL""",
        "dc_exclusion": f"""WITH {comp}, t AS (SELECT period, sum(weight * level) / (SELECT sum(weight) FROM wt WHERE category <> 'PROMO') AS level FROM c WHERE component <> 'PROMO' GROUP BY 1)
          SELECT period, {lvl}, round((level / lag(level) OVER (ORDER BY period) - 1) * 100, 6) AS change FROM t""",
        "dc_trim": f"""WITH {ranked}, g AS (SELECT period, change, greatest(least(upper, 0.85) - greatest(upper - share, 0.15), 0) AS kept FROM k)
          SELECT period, round(sum(kept * change) / sum(kept), 6) AS change FROM g GROUP BY 1""",
        "dc_wmedian": f"""WITH {ranked}, g AS (SELECT *, lead(change) OVER (PARTITION BY period ORDER BY change, upper) AS nxt FROM k), h AS (SELECT period, min_by(struct_pack(c := change, n := nxt, u := upper), upper) AS m FROM g WHERE upper >= 0.5 - 1e-12 GROUP BY 1)
          SELECT period, round(CASE WHEN abs(m.u - 0.5) <= 1e-12 AND m.n IS NOT NULL THEN (m.c + m.n) / 2 ELSE m.c END, 6) AS change FROM h""",
        "dc_varw": f"""WITH {chg}, v AS (SELECT *, CASE WHEN count(change) OVER q = 24 THEN stddev_samp(change) OVER q END AS sd FROM x WINDOW q AS (PARTITION BY component ORDER BY period ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
          f AS (SELECT *, min(CASE WHEN sd > 0 THEN sd END) OVER (PARTITION BY period) AS least FROM v),
          g AS (SELECT period, change, weight / pow(CASE WHEN sd > 0 THEN sd ELSE least END, 2) AS vw FROM f WHERE sd IS NOT NULL)
          SELECT period, round(sum(vw * change) / sum(vw), 6) AS change FROM g WHERE vw IS NOT NULL GROUP BY 1""",
        "dc_base": f"""WITH {ser}, t AS (SELECT period, level, lag(level) OVER w AS l1, lag(level, 12) OVER w AS l12, lag(level, 13) OVER w AS l13 FROM series WHERE series = 'All items' WINDOW w AS (ORDER BY period))
          SELECT period, round((level / l12 - 1) * 100, 6) AS yoy, round((level / l12 - l1 / l13) * 100, 6) AS change, round((level / l12 - l1 / l12) * 100, 6) AS this_period, round((l1 / l12 - l1 / l13) * 100, 6) AS base_effect FROM t WHERE l13 IS NOT NULL""",
        "dc_diffusion": f"""WITH {chg} SELECT period, round(avg(CASE WHEN change > 0 THEN 1.0 ELSE 0 END), 6) AS rising, round(avg(CASE WHEN change = 0 THEN 1.0 ELSE 0 END), 6) AS unchanged, round(avg(CASE WHEN change < 0 THEN 1.0 ELSE 0 END), 6) AS falling,
          round(avg(CASE WHEN change > 0 THEN 1.0 WHEN change = 0 THEN 0.5 ELSE 0 END) * 100, 6) AS diffusion, round(sum(CASE WHEN change > 0 THEN weight ELSE 0 END) / sum(weight), 6) AS rising_weight FROM x GROUP BY 1""",
        "dc_dispersion": f"""WITH {chg}, m AS (SELECT *, sum(weight * change) OVER q / sum(weight) OVER q AS mean FROM x WINDOW q AS (PARTITION BY period)), s AS (SELECT period, max(mean) AS mean, sqrt(sum(weight * pow(change - mean, 2)) / sum(weight)) AS sd, sum(weight * pow(change - mean, 3)) / sum(weight) AS m3 FROM m GROUP BY 1)
          SELECT period, round(mean, 5) AS mean, round(sd, 5) AS sd, round(m3 / nullif(pow(sd, 3), 0), 5) AS skewness FROM s""",
        "dc_freq": f"""WITH {sql.DENSE}, g AS (SELECT category, price, lag(price) OVER w AS p1, date_diff('month', lag(period) OVER w, period) AS gap FROM panel WHERE price > 0 WINDOW w AS (PARTITION BY item_id ORDER BY period)),
          f AS (SELECT category, count(*) AS comparisons, count(*) FILTER (WHERE abs(price - p1) > 1e-9) AS changes FROM g WHERE gap = 1 GROUP BY 1)
          SELECT category, comparisons, changes, round(changes / comparisons, 6) AS frequency, round(CASE WHEN changes < comparisons THEN -1 / ln(1 - changes / comparisons) END, 6) AS duration FROM f""",
    }
    two = """t AS (SELECT a.period AS s, b.period AS t, sum(b.price * a.quantity) / sum(a.price * a.quantity) AS l, sum(b.price * b.quantity) / sum(a.price * b.quantity) AS p,
      0.5 * (sum(a.expenditure * ln(b.price / a.price)) / sum(a.expenditure) + sum(b.expenditure * ln(b.price / a.price)) / sum(b.expenditure)) AS tq, count(*) AS n
      FROM panel a JOIN panel b ON a.item_id = b.item_id AND a.period < b.period WHERE a.price > 0 AND b.price > 0 GROUP BY 1, 2 HAVING count(*) >= 2)"""
    geks = """, both_ AS (SELECT s, t, {0} AS r FROM t UNION ALL SELECT t, s, -({0}) FROM t UNION ALL SELECT DISTINCT period, period, 0.0 FROM panel),
      bridge AS (SELECT s FROM both_ GROUP BY s HAVING count(*) = (SELECT count(DISTINCT period) FROM panel)), f AS (SELECT min(period) AS t0 FROM panel)
      SELECT b.t AS period, round(100 * exp(avg(b.r - z.r)), 6) AS "index" FROM both_ b JOIN bridge ON bridge.s = b.s JOIN both_ z ON b.s = z.s, f WHERE z.t = f.t0 GROUP BY 1"""
    out["ml_pairs"] = f"WITH {sql.DENSE}, {two} SELECT s, t, round(0.5 * ln(l * p), 6) AS log_ratio, n AS matched FROM t"
    out["ml_geks"] = f"WITH {sql.DENSE}, {two}" + geks.format("0.5 * ln(l * p)")
    out["ml_geks_tornqvist"] = f"WITH {sql.SPARSE}, {two}" + geks.format("tq")
    return out
