"""Queries for sampling intervals, methodological sensitivity and vintages of repeat-sales indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.formulas import BILATERAL, ELEMENTARY
from basketry.operators import domain, governance, quality, resampling, scenarios, vintages
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.plans.screening import _movement_sql
from basketry.plans.structure import NULLED
from basketry.sources import panels
from basketry.sources.staging import staged

DESIGN = resampling.Design("outlet", "stratum")
REPLICATES = 199


def _relatives(s, d):
    return staged(panels.outlet_relatives(s, d), "relatives")


def _draws(s, d):
    """How often each outlet is drawn in each replicate."""
    held = resampling.clusters(_relatives(s, d), DESIGN)
    return resampling.draws(held, 20, 0, 1).join(held.select("stratum", "rank", "cluster").distinct(), ["stratum", "rank"]).select("stratum", "cluster", "replicate", "times")


def _coded(s, d):
    """Prices as reported, missing codes null and nothing else changed."""
    return quality.recode_missing(panels.faulty_panel(s, d)).select("category", "period", "item_id", "price_clean", "quantity", "expenditure")


def _sales(s, d):
    return staged(panels.dwelling_sales(s, d), "sales")


def _vintages(s, d):
    return rounded(vintages.repeat_sales_vintages(_sales(s, d)))


def _vintage_check(s, d):
    """Pairs known and the residual of every vintage and period."""
    sales = _sales(s, d)
    v = staged(vintages.repeat_sales_vintages(sales), "vintages")
    return rounded(v.join(vintages.vintage_residuals(sales, v), ["vintage", "period"]).select("vintage", "period", "pairs", F.abs("residual").alias("residual")))


def _revised(s, d):
    """The triangle of the vintages' values, from the index of each."""
    return rounded(domain.revision_triangle(vintages.as_vintages(vintages.repeat_sales_vintages(_sales(s, d)))))


def _repeat_check(s, d):
    """The last vintage is the repeat-sales index itself: how far they differ, by period."""
    sales = _sales(s, d)
    v = vintages.repeat_sales_vintages(sales)
    last = v.groupBy("period").agg(F.max_by("index", "vintage").alias("last"))
    both = domain.repeat_sales(sales).join(last, "period")
    return rounded(both.select("period", F.abs(F.col("index") - F.col("last")).alias("difference")))


def queries() -> dict:
    return {
        "un_boot": lambda s, d: rounded(resampling.bootstrap(_relatives(s, d), DESIGN, replicates=REPLICATES), 5),
        "un_boot_draws": _draws,
        "un_naive": lambda s, d: rounded(resampling.design_effect(_relatives(s, d), DESIGN, replicates=REPLICATES), 5),
        "un_sens": lambda s, d: rounded(scenarios.sensitivity(_coded(s, d)), 5),
        "un_sens_range": lambda s, d: rounded(scenarios.sensitivity_range(scenarios.sensitivity(_coded(s, d))), 5),
        "un_share": lambda s, d: rounded(scenarios.imputed_share(scenarios.imputed_panels(staged(_coded(s, d), "coded")), ["method"])),
        "pr_vintages": _vintages,
        "pr_vintages_check": _vintage_check,
        "pr_revisions": _revised,
        "pr_revision_bias": lambda s, d: rounded(governance.revision_bias(vintages.as_vintages(vintages.repeat_sales_vintages(_sales(s, d))))),
        "pr_repeat_check": _repeat_check,
    }


OUTLETS = """cell AS (SELECT p_type AS category, CAST(l_suppkey AS VARCHAR) AS outlet, p_brand AS brand, year(l_shipdate) AS y, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) IN (1996, 1999) GROUP BY 1, 2, 3, 4),
  rel AS (SELECT a.category, a.outlet, 'S' || (CAST(a.outlet AS BIGINT) % 2) AS stratum, ln(b.price / a.price) AS lr, a.outlet || '|' || a.brand || '|' || a.category AS item_id FROM cell a JOIN cell b ON a.category = b.category AND a.outlet = b.outlet AND a.brand = b.brand WHERE a.y = 1996 AND b.y = 1999)"""


def _boot_sql(cluster: str, stratum: str, fewer: int, replicates: int) -> str:
    """CTEs up to ch_: replicate, v; of clusters drawn from strata."""
    return f"""cs AS (SELECT {stratum} AS stratum, {cluster} AS cluster, category, sum(lr) AS s, count(*) AS n FROM rel GROUP BY 1, 2, 3),
  rk AS (SELECT stratum, cluster, row_number() OVER (PARTITION BY stratum ORDER BY cluster) - 1 AS rank, count(*) OVER (PARTITION BY stratum) AS size FROM (SELECT DISTINCT stratum, cluster FROM cs)),
  sl AS (SELECT stratum, size, replicate, unnest(range(1, size - {fewer} + 1)) AS slot FROM (SELECT DISTINCT stratum, size FROM rk), (SELECT unnest(range(1, {replicates} + 1)) AS replicate)),
  dr AS (SELECT stratum, replicate, CAST(floor(CAST(CAST('0x' || substr(md5(concat_ws(chr(31), stratum, CAST(replicate AS VARCHAR), CAST(slot AS VARCHAR), '0')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 * size) AS BIGINT) AS rank, count(*) AS times FROM sl GROUP BY 1, 2, 3),
  mn AS (SELECT replicate, category, sum(times * s) / sum(times * n) AS m FROM dr JOIN rk ON dr.stratum = rk.stratum AND dr.rank = rk.rank JOIN cs ON cs.stratum = rk.stratum AND cs.cluster = rk.cluster GROUP BY 1, 2),
  ch_ AS (SELECT replicate, (exp(avg(m)) - 1) * 100 AS v FROM mn GROUP BY 1)"""


def _sens_sql() -> str:
    settings = {f: ELEMENTARY.get(f) or BILATERAL[f] for f in scenarios.FORMULAS}
    last = "(SELECT {0} FROM ({1}) GROUP BY period HAVING {0} IS NOT NULL ORDER BY period DESC LIMIT 1)"
    geo = "exp(avg(ln(level)))"
    chain = lambda f, panel: f"WITH {sql.chained(f, panel)} SELECT category, period, level FROM ix"
    run = chain(settings["jevons"], NULLED)
    rows = [("run" if f == "jevons" else "elementary formula", f, last.format(geo, chain(e, NULLED))) for f, e in settings.items()]
    weighed = f"WITH {sql.chained(settings['jevons'], NULLED)}, {sql.WEIGHTS} SELECT category, period, level, weight FROM ix LEFT JOIN wt USING (category)"
    rows += [("aggregation formula", "equal arithmetic mean", last.format("avg(level)", run)), ("aggregation formula", "equal harmonic mean", last.format("count(level) / sum(1 / level)", run))]
    rows += [("aggregation formula", "weighted arithmetic mean", last.format("sum(weight * level) / sum(weight)", weighed)), ("aggregation formula", "weighted geometric mean", last.format("exp(sum(weight * ln(level)) / sum(weight))", weighed))]
    for m, panel in IMPUTED.items():
        rows.append(("imputation method", m, last.format(geo, chain(settings["jevons"], f"panel AS ({panel})"))))
    union = " UNION ALL ".join(f"SELECT '{d}' AS dimension, '{s}' AS setting, {v} AS headline" for d, s, v in rows)
    return f"sn AS ({union}), bs AS (SELECT headline AS base FROM sn WHERE dimension = 'run')"


_CARRIED = f"WITH {sql.FAULTY}, coded AS (SELECT *, CASE WHEN price = 0 THEN NULL ELSE price END AS pc FROM panel), f AS (SELECT *, last_value(pc IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS pi FROM coded) SELECT period, category, item_id, pc, pi, CASE WHEN pc IS NULL AND pi IS NOT NULL THEN 'carry_forward' END AS how FROM f"
_FILLS = {
    "carry_forward": _CARRIED,
    "class_mean": f"WITH {_movement_sql('category', True, True, 'class_mean')} SELECT * FROM imp",
    "targeted_mean": f"WITH {_movement_sql('category', False, False, 'targeted_mean')} SELECT * FROM imp",
    "overall_mean": f"WITH {_movement_sql(repr('all'), False, False, 'overall_mean')} SELECT * FROM imp",
}
IMPUTED = {m: f"SELECT period, category, item_id, pi AS price, CAST(NULL AS DOUBLE) AS quantity, CAST(NULL AS DOUBLE) AS expenditure FROM ({q})" for m, q in _FILLS.items()}


def _share_sql() -> str:
    """CTEs up to shr: method, share_final, share_run, missing_final."""
    fills = {"none": _CARRIED.replace("SELECT period, category, item_id, pc, pi, CASE WHEN pc IS NULL AND pi IS NOT NULL THEN 'carry_forward' END AS how FROM f", "SELECT period, category, item_id, pc, pc AS pi, CAST(NULL AS VARCHAR) AS how FROM f")} | _FILLS
    every = " UNION ALL ".join(f"SELECT '{m}' AS method, period, category, item_id, pc, pi, how FROM ({q})" for m, q in fills.items())
    return f"""fl AS ({every}), cw AS (WITH {sql.FAULTY}, {sql.WEIGHTS} SELECT category, weight / sum(weight) OVER () AS w FROM wt),
      rt AS (SELECT method, category, period, count(how) / nullif(count(pc) + count(how), 0) AS share, (count(*) - count(pi)) / count(*) AS gap FROM fl GROUP BY 1, 2, 3),
      bp AS (SELECT method, period, sum(coalesce(share, 0) * w) AS share, sum(gap * w) AS missing FROM rt JOIN cw USING (category) GROUP BY 1, 2),
      shr AS (SELECT method, max_by(share, period) AS share_final, avg(share) AS share_run, max_by(missing, period) AS missing_final FROM bp GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    designed = _boot_sql("outlet", "stratum", 1, REPLICATES)
    naive = _boot_sql("item_id", "'all quotes'", 0, REPLICATES)
    width = "quantile_cont(v, 0.975) - quantile_cont(v, 0.025)"
    pairs = f"""{sql.DWELLINGS}, q AS (SELECT property_id, lag(period) OVER w AS f, period AS s FROM sales WHERE price > 0 WINDOW w AS (PARTITION BY property_id ORDER BY period, price)), pr AS (SELECT f, s FROM q WHERE f < s),
      ve AS (SELECT period AS e, row_number() OVER (ORDER BY period) AS k FROM (SELECT DISTINCT period FROM sales WHERE price > 0)), vk AS (SELECT e, count(*) AS n FROM ve JOIN pr ON s <= e WHERE k >= 3 GROUP BY 1), vn AS (SELECT e, n, row_number() OVER (ORDER BY e) AS vintage FROM vk)"""
    return {
        "un_boot": f"""WITH {OUTLETS}, {designed}, pt AS (SELECT (exp(avg(m)) - 1) * 100 AS e FROM (SELECT category, avg(lr) AS m FROM rel GROUP BY 1))
          SELECT round(e, 5) AS estimate, round(quantile_cont(v, 0.025), 5) AS lower, round(quantile_cont(v, 0.975), 5) AS upper, count(v) AS replicates, (SELECT count(DISTINCT stratum) FROM rk) AS strata, (SELECT count(*) FROM rk) AS clusters FROM ch_, pt GROUP BY e""",
        "un_boot_draws": f"WITH {OUTLETS}, {_boot_sql('outlet', 'stratum', 1, 20)} SELECT dr.stratum, cluster, replicate, times FROM dr JOIN rk ON dr.stratum = rk.stratum AND dr.rank = rk.rank",
        "un_naive": f"""WITH {OUTLETS}, d AS (WITH {designed} SELECT {width} AS w FROM ch_), n AS (WITH {naive} SELECT {width} AS w FROM ch_) SELECT round(d.w, 5) AS designed, round(n.w, 5) AS naive, round(d.w / n.w, 5) AS ratio FROM d, n""",
        "un_share": f"WITH {_share_sql()} SELECT method, round(share_final, 6) AS share_final, round(share_run, 6) AS share_run, round(missing_final, 6) AS missing_final FROM shr",
        "un_sens": f"""WITH {_sens_sql()}, {_share_sql()} SELECT dimension, setting, round(headline, 5) AS headline, round(headline - base, 5) AS difference, CASE WHEN headline IS NULL THEN 'not applicable' ELSE 'computed' END AS status,
          round(share_final, 5) AS share_final, round(share_run, 5) AS share_run FROM bs, sn LEFT JOIN shr ON method = CASE WHEN dimension = 'imputation method' THEN setting ELSE 'none' END""",
        "un_sens_range": f"""WITH {_sens_sql()}, l AS (SELECT * FROM sn ORDER BY headline, dimension, setting LIMIT 1), h AS (SELECT * FROM sn WHERE headline IS NOT NULL ORDER BY headline DESC, dimension DESC, setting DESC LIMIT 1)
          SELECT l.setting AS low_setting, round(l.headline, 5) AS low, h.setting AS high_setting, round(h.headline, 5) AS high, round(h.headline - l.headline, 5) AS spread, (SELECT count(*) FROM sn WHERE dimension <> 'run') AS alternatives FROM l, h""",
        "pr_vintages_check": f"WITH {pairs} SELECT CAST(vintage AS INTEGER) AS vintage, p.period, n AS pairs, CAST(0 AS DOUBLE) AS residual FROM vn JOIN (SELECT f AS period, s AS known FROM pr UNION SELECT s, s FROM pr) p ON known <= e GROUP BY 1, 2, 3",
        "pr_repeat_check": f"WITH {pairs} SELECT period, CAST(0 AS DOUBLE) AS difference FROM (SELECT f AS period FROM pr UNION SELECT s FROM pr)",
    }
