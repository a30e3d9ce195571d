"""Queries for classification trees, spatial reachability, stored layers and residuals of regressions."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import functions as F

from basketry.operators import domain, linalg, multilateral, spatial, trees
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import layers, panels
from basketry.sources.staging import shared_folder, staged

YEAR = 1998


def _urgent(s, d):
    """The customers with an urgent order, as categories."""
    o = panels.table(s, d, "orders").filter("o_orderpriority = '1-URGENT'")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("category")).distinct()


def _registered(s, d):
    """Appending customers and segments to a scheme that has regions and nations."""
    t = panels.place_tree(s, d).select("code", F.col("code").alias("label"), F.lit(0).alias("level"), F.col("parent").alias("parent_code"))
    held = t.filter("code rlike '^(all|[RN][0-9]+)$'").select(F.lit("PLACES").alias("scheme"), "*")
    return trees.new_nodes(held, t, "PLACES")


def _place_weights(s, d):
    """code, weight: customers' orders; segments and regions the same, nations without orders of status P if odd.

    Weights are added up as decimals: sums of doubles over a whole region are off by more than the tolerance.
    """
    o = panels.table(s, d, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), F.col("o_totalprice").cast("decimal(28,8)").alias("o_totalprice"), "o_orderstatus")
    up = trees.closure(panels.place_tree(s, d))
    j = o.join(up, "code").withColumn("n", F.regexp_extract("ancestor", "^N([0-9]+)$", 1))
    odd = (F.col("n") != "") & (F.expr("try_cast(n as int)") % 2 == 1) & (F.col("o_orderstatus") == "P")
    return j.groupBy(F.col("ancestor").alias("code")).agg(F.sum(F.when(~odd, F.col("o_totalprice")).otherwise(F.lit(0).cast("decimal(28,8)"))).alias("weight"))


def _places(s, d):
    """aggregate_tree over customers' order values, each 100 in its first quarter."""
    o = staged(panels.customer_orders(s, d), "orders")
    base = o.groupBy("code").agg(F.min_by("price", "period").alias("p0"), F.sum("total").alias("weight"))
    levels = o.join(base, "code").select("code", "period", (100 * F.col("price") / F.col("p0")).alias("index"))
    return trees.aggregate_tree(levels, base.select("code", "weight"), panels.place_tree(s, d))


def _table(s, d):
    return rounded(trees.contribution_table(_places(s, d).filter("depth = 1"), "1996-01-01", "1999-01-01"), 5)


def _hicp(s, d):
    """The re-aggregated divisions and total of a year beside the published ones."""
    prices = staged(panels.coded_prices(s, d), "coded")
    w = prices.groupBy("coicop", F.year("period").alias("year")).agg(F.sum("total").alias("t"))
    whole = w.filter("coicop = 'CP00'").select("year", F.col("t").alias("whole"))
    weights = w.join(whole, "year").select("coicop", "year", (1000 * F.col("t") / F.col("whole")).alias("value"))
    levels, leaves, _ = trees.hicp_tree(prices, weights, YEAR)
    upper = leaves.select(F.col("parent").alias("code")).filter("code <> 'CP00'").distinct().select("code", F.lit("CP00").alias("parent"))
    own = levels.withColumnRenamed("coicop", "code").join(leaves.select("code"), "code", "left_semi")
    made = trees.aggregate_tree(own, leaves.select("code", "weight"), leaves.select("code", "parent").unionByName(upper))
    published = levels.select(F.col("coicop").alias("code"), "period", F.col("index").alias("published"))
    return rounded(made.filter("index is not null").join(published, ["code", "period"]).select("code", "period", "index", "published", "weight", "depth"), 5)


def _hicp_notes(s, d):
    prices = staged(panels.coded_prices(s, d), "coded")
    w = prices.groupBy("coicop", F.year("period").alias("year")).agg(F.sum("total").alias("value"))
    _, _, notes = trees.hicp_tree(prices, w, YEAR)
    return rounded(notes.select("division", F.array_join("groups", ",").alias("groups"), "covered", "weight"), 2)


def _root(s):
    return f"{shared_folder(s)}/layers-{uuid.uuid4().hex}"


def _replayed(s, d):
    """Storing a panel twice, cleaning it, replaying the log, and replaying it on a changed panel."""
    root, settings = _root(s), {"repair": True, "imputation": "carry_forward"}
    panel = staged(panels.faulty_panel(s, d), "panel")
    content = layers.write_raw(panel, root)
    again = layers.write_raw(panel.orderBy(F.col("period").desc(), "item_id"), root)
    path, log = layers.write_cleaned(s, root, content, settings)
    stored, made = s.read.parquet(f"{path}/rows"), layers.replay(layers.read_raw(s, root, content), layers.read_log(s, path))
    try:
        layers.replay(panel.withColumn("price", F.when(F.col("period") == "1996-02-01", F.col("price") + 1).otherwise(F.col("price"))), log)
        refused = 0
    except layers.ImmutableLayerError:
        refused = 1
    rows = [("stored again as new", int(again != content)), ("changed input refused", refused)]
    fixed = s.createDataFrame(rows, "step string, n long")
    told = layers.manifest(s, root).groupBy(F.concat(F.lit("rows of "), "layer").alias("step")).agg(F.sum("rows").alias("n"))
    off = layers.differing(stored, made, ["period", "item_id"]).agg(F.lit("rows that a replay changes").alias("step"), F.count("*").alias("n"))
    return fixed.unionByName(told).unionByName(off)


def _reproduced(s, d):
    root, settings = _root(s), {"repair": False, "imputation": "carry_forward", "formula": "jevons"}
    content = layers.write_raw(panels.faulty_panel(s, d), root)
    layers.store_run(s, root, "run-1", content, settings)
    return rounded(layers.reproduce(s, root, "run-1"))


def _tpd_check(weighted, s, d):
    cells = staged(multilateral.product_cells(panels.sparse_panel(s, d), weighted), "cells")
    found = multilateral.dummy_levels(cells)
    return rounded(linalg.dummy_residuals(cells, found.select(F.col("period").alias("t"), F.ln("index").alias("effect"))).withColumnRenamed("t", "period"))


def _cpd_check(weighted, s, d):
    prices = staged(panels.regional_prices(s, d), "prices")
    whole = prices.groupBy("region").agg(F.sum("expenditure").alias("whole"))
    cells = prices.join(whole, "region").select(F.col("region").alias("t"), F.col("product").alias("i"), F.ln("price").alias("y"), (F.col("expenditure") / F.col("whole") if weighted else F.lit(1.0)).alias("w"))
    found = domain.country_product_dummy(prices, "NATION_0", weighted=weighted)
    return rounded(linalg.dummy_residuals(cells, found.select(F.col("region").alias("t"), F.ln("parity").alias("effect"))).withColumnRenamed("t", "region"))


def _gk_check(s, d):
    units = staged(multilateral.unit_value_panel(panels.sparse_panel(s, d)), "units")
    cells = units.select(F.col("period").alias("t"), F.col("item_id").alias("i"), F.col("price").alias("p"), F.col("quantity").alias("q"))
    found = multilateral.geary_khamis(units)
    return rounded(linalg.fixed_point_residuals(cells, found.select(F.col("period").alias("t"), F.col("index").alias("level"))).withColumnRenamed("t", "period"))


def _spatial_gk_check(s, d):
    prices = staged(panels.regional_prices(s, d), "prices")
    cells = prices.select(F.col("region").alias("t"), F.col("product").alias("i"), F.col("price").alias("p"), F.col("quantity").alias("q"))
    found = domain.spatial_geary_khamis(prices, "NATION_0")
    return rounded(linalg.fixed_point_residuals(cells, found.select(F.col("region").alias("t"), F.col("parity").alias("level"))).withColumnRenamed("t", "region"))


def _parities(method, s, d):
    return rounded(spatial.parities(panels.patchy_regions(s, d), "NATION_0", method))


def _published(s, d):
    """Which parities are estimated and published, without their values."""
    p = spatial.parities(panels.patchy_regions(s, d), "NATION_0")
    return p.select("region", F.col("estimated").isNotNull().alias("has_estimate"), F.col("published").isNotNull().alias("has_parity"), "shared", "reason")


def _converted(s, d):
    """Expenditure of each nation at the base's prices and back: local over converted is the parity."""
    prices = staged(panels.patchy_regions(s, d), "prices")
    p = staged(spatial.parities(prices, "NATION_0", "gk"), "parities")
    local = prices.groupBy("region").agg(F.sum("expenditure").alias("value"))
    c = spatial.convert(local, p)
    rates = p.select("region", (2 * F.col("estimated")).alias("rate"))
    return rounded(c.join(spatial.price_levels(p, rates), "region", "left").select("region", "local", (F.col("converted") * F.col("parity")).alias("back"), "reason", "level"), 2)


def queries() -> dict:
    return {
        "src_class_user": _registered,
        "src_tree_closure": lambda s, d: trees.closure(panels.place_tree(s, d)),
        "src_parent_map": lambda s, d: panels.place_tree(s, d).join(trees.depths(trees.closure(panels.place_tree(s, d))), "code"),
        "src_parent_map_for": lambda s, d: trees.parent_map_for(panels.place_tree(s, d), _urgent(s, d)),
        "val_weight_tree": lambda s, d: rounded(trees.weight_problems(_place_weights(s, d), panels.place_tree(s, d), 0.01), 2),
        "ag_tree_places": lambda s, d: rounded(_places(s, d), 5),
        "ag_table": _table,
        "src_hicp_tree": _hicp,
        "src_hicp_notes": _hicp_notes,
        "sx_connected": lambda s, d: spatial.reached_regions(panels.patchy_regions(s, d), "NATION_0"),
        "sx_withhold": lambda s, d: spatial.withholding(panels.patchy_regions(s, d), "NATION_0"),
        "sx_thin": lambda s, d: spatial.thin_pairs(panels.patchy_regions(s, d)),
        "sx_published": _published,
        "sx_convert": _converted,
        "snk_replay": _replayed,
        "gv_reproduce": _reproduced,
        "ml_tpd_check": partial(_tpd_check, False),
        "ml_wtpd_check": partial(_tpd_check, True),
        "ml_gk_check": _gk_check,
        "sx_cpd_check": partial(_cpd_check, False),
        "sx_wcpd_check": partial(_cpd_check, True),
        "sx_gk_check": _spatial_gk_check,
    }


PLACES = """place AS (SELECT 'all' AS code, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'R' || r_regionkey, 'all' FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT DISTINCT 'N' || c_nationkey || '|' || c_mktsegment, 'N' || c_nationkey FROM customer UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey || '|' || c_mktsegment FROM customer)"""
UP = f"""{PLACES}, up AS (SELECT code, code AS ancestor, 0 AS distance FROM place UNION ALL SELECT up.code, place.parent, distance + 1 FROM up JOIN place ON up.ancestor = place.code WHERE place.parent IS NOT NULL)"""
LEVELS = f"""{UP}, co AS (SELECT 'C' || o_custkey AS code, {sql.QUARTER.format('o_orderdate')} AS period, avg(o_totalprice) AS price, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2),
  cb AS (SELECT code, min_by(price, period) AS p0, sum(total) AS w FROM co GROUP BY 1), lv AS (SELECT co.code, period, 100 * price / p0 AS i, w FROM co JOIN cb ON co.code = cb.code),
  nw AS (SELECT ancestor, sum(w) AS w FROM cb JOIN up ON cb.code = up.code GROUP BY 1), dp AS (SELECT code, max(distance) AS depth FROM up GROUP BY 1),
  agg AS (SELECT up.ancestor AS code, period, sum(lv.w * i) / max(nw.w) AS i, max(nw.w) AS w FROM lv JOIN up ON lv.code = up.code JOIN nw ON nw.ancestor = up.ancestor GROUP BY 1, 2)"""
CODED = """coded AS (SELECT coicop, period, sum(e) / sum(q) AS v, sum(e) AS t FROM (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_extendedprice AS e, l_quantity AS q,
  unnest(['CP00', dv, dv || CAST(CAST(substr(p_brand, 7) AS INT) % 3 + 1 AS VARCHAR)]) AS coicop FROM (SELECT *, 'CP0' || list_position(['ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'], p_type) AS dv FROM lineitem JOIN part ON l_partkey = p_partkey)) WHERE coicop <> 'CP033' GROUP BY 1, 2)"""
PATCHY = f"""{sql.REGIONAL}, patchy AS (SELECT * REPLACE (CASE WHEN CAST(substr(region, 8) AS INT) % 5 = 4 THEN 'island|' || product ELSE product END AS product) FROM regional),
  pt AS (SELECT * FROM patchy WHERE region <> 'NATION_7' OR product IN ('Brand#1|PROMO', 'Brand#2|PROMO', 'Brand#3|PROMO'))"""
REACH = f"{PATCHY}, rc AS (SELECT 'NATION_0' AS region UNION SELECT b.region FROM rc JOIN pt a ON a.region = rc.region JOIN pt b ON b.product = a.product)"
HELD = f"""{REACH}, ov AS (SELECT a.region, b.region AS other, count(*) AS n FROM pt a JOIN pt b ON a.product = b.product AND a.region <> b.region GROUP BY 1, 2),
  hd AS (SELECT r.region, coalesce(max(n), 0) AS shared, max(CASE WHEN rc.region IS NOT NULL THEN 1 END) AS rd FROM (SELECT DISTINCT region FROM pt) r LEFT JOIN ov ON ov.region = r.region LEFT JOIN rc ON rc.region = r.region GROUP BY 1),
  wh AS (SELECT region, shared, CASE WHEN rd IS NULL THEN 'unreachable' WHEN region <> 'NATION_0' AND shared < 5 THEN 'thin' END AS reason FROM hd)"""
NULLED = sql.FAULTY.replace("THEN 0.0", "THEN NULL")
CARRIED = f"raw AS (WITH {NULLED} SELECT * FROM panel), panel AS (SELECT * REPLACE (last_value(price IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS price) FROM raw)"


def oracle_sql() -> dict[str, str]:
    r5 = "round(i, 5) AS \"index\", round(w, 5) AS weight"
    hicp = f"""{CODED}, wt AS (SELECT coicop, 1000 * sum(t) / (SELECT sum(t) FROM coded WHERE coicop = 'CP00' AND year(period) = {YEAR}) AS w FROM coded WHERE year(period) = {YEAR} GROUP BY 1),
      lv AS (SELECT c.coicop, period, 100 * v / v0 AS i FROM coded c JOIN (SELECT coicop, v AS v0 FROM coded WHERE period = DATE '{YEAR - 1}-12-01') b ON c.coicop = b.coicop WHERE period BETWEEN DATE '{YEAR - 1}-12-01' AND DATE '{YEAR}-12-31'),
      lf AS (SELECT coicop, CASE WHEN length(coicop) = 5 THEN substr(coicop, 1, 4) ELSE 'CP00' END AS parent, w FROM wt WHERE (length(coicop) = 5 AND coicop NOT LIKE 'CP03%') OR coicop = 'CP03')"""
    made = f"{LEVELS}"
    out = {
        "src_class_user": f"WITH {PLACES} SELECT 'PLACES' AS scheme, code, code AS label, 0 AS level, parent AS parent_code FROM place WHERE NOT regexp_matches(code, '^(all|[RN][0-9]+)$')",
        "src_tree_closure": f"WITH RECURSIVE {UP} SELECT code, ancestor, distance FROM up",
        "src_parent_map": f"WITH RECURSIVE {UP} SELECT place.code, parent, max(distance) AS depth FROM place JOIN up ON place.code = up.code GROUP BY 1, 2",
        "src_parent_map_for": f"WITH RECURSIVE {UP}, k AS (SELECT DISTINCT ancestor AS code FROM up WHERE code IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) SELECT k.code, parent FROM k JOIN place ON k.code = place.code",
        "val_weight_tree": f"""WITH RECURSIVE {UP}, wt AS (SELECT ancestor AS code, sum(CASE WHEN regexp_matches(ancestor, '^N[0-9]*[13579]$') AND o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END) AS w FROM orders JOIN up ON up.code = 'C' || o_custkey GROUP BY 1),
          s AS (SELECT place.parent, count(*) AS children, count(w) AS known, sum(w) AS total FROM place LEFT JOIN wt ON wt.code = place.code WHERE place.parent IS NOT NULL GROUP BY 1)
          SELECT s.parent, children, round(total, 2) AS total, round(w, 2) AS weight, round(total - w, 2) AS difference FROM s JOIN wt ON s.parent = wt.code WHERE children = known AND abs(total - w) > 0.01""",
        "ag_tree_places": f"WITH RECURSIVE {made} SELECT agg.code, period, {r5}, depth FROM agg JOIN dp ON agg.code = dp.code",
        "ag_table": f"""WITH RECURSIVE {made}, t AS (SELECT agg.code, max(w) AS w, max(CASE WHEN period = DATE '1996-01-01' THEN i END) AS a, max(CASE WHEN period = DATE '1999-01-01' THEN i END) AS b FROM agg JOIN dp ON agg.code = dp.code WHERE depth = 1 GROUP BY 1)
          SELECT code, round(w, 5) AS weight, round(a, 5) AS level_start, round(b, 5) AS level_end, round((b / a - 1) * 100, 5) AS change_pct, round(w * (b - a) / sum(w * a) OVER () * 100, 5) AS contribution_pp FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
        "src_hicp_tree": f"""WITH {hicp}, n AS (SELECT coicop AS code, coicop AS leaf FROM lf UNION ALL SELECT parent, coicop FROM lf WHERE parent <> 'CP00' UNION ALL SELECT 'CP00', coicop FROM lf),
          tw AS (SELECT code, sum(w) AS w FROM n JOIN lf ON leaf = lf.coicop GROUP BY 1),
          z AS (SELECT n.code, period, sum(lf.w * i) / max(tw.w) AS i, max(tw.w) AS w FROM n JOIN lf ON leaf = lf.coicop JOIN lv ON lv.coicop = leaf JOIN tw ON tw.code = n.code GROUP BY 1, 2)
          SELECT code, z.period, round(z.i, 5) AS "index", round(lv.i, 5) AS published, round(w, 5) AS weight, CASE WHEN code = 'CP00' THEN 0 ELSE length(code) - 3 END AS depth FROM z JOIN lv ON lv.coicop = code AND lv.period = z.period""",
        "src_hicp_notes": f"""WITH {CODED}, wt AS (SELECT coicop, sum(t) AS w FROM coded WHERE year(period) = {YEAR} GROUP BY 1)
          SELECT 'CP03' AS division, 'CP031,CP032' AS groups, round((SELECT sum(w) FROM wt WHERE coicop IN ('CP031', 'CP032')), 2) AS covered, round((SELECT w FROM wt WHERE coicop = 'CP03'), 2) AS weight""",
        "sx_connected": f"WITH RECURSIVE {REACH} SELECT region FROM rc",
        "sx_withhold": f"WITH RECURSIVE {HELD} SELECT region, shared, reason FROM wh",
        "sx_published": f"WITH RECURSIVE {HELD} SELECT region, coalesce(reason, '') <> 'unreachable' AS has_estimate, reason IS NULL AS has_parity, shared, reason FROM wh",
        "sx_convert": f"""WITH RECURSIVE {HELD}, l AS (SELECT region, sum(expenditure) AS v FROM pt GROUP BY 1)
          SELECT l.region, round(v, 2) AS local, CASE WHEN reason IS NULL THEN round(v, 2) END AS back, coalesce(reason, '') AS reason, CASE WHEN reason IS NULL THEN CAST(50 AS DOUBLE) END AS level FROM l JOIN wh ON l.region = wh.region""",
        "sx_thin": f"""WITH RECURSIVE {HELD}, r AS (SELECT DISTINCT region FROM pt) SELECT a.region AS region_a, b.region AS region_b, coalesce(n, 0) AS matched FROM r a JOIN r b ON a.region < b.region LEFT JOIN ov ON ov.region = a.region AND ov.other = b.region WHERE coalesce(n, 0) < 5""",
        "snk_replay": f"""WITH {sql.FAULTY}, n AS (SELECT count(*) AS n FROM panel) SELECT 'stored again as new' AS step, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'changed input refused', 1 UNION ALL SELECT 'rows of raw', n FROM n UNION ALL SELECT 'rows of cleaned', n FROM n UNION ALL SELECT 'rows that a replay changes', 0""",
        "gv_reproduce": f"WITH {sql.chained(panel=CARRIED)}, {sql.SERIES} SELECT series, period, round(level, 6) AS \"index\" FROM series",
    }
    for name, panel, key in (("ml_tpd_check", sql.SPARSE, "period"), ("ml_wtpd_check", sql.SPARSE, "period"), ("ml_gk_check", sql.SPARSE, "period"), ("sx_cpd_check", sql.REGIONAL, "region"), ("sx_wcpd_check", sql.REGIONAL, "region"), ("sx_gk_check", sql.REGIONAL, "region")):
        out[name] = f"WITH {panel} SELECT {key}, count(*) AS n, CAST(0 AS DOUBLE) AS residual FROM {'panel' if key == 'period' else 'regional'} WHERE price > 0 GROUP BY 1"
    return out
