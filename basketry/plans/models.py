"""Queries for hedonic models, replacements and user-written formulae."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.formulas import ELEMENTARY
from basketry.functions.language import compile_formula
from basketry.operators import hedonic, index
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import decoders, panels

FORMULA = "round((jevons * 2 + max(dutot, carli)) / 3, 4) * 100 + n_items % 7 - 10 // 4"


def _custom(s, d):
    """A formula over the elementary measures of each link."""
    pairs = index.matched_pairs(panels.dense_panel(s, d))
    m = pairs.groupBy("category", "period").agg(*[F.expr(ELEMENTARY[n]).alias(n) for n in ("jevons", "dutot", "carli")], F.count("*").alias("n_items"))
    value = compile_formula(FORMULA, {n: F.col(n) for n in ("jevons", "dutot", "carli", "n_items")})
    return rounded(m.select("category", "period", value.alias("value")), 3)


def _ledger(s, d):
    """Every item of a brand ending in 5 replaces the one of the brand ending in 4 from 1998 on."""
    items = panels.dense_panel(s, d).select("item_id").distinct()
    five = items.filter("item_id rlike '^Brand#.5'").select(F.concat(F.substring("item_id", 1, 7), F.lit("4"), F.expr("substring(item_id, 9)")).alias("old_item"), F.col("item_id").alias("new_item"), F.to_date(F.lit("1998-01-01")).alias("period"), F.lit(1.1).alias("quality_ratio"))
    return five.join(items.withColumnRenamed("item_id", "old_item"), "old_item", "left_semi")


def _replaced(s, d):
    return hedonic.apply_ledger(panels.dense_panel(s, d), _ledger(s, d)).select("period", "item_id", "replaced_item_id", "price")


def _codes(s, d):
    parts = panels.table(s, d, "part").select(F.concat(F.lit("C"), (F.col("p_partkey") % 400).cast("string")).alias("code")).distinct()
    return decoders.leaf_codes(parts)


def queries() -> dict:
    sales = panels.dwelling_sales
    return {
        "ud_elem": _custom,
        "qa_apply": lambda s, d: rounded(_replaced(s, d)),
        "src_leaf_codes": _codes,
        "hd_index": lambda s, d: rounded(hedonic.hedonic_index(sales(s, d), ["floor_area"], ["stratum"])),
        "hd_cv": lambda s, d: rounded(hedonic.cross_validate(sales(s, d), ["floor_area"], ["stratum"])),
    }


def oracle_sql() -> dict[str, str]:
    e = ELEMENTARY
    return {
        "ud_elem": f"""WITH {sql.DENSE}, {sql.LINKED}, {sql.pairs(False)}, m AS (SELECT category, period, {e['jevons']} AS j, {e['dutot']} AS d, {e['carli']} AS c, count(*) AS n FROM pairs GROUP BY 1, 2)
          SELECT category, period, round(round_even((j * 2 + greatest(d, c)) / 3, 4) * 100 + n % 7 - 2, 3) AS value FROM m""",
        "qa_apply": f"""WITH {sql.DENSE}, i AS (SELECT DISTINCT item_id FROM panel), g AS (SELECT regexp_replace(item_id, '^(Brand#.)5', '\\1' || '4') AS o, item_id AS n FROM i WHERE regexp_matches(item_id, '^Brand#.5')),
          k AS (SELECT o, n FROM g WHERE o IN (SELECT item_id FROM i))
          SELECT period, coalesce(a.o, item_id) AS item_id, CASE WHEN a.o IS NOT NULL THEN item_id END AS replaced_item_id, round(price / CASE WHEN a.o IS NULL THEN 1 ELSE 1.1 END, 6) AS price
          FROM panel LEFT JOIN k a ON item_id = a.n LEFT JOIN k b ON item_id = b.o WHERE (a.o IS NULL OR period >= DATE '1998-01-01') AND (b.o IS NULL OR period < DATE '1998-01-01')""",
        "src_leaf_codes": """WITH c AS (SELECT DISTINCT 'C' || CAST(p_partkey % 400 AS VARCHAR) AS code FROM part)
          SELECT code FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.code <> c.code AND starts_with(o.code, c.code))""",
    }
