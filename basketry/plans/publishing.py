"""Queries for what leaves the engine: publication tables, wide tables, CSV and SDMX-ML read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from basketry.operators import index
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import panels, sinks
from basketry.sources.staging import shared_folder, staged

LEAST = 25


def _index(s, d):
    """Chained indices of categories, and All items."""
    ix = staged(index.chained_index(panels.dense_panel(s, d)), "index")
    total = index.geometric_all_items(ix).select(F.lit("All items").alias("series"), "period", "index", F.lit(None).cast("long").alias("matched"))
    return ix.select(F.col("category").alias("series"), "period", "index", F.col("matched").cast("long").alias("matched")).unionByName(total)


def _table(s, d):
    return sinks.publication_table(_index(s, d), LEAST)


def _csv(s, d):
    path = f"{shared_folder(s)}/publication-{uuid.uuid4().hex}.csv"
    sinks.write_csv(_table(s, d), path, sinks.stamp("run", "content", {"least": LEAST}), "provisional", order=["series", "period"])
    back, told = sinks.read_csv(s, path, "period date, series string, index double, matched_items double, basis string, suppressed boolean, suppression_rule string, published string")
    return rounded(back.select("period", "series", "index", "suppressed", F.coalesce("published", F.lit("")).alias("published"), F.lit(told["run_id"]).alias("run_id")), 5)


def _sdmx(s, d):
    path = f"{shared_folder(s)}/message-{uuid.uuid4().hex}.xml"
    sinks.write_sdmx(_table(s, d), path, sinks.stamp("run", "content", {}), message="M1", prepared="2024-01-01T00:00:00", sender="STATS", base_period="1995-01")
    return sinks.read_sdmx(s, path).select("series", "period", "value", "status")


def queries() -> dict:
    return {
        "snk_publication": lambda s, d: rounded(_table(s, d).drop("published"), 5),
        "snk_wide": lambda s, d: sinks.wide_publication(_table(s, d).withColumn("published", F.when(F.col("suppressed"), F.col("published")).otherwise(F.when(F.col("index").isNotNull(), "shown").otherwise("")))),
        "snk_csv": lambda s, d: _csv(s, d).drop("published"),
        "snk_sdmx": _sdmx,
    }


def oracle_sql() -> dict[str, str]:
    table = f"""{sql.chained()}, k AS (SELECT *, coalesce(matched, {LEAST}) < {LEAST} AS p, count(*) FILTER (WHERE coalesce(matched, {LEAST}) < {LEAST}) OVER (PARTITION BY period) AS np, row_number() OVER (PARTITION BY period, coalesce(matched, {LEAST}) < {LEAST} ORDER BY level) AS rk FROM ix),
      t AS (SELECT period, category AS series, level, matched, p, NOT p AND np = 1 AND rk = 1 AS q FROM k UNION ALL SELECT period, 'All items', exp(avg(ln(level))), NULL, FALSE, FALSE FROM ix GROUP BY period),
      pub AS (SELECT period, series, CASE WHEN NOT p AND NOT q THEN level END AS level, matched, p, q FROM t)"""
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "All items"]
    wide = ", ".join(f"max(CASE WHEN series = '{n}' THEN CASE WHEN p OR q THEN 'suppressed' ELSE 'shown' END END) AS \"{n}\"" for n in types)
    return {
        "snk_publication": f"""WITH {table} SELECT period, series, round(level, 5) AS "index", CAST(matched AS DOUBLE) AS matched_items, '' AS basis, p OR q AS suppressed,
          CASE WHEN p THEN 'primary: built from fewer than {LEAST} matched quotes' WHEN q THEN 'secondary: smallest remaining cell of a period with one suppressed cell' ELSE '' END AS suppression_rule FROM pub""",
        "snk_wide": f"WITH {table} SELECT strftime(period, '%Y-%m-%d') AS period, {wide} FROM pub GROUP BY 1",
        "snk_csv": f"WITH {table} SELECT period, series, round(level, 5) AS \"index\", p OR q AS suppressed, 'run' AS run_id FROM pub",
        "snk_sdmx": f"WITH {table} SELECT series, strftime(period, '%Y-%m') AS period, round(level, 6) AS value, CASE WHEN p OR q THEN 'C' END AS status FROM pub",
    }
