"""Queries that write given tables as foreign files and read them back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators import index
from basketry.plans import sql
from basketry.plans.rounding import rounded
from basketry.sources import fetch, panels, readers
from basketry.sources.staging import shared_folder, staged
from basketry.streaming import carry

#: Names that say nothing of what a column holds, but for the price: here prices vary more within items than quantities do.
NAMES = {"period": "a", "category": "b", "item_id": "c", "expenditure": "d", "quantity": "e", "price": "Price"}


def _written(lines: DataFrame) -> str:
    """The folder of text files that hold the lines (at, line) in their order, one after the other by name."""
    folder = f"{shared_folder(lines.sparkSession)}/text-{uuid.uuid4().hex}.csv"
    lines.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(folder)
    return folder


def _customers(s, d):
    """Customers as a semicolon file with two lines above the header; one row in fifty lacks a cell."""
    c = panels.table(s, d, "customer")
    full = F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment", F.format_string("%.2f", "c_acctbal"))
    line = F.when(F.col("c_custkey") % 50 == 7, F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name")).otherwise(full)
    head = s.createDataFrame([(-3, "Customers as registered"), (-2, "all segments"), (-1, "key;name;segment;balance")], "at long, line string")
    return _written(head.unionByName(c.select(F.col("c_custkey").alias("at"), line.alias("line"))))


def _read(s, d):
    return rounded(readers.read_table(s, _customers(s, d)).select(F.col("key").cast("long").alias("key"), "name", "segment", F.col("balance").cast("double").alias("balance")))


def _malformed(s, d):
    return readers.malformed_rows(s, _customers(s, d))


def _headerless(s, d):
    """Orders without a header: key, date and total, told by what they hold."""
    o = panels.table(s, d, "orders")
    line = F.concat_ws(",", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.format_string("%.2f", "o_totalprice"))
    df = readers.read_table(s, _written(o.select(F.col("o_orderkey").alias("at"), line.alias("line"))))
    return rounded(readers.standardised(df).select("period", "item_id", "price"), 2)


def _odd(s, d):
    return staged(panels.dense_panel(s, d).select(*[F.col(f).cast("string").alias(n) for f, n in NAMES.items()]), "odd")


def _suggested(s, d):
    found = readers.suggested(_odd(s, d))
    return rounded(s.createDataFrame([(f, c, float(p)) for f, (c, p) in found.items()], "field string, column string, confidence double"), 1)


def _standardised(s, d):
    p = readers.standardised(_odd(s, d))
    return rounded(p.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("items"), F.min("period").alias("first"), F.sum("expenditure").alias("expenditure"), F.avg("price").alias("price")), 3)


def _streamed(s, d):
    """The faulty panel with its missing codes, streamed in three files of consecutive periods and one far ahead."""
    p = staged(panels.faulty_panel(s, d).select("item_id", F.col("period").cast("timestamp").alias("period"), F.when(F.col("price") != 0, F.col("price")).alias("price")), "quotes")
    folder = f"{shared_folder(s)}/quotes-{uuid.uuid4().hex}"
    year = F.year("period")
    for part in (p.filter(year < 1997), p.filter((year >= 1997) & (year < 2000)), p.filter(year >= 2000), s.sql("SELECT '~' AS item_id, TIMESTAMP '2100-01-01' AS period, 1.0D AS price")):
        part.coalesce(1).write.mode("append").parquet(folder)
    out = carry.replayed(s, folder, shared_folder(s)).filter("item_id <> '~'")
    return rounded(out.withColumn("period", F.to_date("period")))


def _recorded(s, d):
    """Payloads of each type's index as an agency would have sent them: two fetches, PROMO's newer one only errors, SMALL's at the third attempt."""
    ix = index.chained_index(panels.dense_panel(s, d)).select("category", F.date_format("period", "yyyy-MM").alias("period"), F.round("index", 4).alias("value"))
    body = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("period", "value"))).alias("observations")))
    payloads = ix.groupBy("category").agg(body.alias("new")).join(ix.filter("period < '2000-01'").groupBy("category").agg(body.alias("old")), "category").collect()  # one document a category
    root = f"{shared_folder(s)}/payloads-{uuid.uuid4().hex}"
    root = root if "://" in root else f"file://{root.removeprefix('file:')}"
    for r in payloads:
        at = f"{root}/{r['category']}"
        fetch.record(f"{at}/2001-01-01/1-200.json", r["old"])
        for k, status in enumerate({"PROMO": (500, 503, 429, 500), "SMALL": (503, 429, 200)}.get(r["category"], (200,)), 1):
            fetch.record(f"{at}/2002-01-01/{k}-{status}.json", r["new"] if status == 200 else "error")
    s.dataSource.register(fetch.Recorded)
    got = s.read.format("recorded").load(root)
    return rounded(got.withColumn("period", F.to_date("period")).select("dataset", "period", "value", "fetched", "stale", "attempts", F.length("sha256").alias("digits")), 4)


def queries() -> dict:
    return {"st_carry": _streamed, "src_fetch": _recorded, "src_csv": _read, "src_malformed": _malformed, "src_headerless": _headerless, "src_mapping": _suggested, "src_standardise": _standardised}


def oracle_sql() -> dict[str, str]:
    told = ", ".join(f"('{f}', '{n}', CAST({0.5 if f in ('category', 'item_id') else 1.0} AS DOUBLE))" for f, n in NAMES.items())
    return {
        "st_carry": f"""WITH {sql.FAULTY}, c AS (SELECT item_id, period, CASE WHEN price <> 0 THEN price END AS pc FROM panel), f AS (SELECT *, last_value(pc IGNORE NULLS) OVER (PARTITION BY item_id ORDER BY period ROWS UNBOUNDED PRECEDING) AS pi FROM c)
          SELECT item_id, period, round(pc, 6) AS price, round(pi, 6) AS price_imputed, CASE WHEN pc IS NULL AND pi IS NOT NULL THEN 'carry_forward' END AS imputation FROM f""",
        "src_fetch": f"""WITH {sql.chained()} SELECT category AS dataset, period, round(level, 4) AS value, CASE WHEN category = 'PROMO' THEN '2001-01-01' ELSE '2002-01-01' END AS fetched, category = 'PROMO' AS stale,
          CAST(CASE category WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 3 ELSE 1 END AS INTEGER) AS attempts, CAST(64 AS INTEGER) AS digits FROM ix WHERE category <> 'PROMO' OR period < DATE '2000-01-01'""",
        "src_csv": "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 50 <> 7",
        "src_malformed": "SELECT c_custkey || ';' || c_name AS line FROM customer WHERE c_custkey % 50 = 7",
        "src_headerless": "SELECT CAST(o_orderdate AS DATE) AS period, 'o' || o_orderkey AS item_id, round(o_totalprice, 2) AS price FROM orders",
        "src_mapping": f'SELECT * FROM (VALUES {told}) v(field, "column", confidence)',
        "src_standardise": f"WITH {sql.DENSE} SELECT category, count(*) AS n, count(DISTINCT item_id) AS items, min(period) AS \"first\", round(sum(expenditure), 3) AS expenditure, round(avg(price), 3) AS price FROM panel GROUP BY 1",
    }
