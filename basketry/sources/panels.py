"""Panels and other inputs derived from a star schema of orders and parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def month(ts: Column | str) -> Column:
    """The first day of the month, as a date; time zones play no part."""
    return F.trunc(F.to_date(ts), "MM")


def quarter(ts: Column | str) -> Column:
    return F.trunc(F.to_date(ts), "QUARTER")


def _sales_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_linestatus", "l_orderkey")
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    return lines.join(parts, lines.l_partkey == parts.p_partkey)


def _unit_values(lines: DataFrame, *keys: Column) -> DataFrame:
    out = lines.groupBy(*keys).agg(F.sum("l_extendedprice").alias("expenditure"), F.sum("l_quantity").alias("quantity"))
    return out.withColumn("price", F.col("expenditure") / F.col("quantity"))


def dense_panel(spark: SparkSession, folder: str) -> DataFrame:
    """period, category, item_id, expenditure, quantity, price: unit values by month, brand and type."""
    lines = _sales_lines(spark, folder)
    return _unit_values(lines, month("l_shipdate").alias("period"), F.col("p_type").alias("category"), F.concat_ws("|", "p_brand", "p_type").alias("item_id"))


def sparse_panel(spark: SparkSession, folder: str) -> DataFrame:
    """As dense_panel, each part an item: most items are unsold in most months."""
    lines = _sales_lines(spark, folder)
    cells = _unit_values(lines, month("l_shipdate").alias("period"), F.col("p_type").alias("category"), F.col("l_partkey"))  # dealt by part already, by the join
    return cells.select("period", "category", F.col("l_partkey").cast("string").alias("item_id"), "expenditure", "quantity", "price")


def faulty_panel(spark: SparkSession, folder: str) -> DataFrame:
    """dense_panel as reported: one price in 29 is 0, one in 31 a hundred times too high, one in 37 too low."""
    p = dense_panel(spark, folder)
    k = F.year("period") * 12 + F.month("period") + F.length("item_id") * 7 + F.ascii(F.substring("item_id", 8, 1)) * 3
    price = F.when(k % 29 == 0, 0.0).when(k % 31 == 0, F.col("price") * 100).when(k % 37 == 0, F.col("price") / 100).otherwise(F.col("price"))
    return p.withColumn("price", price)


def trade_flows(spark: SparkSession, folder: str) -> DataFrame:
    """period (quarter), flow (export or import), product, value, quantity."""
    lines = _sales_lines(spark, folder)
    flow = F.when(F.col("l_linestatus") == "O", "export").otherwise("import").alias("flow")
    return lines.groupBy(quarter("l_shipdate").alias("period"), flow, F.concat_ws("|", "p_type", "p_brand").alias("product")).agg(F.sum("l_extendedprice").alias("value"), F.sum("l_quantity").alias("quantity"))


def regional_prices(spark: SparkSession, folder: str) -> DataFrame:
    """region (nation of the customer), product, expenditure, quantity, price."""
    lines = _sales_lines(spark, folder)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    buyers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name")
    joined = lines.join(buyers, lines.l_orderkey == buyers.o_orderkey)
    return _unit_values(joined, F.col("n_name").alias("region"), F.concat_ws("|", "p_brand", "p_type").alias("product"))


def dwelling_sales(spark: SparkSession, folder: str) -> DataFrame:
    """property_id, period (quarter), stratum, floor_area, price (mean of the quarter), appraisal."""
    lines = _sales_lines(spark, folder)
    keys = [F.col("l_partkey").alias("property_id"), quarter("l_shipdate").alias("period"), F.col("p_type").alias("stratum"), F.col("p_size").alias("floor_area"), F.col("p_retailprice").alias("appraisal")]
    return lines.groupBy(*keys).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))


def dwelling_rents(spark: SparkSession, folder: str) -> DataFrame:
    """dwelling_id, stratum, period (quarter), rent."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return joined.groupBy(F.col("o_custkey").alias("dwelling_id"), F.col("c_mktsegment").alias("stratum"), quarter("o_orderdate").alias("period")).agg(F.avg("o_totalprice").alias("rent"))


def type_tree(spark: SparkSession, folder: str) -> DataFrame:
    """code, parent: items under types under the root `all`."""
    parts = table(spark, folder, "part")
    items = parts.select(F.concat_ws("|", "p_brand", "p_type").alias("code"), F.col("p_type").alias("parent")).distinct()
    types = parts.select(F.col("p_type").alias("code"), F.lit("all").alias("parent")).distinct()
    return items.unionByName(types)


def place_tree(spark: SparkSession, folder: str) -> DataFrame:
    """code, parent: customers (C) under their nation's market segments, those under nations (N), regions (R) and `all`."""
    region, nation, customer = (table(spark, folder, n) for n in ("region", "nation", "customer"))
    n, segment = F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), F.concat_ws("|", F.concat(F.lit("N"), F.col("c_nationkey").cast("string")), "c_mktsegment")
    out = spark.createDataFrame([("all", None)], "code string, parent string")
    out = out.unionByName(region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("code"), F.lit("all").alias("parent")))
    out = out.unionByName(nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("code"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent")))
    out = out.unionByName(customer.select(segment.alias("code"), n.alias("parent")).distinct())
    return out.unionByName(customer.select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("code"), segment.alias("parent")))


def customer_orders(spark: SparkSession, folder: str) -> DataFrame:
    """code (customer), period (quarter), price (mean value of its orders), total."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    return orders.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("code"), quarter("o_orderdate").alias("period")).agg(F.avg("o_totalprice").alias("price"), F.sum("o_totalprice").alias("total"))


def coded_prices(spark: SparkSession, folder: str) -> DataFrame:
    """coicop, period (month), value (unit value), total: a division CP01 to CP06 for each type, three groups of brands each, and CP00.

    The third group of CP03 is not published, so its groups do not cover it.
    """
    lines = _sales_lines(spark, folder)
    types = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
    division = F.concat(F.lit("CP0"), F.array_position(F.array(*[F.lit(t) for t in types]), F.col("p_type")).cast("string"))
    group = F.concat(division, (F.substring("p_brand", 7, 10).cast("int") % 3 + 1).cast("string"))
    rows = lines.select(month("l_shipdate").alias("period"), F.explode(F.array(F.lit("CP00"), division, group)).alias("coicop"), "l_extendedprice", "l_quantity").filter("coicop <> 'CP033'")
    return rows.groupBy("coicop", "period").agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value"), F.sum("l_extendedprice").alias("total"))


def patchy_regions(spark: SparkSession, folder: str) -> DataFrame:
    """regional_prices with nations of numbers 4, 9, ... pricing products of their own, and NATION_7 three products at most."""
    p = regional_prices(spark, folder)
    island = F.substring("region", 8, 10).cast("int") % 5 == 4
    p = p.withColumn("product", F.when(island, F.concat(F.lit("island|"), "product")).otherwise(F.col("product")))
    return p.filter((F.col("region") != "NATION_7") | F.col("product").isin("Brand#1|PROMO", "Brand#2|PROMO", "Brand#3|PROMO"))


def outlet_relatives(spark: SparkSession, folder: str, start: int = 1996, end: int = 1999) -> DataFrame:
    """category, item_id, outlet (supplier), stratum, log_relative of brands that a supplier sold in both years."""
    rows = table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", F.year("l_shipdate").alias("year"), "l_quantity", "l_extendedprice").filter(F.col("year").isin(start, end))
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    j = rows.join(parts, rows.l_partkey == parts.p_partkey)

    def at(year: int) -> Column:
        return F.sum(F.when(F.col("year") == year, F.col("l_extendedprice"))) / F.sum(F.when(F.col("year") == year, F.col("l_quantity")))

    r = j.groupBy(F.col("p_type").alias("category"), F.concat_ws("|", F.col("l_suppkey").cast("string"), "p_brand", "p_type").alias("item_id"), F.col("l_suppkey").cast("string").alias("outlet")).agg(at(start).alias("a"), at(end).alias("b"))
    stratum = F.concat(F.lit("S"), (F.col("outlet").cast("long") % 2).cast("string"))
    return r.filter("a is not null and b is not null").select("category", "item_id", "outlet", stratum.alias("stratum"), F.ln(F.col("b") / F.col("a")).alias("log_relative"))
