"""Registry, revisions, contributions across a link, and the stream of quotes."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from basketry.operators import governance, seasonal
from basketry.streaming.panel import unit_value_stream


def month(k):
    return dt.date(2015 + k // 12, k % 12 + 1, 1)


def test_registry(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "x int, y string")
    assert governance.frame_hash(df) == governance.frame_hash(df.orderBy(F.desc("x")).repartition(3))
    assert governance.frame_hash(df) != governance.frame_hash(df.limit(2))
    first = governance.register_run(df, {"a": 1}, "l", path)
    assert governance.register_run(df, {"a": 1}, "l", path) == first and spark.read.parquet(path).count() == 1
    second = governance.register_run(df, {"a": 2}, "l", path, supersedes=first, reason="late returns")
    third = governance.register_run(df, {"a": 3}, "l", path, supersedes=second, reason="error")
    assert governance.vintage_chain(spark, path, second) == [first, second, third]
    with pytest.raises(ValueError):
        governance.register_run(df, {"a": 4}, "l", path, supersedes=third)


def test_revisions(spark):
    rows = [(month(k), v, 100.0 + k + 0.5 * v * (k % 2)) for k in range(10) for v in (1, 2, 3)]
    df = spark.createDataFrame(rows, "period date, vintage int, value double")
    got = governance.published_and_current(df).orderBy("period").collect()
    assert [r["revision"] for r in got] == [float(k % 2) for k in range(10)]
    bias = governance.revision_bias(df).first()
    assert bias["n"] == 10 and bias["mean"] == 0.5 and math.isclose(bias["t"], 0.5 / (math.sqrt(2.5 / 9) / math.sqrt(10)))
    assert math.isclose(governance.student_tail(2.228, 10), 0.025, rel_tol=1e-3)


def test_contributions_add_up_across_the_link(spark):
    rows = [(c, month(k), 100.0 * (1 + g) ** k) for c, g in (("a", 0.004), ("b", -0.002), ("d", 0.01)) for k in range(40)]
    components = spark.createDataFrame(rows, "component string, period date, index double")
    weights = spark.createDataFrame([(c, y, w + 0.1 * (y - 2016)) for c, w in (("a", 2.0), ("b", 1.0), ("d", 3.0)) for y in (2016, 2017, 2018)], "component string, year int, weight double")
    aggregate = seasonal.chain_linked(components, weights)
    rate = {r["period"]: r["index"] for r in aggregate.collect()}
    start = spark.createDataFrame([(month(11), 100.0)], "period date, index double")
    got = governance.annual_contributions(components, weights, aggregate.unionByName(start)).groupBy("period").agg(F.sum("contribution").alias("c")).collect()
    assert len(got) >= 12
    for r in got:
        before = r["period"].replace(year=r["period"].year - 1)
        assert math.isclose(r["c"], (rate[r["period"]] / rate.get(before, 100.0) - 1) * 100, abs_tol=1e-9)


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d), "c", "i", 2.0 * d, 1.0) for d in (1, 2, 3)]
    spark.createDataFrame(rows, "ts timestamp, category string, item_id string, price double, quantity double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, category string, item_id string, price double, quantity double").parquet(f"{tmp_path}/in")
    q = unit_value_stream(stream).writeStream.outputMode("update").format("memory").queryName("unit_values").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(expenditure) e, sum(quantity) q from unit_values").first()
    assert (got["e"], got["q"]) == (12.0, 3.0)
