"""Publication tables, CSV and SDMX-ML: disclosure rules, round trips and refusals."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from basketry.sources import sinks
from basketry.sources.staging import shared_folder

DAY = datetime.date


@pytest.fixture
def path(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


@pytest.fixture
def index(spark):
    rows = [("a", 1, 100.0, None), ("b", 1, 100.0, None), ("All items", 1, 100.0, None), ("a", 2, 101.0, 2), ("b", 2, 99.5, 9), ("=c", 2, 98.0, 7), ("All items", 2, 100.2, None), ("a", 3, 102.0, 1), ("b", 3, 97.0, 2), ("=c", 3, None, 5), ("All items", 3, 99.0, None)]
    return spark.createDataFrame([(s, DAY(2024, m, 1), i, n) for s, m, i, n in rows], "series string, period date, index double, matched long")


def test_publication_rules(spark, index):
    got = {(r["series"], r["period"].month): r for r in sinks.publication_table(index).collect()}
    assert len(got) == 11
    assert {k for k, r in got.items() if r["suppressed"]} == {("a", 2), ("=c", 2), ("a", 3), ("b", 3)}
    assert got["=c", 2]["suppression_rule"].startswith("secondary") and got["a", 2]["suppression_rule"].startswith("primary")
    assert got["a", 2]["index"] is None and got["a", 2]["published"] == "suppressed"
    assert got["b", 2]["published"] == "99.500000" and got["=c", 3]["published"] == "" and got["a", 1]["published"] == "100.000000"
    assert not any(r["suppressed"] for (s, _), r in got.items() if s == "All items")


def test_further_series_carry_their_basis(spark, index):
    extra = spark.createDataFrame([("multilateral: All items", DAY(2024, 1, 1), 100.0, "geks, 25 periods"), ("multilateral: All items", DAY(2024, 2, 1), None, "geks")], "series string, period date, index double, basis string")
    got = sinks.publication_table(index, extra=extra).filter("basis <> ''").collect()
    assert [(r["series"], r["published"], r["suppressed"]) for r in got] == [("multilateral: All items", "100.000000", False)]


def test_wide(spark, index):
    wide = sinks.wide_publication(sinks.publication_table(index))
    assert wide.columns == ["period", "=c", "a", "b", "All items"]
    rows = {r["period"]: r for r in wide.collect()}
    assert rows["2024-02-01"]["a"] == "suppressed" and rows["2024-01-01"]["=c"] is None and rows["2024-03-01"]["All items"] == "99.000000"


def test_csv_round_trip(spark, index, path):
    table = sinks.publication_table(index)
    sinks.write_csv(table, path, sinks.stamp("r1", "h", {"least": 3}, headline=99), "provisional", order=["series", "period"])
    text = [r[0] for r in spark.read.text(path).collect()]
    assert text[0] == '# provenance {"data_vintage": "h", "headline": 99, "run_id": "r1", "settings": {"least": 3}}'
    assert text[1:3] == ["# provisional", "period,series,index,matched_items,basis,suppressed,suppression_rule,published"] and len(text) == 14
    back, told = sinks.read_csv(spark, path, "period date, series string, index double, matched_items double, basis string, suppressed boolean, suppression_rule string, published string")
    assert told["run_id"] == "r1" and back.count() == 11
    assert {r["series"] for r in back.collect()} == {"a", "b", "'=c", "All items"}  # a formula is made text
    want = {(r["series"].replace("=", "'="), r["period"], r["index"]) for r in table.collect()}
    assert {(r["series"], r["period"], r["index"]) for r in back.collect()} == want
    with pytest.raises(sinks.ExportError):
        table.select("series").write.text(f"{path}-plain")
        sinks.read_csv(spark, f"{path}-plain", "x string")


def test_csv_quotes(spark, path):
    odd = spark.createDataFrame([('a "quoted", cell', 1.5), (None, None)], "name string, x double")
    sinks.write_csv(odd, path, "{}")
    back, _ = sinks.read_csv(spark, path, "name string, x double")
    assert {tuple(r) for r in back.collect()} == {('a "quoted", cell', 1.5), (None, None)}


def test_sdmx_round_trip(spark, index, path):
    table = sinks.publication_table(index.withColumn("series", F.when(F.col("series") == "b", "b & <b>").otherwise(F.col("series"))))
    sinks.write_sdmx(table, path, sinks.stamp("r1", "h", {}), message="M1", prepared="2024-01-01T00:00:00", sender="S&T", base_period="2024-01")
    got = {(r["series"], r["period"]): (r["value"], r["status"]) for r in sinks.read_sdmx(spark, path).collect()}
    want = {}
    for r in table.collect():
        want[r["series"].replace("=c", "'=c"), f"{r['period']:%Y-%m}"] = (r["index"], "C" if r["suppressed"] else "M" if r["index"] is None else None)
    assert got == want and sinks.sdmx_problems(spark, path).count() == 0
    import xml.etree.ElementTree as tree

    text = "\n".join(r[0] for r in spark.read.text(path).collect())
    root = tree.fromstring(text.encode())
    space = {k: v for k, v in sinks.NAMESPACES.items()}
    assert root.tag == f"{{{space['message']}}}GenericData"
    series = root.findall("message:DataSet/generic:Series", space)
    assert len(series) == 4 and all([c.tag.rpartition("}")[2] for c in s][:2] == ["SeriesKey", "Attributes"] for s in series)
    assert "r1" in root.find("message:DataSet/common:Annotations/common:Annotation/common:AnnotationText", space).text


def test_sdmx_problems(spark, path):
    spark.createDataFrame([('<Series><SeriesKey><Value id="SERIES" value="a"/></SeriesKey><Obs><ObsDimension value="2024-01"/></Obs><Obs><ObsDimension value="24"/><ObsValue value="1"/></Obs></Series>',)], "line string").write.text(path)
    assert {r["problem"] for r in sinks.sdmx_problems(spark, path).collect()} == {"neither value nor status", "no month", "no header"}
