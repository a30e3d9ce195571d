"""The data source of recorded answers: receipts, retries, stale answers, decoding and refusals."""

import datetime
import hashlib
import json

import pytest

from basketry.sources import fetch

DAY = datetime.date


def body(*pairs):
    return json.dumps({"observations": [{"period": p, "value": v} for p, v in pairs]})


@pytest.fixture
def root(spark, tmp_path):
    spark.dataSource.register(fetch.Recorded)
    return f"file://{tmp_path}/answers"


def test_receipts_and_stale_answers(spark, root):
    good = body(("2024-01", 1.5), ("2024-Q2", 2), ("2025", "3"), ("never", 4), ("2024-05", None))
    fetch.record(f"{root}/a/2024-06-01/1-200.json", good)
    fetch.record(f"{root}/b/2024-05-01/1-200.json", body(("2024-01", 7.0)))
    fetch.record(f"{root}/b/2024-06-01/1-503.json", "down")
    fetch.record(f"{root}/b/2024-06-01/2-200.json", "{not json")
    fetch.record(f"{root}/c/2024-06-01/1-429.json", "slow down")
    fetch.record(f"{root}/c/2024-06-01/2-200.csv", "Food prices\n2014-2016=100\nDate,Index\nJan-24,118.2\nFeb-24,\nMar-24,119\n")
    df = spark.read.format("recorded").load(root)
    assert df.rdd.getNumPartitions() == 3
    got = {}
    for r in df.collect():
        got.setdefault(r["dataset"], []).append(r)
    assert [(r["period"], r["value"]) for r in got["a"]] == [(DAY(2024, 1, 1), 1.5), (DAY(2024, 4, 1), 2.0), (DAY(2025, 1, 1), 3.0)]
    assert {(r["sha256"], r["stale"], r["attempts"], r["waited"]) for r in got["a"]} == {(hashlib.sha256(good.encode()).hexdigest(), False, 1, 0.0)}
    assert [(r["value"], r["fetched"], r["stale"], r["attempts"], r["waited"]) for r in got["b"]] == [(7.0, "2024-05-01", True, 2, 1.0)]
    assert [(r["period"], r["value"], r["attempts"]) for r in got["c"]] == [(DAY(2024, 1, 1), 118.2, 2), (DAY(2024, 3, 1), 119.0, 2)]


def test_refusals(spark, root):
    fetch.record(f"{root}/b/2024-05-01/1-200.json", body(("2024-01", 7.0)))
    for k in range(1, 5):
        fetch.record(f"{root}/b/2024-06-01/{k}-500.json", "down")
    fetch.record(f"{root}/b/2024-06-01/5-200.json", body(("2024-01", 8.0)))  # beyond the retries
    assert [r["value"] for r in spark.read.format("recorded").load(root).collect()] == [7.0]
    assert [r["value"] for r in spark.read.format("recorded").option("retries", 4).load(root).collect()] == [8.0]
    with pytest.raises(Exception, match="no readable answer"):
        spark.read.format("recorded").option("allowStale", "false").load(root).collect()


@pytest.mark.parametrize(("code", "day"), [("2020", DAY(2020, 1, 1)), ("2020-Q3", DAY(2020, 7, 1)), ("2020-11", DAY(2020, 11, 1)), ("Nov-20", DAY(2020, 11, 1)), ("2020-Q5", None), ("x", None), ("", None)])
def test_period_codes(code, day):
    assert fetch.period_of(code) == day
