"""Readers of quote collections, and seasonal methods on series with a known truth."""

import datetime as dt
import math

import numpy as np
import pytest

from basketry.operators import seasonal
from basketry.sources import readers


def month(k):
    return dt.date(2015 + k // 12, k % 12 + 1, 1)


def write(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize(("sep", "encoding"), [(",", "utf-8"), (";", "cp1252"), ("\t", "utf-8-sig"), ("|", "utf-8")])
def test_csv_is_sniffed(spark, tmp_path, sep, encoding):
    text = "\n".join(sep.join(r) for r in [("Date", "Category", "Item ID", "Price"), ("2020-01-01", "Café", "7", "1.5"), ("2020-02-01", "Café", "7", "x")]) + "\n"
    path = write(tmp_path, "a.csv", text.encode(encoding))
    how = readers.sniffed(spark, path)
    assert (how["sep"], how["encoding"], how["header_row"]) == (sep, encoding, 0)
    got = readers.standardised(readers.read_table(spark, path)).orderBy("period").collect()
    assert [tuple(r.asDict()[c] for c in ("period", "category", "item_id", "price")) for r in got] == [(dt.date(2020, 1, 1), "Café", "7", 1.5), (dt.date(2020, 2, 1), "Café", "7", None)]


def test_rows_above_the_header_are_left_out(spark, tmp_path):
    path = write(tmp_path, "b.csv", b"Collection of prices\n\nperiod,item,price\n2020-01-01,a,2\n2020-02-01,a,3\n")
    df = readers.read_table(spark, path)
    assert df.columns == ["period", "item", "price"] and sorted(r["price"] for r in df.collect()) == ["2", "3"]


def test_other_formats_are_refused(spark):
    with pytest.raises(ValueError):
        readers.read_table(spark, "/tmp/x.xlsx")


def test_category_has_fewer_values(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 3.0)], "product_class string, item_group string, price double")
    assert readers.mapping_of(df) == {"price": "price", "item_id": "product_class", "category": "item_group"}


def test_columns_are_told_by_what_they_hold(spark):
    rows = [(f"2020-{m:02d}-01", "AB"[i % 2], f"i{i}", str(10.0 + i + m / 100), str(float((i * 7 + m * 3) % 9 + 1))) for m in range(1, 7) for i in range(6)]
    df = spark.createDataFrame([(*r[:3], str(float(r[3]) * float(r[4])), r[4], r[3], "kg") for r in rows], "when string, what string, `which one` string, spent string, `how many` string, cost string, unit string")
    got = readers.suggested(df)
    assert {f: c for f, (c, _) in got.items()} == {"unit": "unit", "period": "when", "category": "what", "item_id": "which one", "price": "cost", "quantity": "how many", "expenditure": "spent"}
    assert got["unit"][1] == got["period"][1] == got["price"][1] == 1.0
    named = readers.mapping_of(df.withColumnRenamed("cost", "Price"))
    assert (named["price"], named["quantity"], named["expenditure"]) == ("Price", "how many", "spent")
    assert readers.mapping_of(df.select("when", "cost")) == {"period": "when", "price": "cost"}
    assert readers.mapping_of(df.select("when", "cost", "spent")) == {"period": "when"}  # two numbers and no product


def test_files_without_a_header_keep_their_rows(spark, tmp_path):
    path = write(tmp_path, "h.csv", b"2020-01-01,a,2\n2020-02-01,a,3\n2020-03-01,b,4\n")
    assert readers.sniffed(spark, path)["header_row"] == -1
    df = readers.read_table(spark, path)
    assert df.columns == ["c1", "c2", "c3"] and df.count() == 3
    assert readers.mapping_of(df) == {"period": "c1", "item_id": "c2", "price": "c3"}
    assert not readers.headerless("2020,1\n2021,2\n", ",") and not readers.headerless("when,x\n2020-01-01,2\n", ",")


def test_malformed_rows_are_told(spark, tmp_path):
    path = write(tmp_path, "m.csv", b"period,item,price\n2020-01-01,a,2\n2020-02-01,a\n2020-03-01,a,3,4\n2020-04-01,b,5\n")
    assert sorted(r["price"] for r in readers.read_table(spark, path).collect()) == ["2", "5"]
    assert readers.read_table(spark, path).select("price").count() == 2
    assert {r["line"] for r in readers.malformed_rows(spark, path).collect()} == {"2020-02-01,a", "2020-03-01,a,3,4"}


def test_body_rows_that_repeat_the_preamble_stay(spark, tmp_path):
    path = write(tmp_path, "p.csv", b"note,x\na,b,c\n1,2,3\na,b,c\n4,5,6\n")
    df = readers.read_table(spark, path)
    assert df.columns == ["a", "b", "c"] and sorted(r["a"] for r in df.collect()) == ["1", "4", "a"]


def test_price_paid(spark, tmp_path):
    def record(price="200000", date="2024-01-05 00:00", kind="T", cat="A", status="A", paon="1"):
        return ",".join(f'"{x}"' for x in ("{id}", price, date, "OL1 1AA", kind, "N", "F", paon, "", "HIGH ST", "", "T", "D", "C", cat, status))

    rows = [record(), record(), record(price="x"), record(status="D"), record(cat="B"), record(kind="O"), record(price="5"), record(paon="2")]
    sales, counts = readers.price_paid(spark, write(tmp_path, "pp.csv", "\n".join(rows).encode()))
    assert {r["rule"]: r["records"] for r in counts.collect()} == {"unreadable": 1, "deleted": 1, "category_b": 1, "other_type": 1, "price_bounds": 1, "duplicate": 1}
    assert sorted((r["period"], r["price"]) for r in sales.collect()) == [(dt.date(2024, 1, 1), 200000.0)] * 2


def test_season_is_recovered(spark):
    rng = np.random.default_rng(0)
    t = np.arange(96)
    season = 0.1 * np.sin(2 * np.pi * t / 12)
    y = np.exp(4.6 + 0.002 * t + season + rng.normal(0, 0.002, 96))
    df = spark.createDataFrame([("s", month(k), float(v)) for k, v in enumerate(y)] + [("short", month(k), 1.0) for k in range(5)], "series string, period date, index double")
    got = seasonal.adjust(df).orderBy("period").collect()
    assert {r["series"] for r in got} == {"s"}
    assert np.abs(np.log([r["seasonal"] for r in got]) - season).max() < 0.02
    assert np.abs(np.log([r["trend"] for r in got]) - 4.6 - 0.002 * t).max() < 0.02


def test_naive_forecasts_of_a_pure_season_are_exact(spark):
    df = spark.createDataFrame([("s", month(k), 100.0 + k % 12) for k in range(48)], "series string, period date, index double")
    got = {(r["method"], r["horizon"]): r["rmse"] for r in seasonal.naive_backtest(df).collect()}
    assert all(got["seasonal_naive", h] < 1e-9 for h in range(1, 13)) and got["random_walk", 1] > 0.5 and got["random_walk", 12] < 1e-9


def test_scenario_phases_in(spark):
    df = spark.createDataFrame([("s", month(k), 100.0) for k in range(24)], "series string, period date, index double")
    got = [r["scenario"] / r["baseline"] for r in seasonal.scenario_path(df, 10.0, 0.5, 4, 8).orderBy("step").collect()]
    assert np.allclose(got, np.exp(0.5 * math.log(1.1) * np.minimum(np.arange(1, 9) / 4, 1)))


def test_counter_seasonal_follows_the_category(spark):
    rows = [(month(k), "c", i, p * 1.01**k if not (i == "c" and k in (3, 4)) else None, 1.0) for k in range(8) for i, p in (("a", 1.0), ("b", 2.0), ("c", 4.0))]
    df = spark.createDataFrame([r for r in rows if r[3] is not None], "period date, category string, item_id string, price double, quantity double")
    got = {r["period"]: r["price_imputed"] for r in seasonal.counter_seasonal(df).filter("imputation is not null").collect()}
    assert set(got) == {month(3), month(4)} and all(math.isclose(v, 4 * 1.01 ** (3 + k)) for k, (_, v) in enumerate(sorted(got.items())))
