"""User formulae, hedonic models, replacements and decoders against hand results."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.language import compile_formula, names_of
from basketry.operators import hedonic
from basketry.sources import decoders


@given(st.floats(-50, 50), st.floats(0.5, 50), st.sampled_from(["a + b * 2", "a / b - 1", "a // b", "a % b", "-a ** 2", "max(a, b, 3)", "min(a, b)", "abs(a) - +b", "round(a, 1) + round(b)"]))
@settings(max_examples=25, deadline=None)
def test_formulas_have_pythons_meaning(spark, a, b, text):
    got = spark.range(1).select(compile_formula(text, {"a": F.lit(a), "b": F.lit(b)}).alias("v")).first()["v"]
    assert math.isclose(got, eval(text, {"__builtins__": {}}, {"a": a, "b": b, "max": max, "min": min, "abs": abs, "round": round}), rel_tol=1e-9, abs_tol=1e-9)


@pytest.mark.parametrize("text", ["a.b", "a[0]", "__import__('os')", "lambda: 1", "a if b else 1", "'x'", "a and b", "f(a)", "a +", "round()", "a < b", "[a]"])
def test_other_code_is_refused(text):
    with pytest.raises(ValueError):
        names_of(text)


def test_unknown_names_are_refused():
    assert names_of("a + b") == {"a", "b"}
    with pytest.raises(ValueError):
        names_of("a + b", {"a"})


def test_a_missing_value_gives_null(spark):
    none = F.lit(None).cast("double")
    row = spark.range(1).select(compile_formula("max(a, 1)", {"a": none}).alias("x"), compile_formula("1 / b", {"b": F.lit(0.0)}).alias("y")).first()
    assert row["x"] is None and row["y"] is None


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        t, area, kind = int(rng.integers(0, 6)), float(rng.uniform(40, 200)), "ab"[int(rng.integers(0, 2))]
        log = 1 + 0.8 * math.log(area) + 0.2 * (kind == "b") + 0.03 * t + float(rng.normal(0, 0.05))
        rows.append((i, dt.date(2020, 1 + t, 1), math.exp(log), area, kind))
    return spark.createDataFrame(rows, "property_id long, period date, price double, area double, kind string")


def test_hedonic_fit(homes):
    fit, base = hedonic.fit(homes, ["area"], ["kind"])
    rows = homes.toPandas()
    x = np.column_stack([np.ones(len(rows)), np.log(rows["area"]), rows["kind"] == "b", *[(rows["period"] == p) for p in sorted(rows["period"].unique())[1:]]]).astype(float)
    y = np.log(rows["price"].to_numpy())
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    inv = np.linalg.inv(x.T @ x)
    hc1 = np.sqrt(np.diag(inv @ (x.T * e**2) @ x @ inv) * len(y) / (len(y) - x.shape[1]))
    assert np.allclose(fit.beta, beta) and np.allclose(fit.errors, hc1, rtol=1e-6)
    assert math.isclose(fit.r2, 1 - e @ e / ((y - y.mean()) @ (y - y.mean())), rel_tol=1e-9)
    assert base == "2020-01-01" and abs(fit.beta[1] - 0.8) < 0.02
    levels = [r["index"] for r in hedonic.hedonic_index(homes, ["area"], ["kind"]).orderBy("period").collect()]
    assert np.allclose(levels, 100 * np.exp(0.03 * np.arange(6)), rtol=0.02)


def test_folds_leave_one_out(homes):
    got = {r["fold"]: (r["n"], r["rmse"]) for r in hedonic.cross_validate(homes, ["area"], ["kind"], key=F.pmod(F.col("property_id"), F.lit(4))).collect()}
    assert set(got) == {0, 1, 2, 3} and sum(n for n, _ in got.values()) == 600
    assert all(0.04 < e < 0.06 for _, e in got.values())


def out_of_sample(rows, names, folds):
    """The named method by hand: rows in order of period and property, dealt over folds in turn."""
    rows = sorted(rows, key=lambda r: (r["period"], r["property_id"]))
    column = {"const": lambda r: 1.0, "area": lambda r: math.log(r["area"])}
    x = np.array([[float(column[n](r) if n in column else r["kind"] == n or str(r["period"]) == n) for n in names] for r in rows])
    price = np.array([r["price"] for r in rows])
    y, folds = np.log(price), min(folds, len(rows))
    at = np.arange(len(rows)) % folds
    out = {}
    for f in range(folds):
        train, test = at != f, at == f
        if train.sum() <= x.shape[1]:
            continue
        keep = ~np.isclose(x[train], 0).all(0)
        predicted = x[test][:, keep] @ np.linalg.pinv(x[train][:, keep]) @ y[train]
        out[f] = (predicted - y[test], np.abs(np.exp(predicted) - price[test]) / price[test] * 100)
    return out


def check_folds(df, kinds, folds):
    names = ["const", "area", *kinds[1:], *sorted({str(r["period"]) for r in df.select("period").distinct().collect()})[1:]]
    want = out_of_sample(df.collect(), names, folds)
    got = {r["fold"]: r for r in hedonic.cross_validate(df, ["area"], ["kind"], folds).collect()}
    e, percent = (np.concatenate([w[i] for w in want.values()]) for i in (0, 1))
    for r in got.values():
        assert r["rmse_transformed"] == pytest.approx(np.sqrt(np.mean(e**2))) and r["mape_pct"] == pytest.approx(percent.mean()) and r["folds"] == len(got)
    for f, (e, percent) in want.items():
        assert (got[f]["n"], got[f]["rmse"], got[f]["mape"]) == (len(e), pytest.approx(np.sqrt(np.mean(e**2))), pytest.approx(percent.mean()))
    return got


def test_folds_are_dealt_in_turn_and_errors_are_in_levels_too(homes):
    """folds by position in the order of rows, percentage errors of prices, and both errors over all folds."""
    got = check_folds(homes.repartition(7, "area"), ["a", "b"], 5)
    assert [got[f]["n"] for f in range(5)] == [120] * 5
    assert [got[f]["n"] for got in [check_folds(homes.filter("property_id < 500").repartition(3), ["a", "b"], 7)] for f in range(7)] == [72] * 3 + [71] * 4


def test_levels_of_one_fold_only_are_left_out_of_its_model(spark):
    """a kind, a period and the first kind that only the fold itself has."""
    day = [dt.date(2020, m, 1) for m in (1, 2, 3)]
    rng = np.random.default_rng(4)
    rows = [(i, day[0 if i < 15 else 1], float(rng.uniform(100, 900)), float(rng.uniform(40, 200)), "bc"[i % 2]) for i in range(30)]
    rows[7] = (*rows[7][:4], "a")
    rows[14] = (*rows[14][:4], "d")
    rows.append((30, day[2], 500.0, 90.0, "b"))
    check_folds(spark.createDataFrame(rows, "property_id long, period date, price double, area double, kind string"), ["a", "b", "c", "d"], 5)


def test_folds_without_enough_other_rows_are_not_predicted(spark):
    """no more folds than rows, and no model of no more rows than columns; infinite prices are refused."""
    rows = [(i, dt.date(2020, 1, 1), 100.0 + 7 * i * i, 40.0 + 9 * i, "a") for i in range(4)]
    few = spark.createDataFrame(rows, "property_id long, period date, price double, area double, kind string")
    assert len(check_folds(few, ["a"], 9)) == 4
    got = hedonic.cross_validate(few.filter("property_id < 2"), ["area"], ["kind"], 9).collect()
    assert [tuple(r) for r in got] == [(f, 1, None, None, None, None, 2) for f in (0, 1)]
    with pytest.raises(ValueError, match="finite"):
        hedonic.cross_validate(few.withColumn("price", F.when(F.col("property_id") == 1, float("inf")).otherwise(F.col("price"))), ["area"], ["kind"])


def test_too_few_rows_are_refused(homes):
    with pytest.raises(ValueError):
        hedonic.fit(homes.limit(3), ["area"], ["kind"])


def test_replacements_chain(spark):
    day = [dt.date(2020, m, 1) for m in range(1, 5)]
    panel = spark.createDataFrame([(d, i, 10.0) for d in day for i in "abc"], "period date, item_id string, price double")
    ledger = spark.createDataFrame([("a", "b", day[1], 2.0), ("b", "c", day[2], 0.5)], "old_item string, new_item string, period date, quality_ratio double")
    got = sorted((r["period"].month, r["item_id"], r["replaced_item_id"], r["price"]) for r in hedonic.apply_ledger(panel, ledger).collect())
    assert got == [(1, "a", None, 10.0), (2, "a", "b", 5.0), (3, "a", "c", 10.0), (4, "a", "c", 10.0)]


def payload(spark, text):
    return spark.createDataFrame([("s", text)], "source string, payload string")


def test_json_stat(spark):
    cube = {
        "id": ["geo", "time"],
        "size": [2, 3],
        "dimension": {"geo": {"category": {"index": {"X": 0, "Y": 1}}}, "time": {"category": {"index": {"2020-01": 0, "2020-02": 1, "2020-03": 2}}}},
        "value": {"0": 1.0, "2": 3.0, "4": 5.0},
    }
    got = {(r["codes"]["geo"], r["codes"]["time"]): r["value"] for r in decoders.json_stat(payload(spark, json.dumps(cube))).collect()}
    assert got == {("X", "2020-01"): 1.0, ("X", "2020-03"): 3.0, ("Y", "2020-02"): 5.0}


def test_agencies(spark):
    bls = {"Results": {"series": [{"seriesID": "c", "data": [{"year": "2020", "period": "M03", "value": "1.5"}, {"year": "2020", "period": "M13", "value": "9"}]}]}}
    assert [tuple(r)[1:] for r in decoders.bls(payload(spark, json.dumps(bls))).collect()] == [("c", dt.date(2020, 3, 1), 1.5)]
    bank = [{"page": 1}, [{"indicator": {"id": "i"}, "country": {"id": "FR"}, "date": "2019", "value": 2.5}, {"indicator": {"id": "i"}, "country": {"id": "FR"}, "date": "2020", "value": None}]]
    assert [tuple(r)[1:] for r in decoders.world_bank(payload(spark, json.dumps(bank))).collect()] == [("i", "FR", dt.date(2019, 1, 1), 2.5)]
    imf = {"values": {"P": {"FR": {"2019": 1.0}}}}
    assert [tuple(r)[1:] for r in decoders.imf(payload(spark, json.dumps(imf))).collect()] == [("P", "FR", dt.date(2019, 1, 1), 1.0)]
    months = [{"date": "2020 FEB", "value": "3", "year": "2020", "month": "February", "quarter": ""}]
    assert [tuple(r)[1:] for r in decoders.ons(payload(spark, json.dumps({"years": [{"date": "2020", "value": "9", "year": "2020"}], "quarters": [], "months": months}))).collect()] == [(dt.date(2020, 2, 1), 3.0)]
    oecd = {"data": {"dataSets": [{"series": {"0:0": {"observations": {"1": [7.0, 0]}}}}], "structure": {"dimensions": {"observation": [{"id": "TIME_PERIOD", "values": [{"id": "2020-01"}, {"id": "2020-02"}]}]}}}}
    assert [tuple(r)[1:] for r in decoders.oecd(payload(spark, json.dumps(oecd))).collect()] == [("0:0", dt.date(2020, 2, 1), 7.0)]


def test_codes(spark):
    df = spark.createDataFrame([("2020",), ("2020-Q3",), ("2020M11",), ("2020-13",), ("x",)], "c string")
    assert [r[0] for r in df.select(decoders.period_start(F.col("c"))).collect()] == [dt.date(2020, 1, 1), dt.date(2020, 7, 1), dt.date(2020, 11, 1), None, None]
    codes = spark.createDataFrame([("CP00",), ("CP01",), ("CP011",)], "c string")
    assert [r[0] for r in codes.select(decoders.hicp_parent(F.col("c"))).collect()] == [None, "CP00", "CP01"]
    assert [r[0] for r in decoders.leaf_codes(codes.select(F.col("c").alias("code"))).orderBy("code").collect()] == ["CP00", "CP011"]


def test_audit_chain(spark):
    import hashlib

    rows, before = [], None
    for k in range(4):
        h = hashlib.sha256(f"{before or ''}|event {k}".encode()).hexdigest()
        rows.append((k, f"event {k}", before, h))
        before = h
    rows[2] = (2, "changed", rows[2][2], rows[2][3])
    got = decoders.audit_chain(spark.createDataFrame(rows, "seq long, content string, prev_hash string, hash string")).filter("broken").collect()
    assert [r["seq"] for r in got] == [2]
