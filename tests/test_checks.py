"""Hedonic diagnostics and smoothing against least squares and recursions by hand."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import hedonic, hedonic_checks, projections

DAY = datetime.date


@pytest.fixture(scope="module")
def homes(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        t, area, rooms, county = int(rng.integers(0, 6)), float(rng.uniform(30, 200)), float(rng.integers(1, 6)), f"c{rng.integers(0, 40)}"
        price = math.exp(5 + 0.8 * math.log(area) + 0.05 * rooms + 0.03 * t + int(county[1:]) / 50 + rng.normal(0, 0.1))
        rows.append((f"h{i}", DAY(2020, t + 1, 1), price, area, rooms, county, "ab"[i % 2]))
    return spark.createDataFrame(rows + [("x", DAY(2020, 1, 1), None, 50.0, 1.0, "c0", "a")], "property_id string, period date, price double, area double, rooms double, county string, kind string")


def matrix(homes, *columns, categorical=(), time=True, log=True):
    rows = [r for r in homes.collect() if r["price"]]
    cols = [np.ones(len(rows))] + [np.array([math.log(r[c]) if log else r[c] for r in rows]) for c in columns]
    for c in categorical:
        cols += [np.array([float(r[c] == v) for r in rows]) for v in sorted({r[c] for r in rows})[1:]]
    if time:
        cols += [np.array([float(r["period"] == p) for r in rows]) for p in sorted({r["period"] for r in rows})[1:]]
    return rows, np.column_stack(cols), np.log([r["price"] for r in rows])


def test_absorbed_factor_equals_its_dummies(homes):
    index, beta = hedonic_checks.absorbed_index(homes, ["area"], "county")
    rows, x, y = matrix(homes, "area", categorical=["county"])
    want = np.linalg.lstsq(x, y, rcond=None)[0]
    assert beta["area"] == pytest.approx(want[1])
    assert [r["index"] for r in index.orderBy("period").collect()] == pytest.approx([100, *(100 * np.exp(want[-5:]))])
    assert max(r["residual"] for r in hedonic_checks.absorbed_residuals(homes, index, beta, "county").collect()) < 1e-8
    with pytest.raises(hedonic_checks.HedonicError):
        hedonic_checks.absorbed_index(homes.limit(8), ["area"], "property_id")


def test_inflation(homes):
    got = {r["name"]: r["vif"] for r in hedonic_checks.inflation(homes, ["area", "rooms"], ["kind"]).collect()}
    _, x, _ = matrix(homes, "area", "rooms", categorical=["kind"])
    for k, name in ((1, "area"), (2, "rooms"), (3, "kind=b")):
        other = np.delete(x, k, 1)
        res = x[:, k] - other @ np.linalg.lstsq(other, x[:, k], rcond=None)[0]
        assert got[name] == pytest.approx(((x[:, k] - x[:, k].mean()) ** 2).sum() / (res**2).sum())
    twice = homes.withColumn("again", 2 * F.col("area")).withColumn("one", F.lit(3.0))
    got = {r["name"]: r["vif"] for r in hedonic_checks.inflation(twice, ["area", "again", "rooms", "one"], time=None, log=False).collect()}
    assert got["area"] == got["again"] == math.inf and got["rooms"] < 2 and got["one"] is None


def test_condition_and_leverage(homes):
    _, x, _ = matrix(homes, "area", categorical=["kind"])
    assert hedonic_checks.condition_number(homes, ["area"], ["kind"]) == pytest.approx(np.linalg.cond(x / np.abs(x).max(0)))
    rows, x, _ = matrix(homes, "area", categorical=["kind"])
    h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    got = {r["property_id"]: r["leverage"] for r in hedonic_checks.leverage(homes, ["area"], ["kind"]).collect()}
    assert len(got) == 400 and all(got[r["property_id"]] == pytest.approx(v) for r, v in zip(rows, h, strict=True))
    assert sum(got.values()) == pytest.approx(x.shape[1])


def test_stability_equals_fits_by_window(homes):
    got = {(r["first"], r["name"]): r["coefficient"] for r in hedonic_checks.stability(homes, ["area"], ["kind"], window=3).collect()}
    periods = [DAY(2020, m, 1) for m in range(1, 7)]
    assert {k[0] for k in got} == set(periods[:4])
    for a in range(4):
        found, _ = hedonic.fit(homes.filter(F.col("period").isin(periods[a : a + 3])), ["area"], ["kind"])
        for name in ("area", "kind=b"):
            assert got[periods[a], name] == pytest.approx(found.beta[found.names.index(name)])


@pytest.mark.parametrize("power", [0.5, 0.0, -0.3])
def test_box_cox_power_is_found(spark, power):
    rng = np.random.default_rng(3)
    x = rng.uniform(1, 5, 800)
    v = 3 + 0.5 * x + rng.normal(0, 0.05, 800) if power >= 0 else -(0.2 + 0.05 * x + rng.normal(0, 0.003, 800)) + 3
    price = np.exp(v) if power == 0 else (1 + power * v) ** (1 / power)
    df = spark.createDataFrame([(float(p), float(a)) for p, a in zip(price, x, strict=True)], "price double, a double")
    found = hedonic_checks.box_cox_power(df, ["a"])

    def likelihood(p):
        y = np.log(price) if abs(p) < 1e-12 else (price**p - 1) / p
        d = np.column_stack([np.ones(800), x])
        rss = ((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum()
        return -400 * np.log(rss / 800) + (p - 1) * np.log(price).sum()

    assert likelihood(found) >= max(likelihood(found + e) for e in (-0.01, 0.01, -0.001, 0.001)) - 1e-6
    assert found == pytest.approx(power, abs=0.15)


# --- smoothing ---


def monthly(spark, names=("s", "t"), n=60):
    rng = np.random.default_rng(5)
    rows = [(s, DAY(2010 + k // 12, k % 12 + 1, 1), float(100 * math.exp(0.003 * k + 0.05 * math.sin(k * math.pi / 6) + rng.normal(0, 0.01)))) for s in names for k in range(n)]
    return spark.createDataFrame(rows, "series string, period date, index double")


def test_smoothing_by_hand(spark):
    series = monthly(spark, ("s",), 50)
    y = [math.log(r["index"]) for r in series.orderBy("period").collect()]
    grid = projections.smoothing_grid(spark, (0.3,), (0.1,), gammas=(0.2,))
    got = {(r["id"], r["k"]): r for r in projections.smoothed(series, grid).collect()}
    for g in grid.collect():
        m1, m2 = np.mean(y[:12]), np.mean(y[12:24])
        b = (m2 - m1) / 12 if g["phi"] else 0.0
        level, s, sse = m1 + 5.5 * b, [v - m1 if g["gamma"] >= 0 else 0.0 for v in y[:12]], 0.0
        for k in range(12, 50):
            e = y[k] - level - g["phi"] * b - s[k % 12]
            level, b = level + g["phi"] * b + g["alpha"] * e, g["phi"] * b + g["beta"] * e
            s[k % 12] += max(g["gamma"], 0) * e
            sse += e * e
            r = got[g["id"], k + 1]
            assert (r["l"], r["b"], r["sse"], r["e"]) == pytest.approx((level, b, sse, e)) and r["s"] == pytest.approx(s)


def test_backtest_knows_no_future(spark):
    """An origin's forecasts do not change when later values do."""
    series = monthly(spark)
    changed = series.withColumn("index", F.when(F.col("period") >= "2014-01-01", F.col("index") * 3).otherwise(F.col("index")))
    early = lambda df: {(r["series"], r["k"], r["horizon"]): round(r["error"], 10) for r in projections.backtest(df, horizons=3).filter("k + horizon <= 48").collect()}
    assert early(series) == early(changed) and len(early(series)) == 2 * (12 + 11 + 10)


def test_seasonal_smoothing_beats_no_season(spark):
    got = projections.accuracy(projections.backtest(monthly(spark), projections.smoothing_grid(spark), horizons=6)).collect()
    flat = projections.accuracy(projections.backtest(monthly(spark), projections.smoothing_grid(spark, gammas=()), horizons=6)).collect()
    assert np.mean([r["rmse"] for r in got]) < 0.6 * np.mean([r["rmse"] for r in flat])


def test_diebold_mariano_by_hand(spark):
    rng = np.random.default_rng(9)
    rows = [("s", k, h, float(rng.normal(0, 1)), float(rng.normal(0, 1.5))) for k in range(24) for h in (1, 4)]
    got = {r["horizon"]: r for r in projections.diebold_mariano(spark.createDataFrame(rows, "series string, k int, horizon int, error double, benchmark double")).collect()}
    for h in (1, 4):
        d = np.array([b * b - e * e for _, k, hh, e, b in rows if hh == h])
        c, n = d - d.mean(), len(d)
        v = c @ c / n + sum(2 * (1 - k / h) * (c[k:] @ c[:-k]) / n for k in range(1, h))
        assert got[h]["statistic"] == pytest.approx(d.mean() / math.sqrt(v / n) * math.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n))
    assert projections.diebold_mariano_p(0.0, 24) == pytest.approx(0.5, abs=1e-6) and projections.diebold_mariano_p(2.069, 24) == pytest.approx(0.025, abs=2e-4)


def test_residual_tests(spark):
    rng = np.random.default_rng(1)
    e = rng.normal(0, 1, 80)
    got = projections.residual_tests(spark.createDataFrame([("s", k, float(v)) for k, v in enumerate(e)], "series string, k int, e double"), lags=5).first()
    c, n = e - e.mean(), 80
    q = n * (n + 2) * sum(((c[k:] @ c[:-k]) / (c @ c)) ** 2 / (n - k) for k in range(1, 6))
    skew, tails = (c**3).mean() / (c**2).mean() ** 1.5, (c**4).mean() / (c**2).mean() ** 2 - 3
    assert (got["ljung_box"], got["jarque_bera"]) == pytest.approx((q, n / 6 * (skew**2 + tails**2 / 4)))


@pytest.mark.parametrize(("x", "df", "p"), [(3.841, 1, 0.05), (5.991, 2, 0.05), (7.815, 3, 0.05), (21.026, 12, 0.05), (11.070, 5, 0.05), (0.0, 3, 1.0)])
def test_chi_square_tail(x, df, p):
    assert projections.chi_square_tail(x, df) == pytest.approx(p, abs=2e-5)
