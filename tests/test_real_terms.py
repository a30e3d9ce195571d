"""Deflation, parities, owner-occupied housing and tender prices on small fixtures, by hand."""

from datetime import date

import pytest

from basketry.operators import deflation, housing

SERIES = "series string, period date, value double"


def months(n, start=0, step=1):
    at = [start + step * k for k in range(n)]
    return [date(2000 + m // 12, m % 12 + 1, 1) for m in at]


def series(spark, *named):
    return spark.createDataFrame([(name, p, v) for name, ps, vs in named for p, v in zip(ps, vs, strict=True)], SERIES)


def nominal(spark, *named):
    return spark.createDataFrame([(name, d, p, v) for name, d, ps, vs in named for p, v in zip(ps, vs, strict=True)], "series string, deflator string, period date, value double")


def deflators(spark, *named):
    return series(spark, *named).withColumnsRenamed({"series": "deflator", "value": "index"})


def told(df):
    return {r["series"]: r["reason"] for r in df.collect()}


def test_frequencies_are_read_off_the_periods(spark):
    ones = [1.0] * 4
    s = series(spark, ("m", months(4), ones), ("q", months(4, step=3), ones), ("a", months(4, step=12), ones), ("gap", [*months(3), date(2000, 6, 1)], ones), ("one", months(1), [1.0]), ("twice", [date(2000, 1, 1)] * 2, [1.0, 2.0]), ("null", months(4), [1.0, None, float("nan"), 1.0]))
    got = {r["series"]: (r["periods"], r["shortest"], r["longest"], r["frequency"]) for r in deflation.frequencies(s).collect()}
    assert got == {"m": (4, 1, 1, "M"), "q": (4, 3, 3, "Q"), "a": (4, 12, 12, "A"), "gap": (4, 1, 3, None), "one": (1, None, None, None), "twice": (2, 0, 0, None), "null": (2, 3, 3, "Q")}


def test_only_whole_spans_are_converted(spark):
    s = series(spark, ("m", months(8, start=1), [float(k) for k in range(8)]), ("a", months(2, step=12), [1.0, 2.0]), ("gap", [date(2000, 1, 1), date(2000, 3, 1), date(2000, 4, 1)], [1.0] * 3))
    for how, want in {"mean": [3.0, 6.0], "last": [4.0, 7.0], "sum": [9.0, 18.0]}.items():
        rows = sorted(deflation.to_frequency(s, "Q", how).collect(), key=lambda r: r["period"])
        assert [(r["series"], r["period"], r["value"]) for r in rows] == [("m", date(2000, 4, 1), want[0]), ("m", date(2000, 7, 1), want[1])]
    assert told(deflation.conversion_refusals(s, "Q")) == {"a": "the series is annual, quarterly periods would be invented", "gap": "the series has steps of 1 to 2 months"}


def test_every_reason_for_a_refusal(spark):
    year, level = months(12), [100.0] * 12
    n = nominal(spark, ("good", "cpi", year, level), ("short", "cpi", year[:1], [1.0]), ("gap", "cpi", [year[0], year[1], year[4]], [1.0] * 3), ("unknown", "none", year, level), ("odd", "odd", year, level), ("quarters", "cpi", months(4, step=3), [1.0] * 4), ("zero", "zero", year, level), ("late", "late", year, level), ("two", "cpi", year[:6], level[:6]), ("two", "zero", year[6:], level[6:]), ("empty", "cpi", year, [None] * 12))
    d = deflators(spark, ("cpi", year, level), ("odd", [year[0], year[3], year[4]], [1.0] * 3), ("zero", year, [0.0, *level[1:]]), ("late", year[3:], level[3:]))
    want = {
        "short": "the series has fewer than two periods",
        "gap": "the series has steps of 1 to 3 months",
        "two": "the series names no deflator, or several",
        "unknown": "the deflator is unknown",
        "odd": "the deflator has steps of 1 to 3 months",
        "quarters": "the series is quarterly, the deflator monthly",
        "zero": "the deflator has values of 0 or less",
        "late": "the deflator lacks 3 periods of the series",
    }
    assert told(deflation.refusals(n, d, "2000")) == want
    assert told(deflation.refusals(n, d, "2000", allow_partial=True))["late"] == "of the reference 2000 the deflator has 9 of 12 periods"
    assert "late" not in told(deflation.refusals(n, d, "2000-06-01", allow_partial=True))
    assert told(deflation.refusals(n, d, "2001-06-01"))["good"] == "of the reference 2001-06-01 the deflator has 0 of 1 periods"
    assert {r["series"] for r in deflation.deflate(n, d, "2000").collect()} == {"good"}
    with pytest.raises(deflation.DeflationError, match="gap: the series has steps"):
        deflation.require(deflation.refusals(n, d, "2000"))
    deflation.require(deflation.refusals(n.filter("series = 'good'"), d, "2000"))


def test_real_values_growth_and_volume(spark):
    year = months(24)
    prices = [100.0] * 12 + [150.0] * 12
    n = nominal(spark, ("wage", "cpi", year, [200.0] * 12 + [330.0] * 12))
    d = deflators(spark, ("cpi", year, prices))
    real = deflation.deflate(n, d, "2000")
    rows = {r["period"]: r for r in real.collect()}
    assert rows[year[0]]["real"] == 200 and rows[year[12]]["deflator"] == 150 and rows[year[12]]["real"] == pytest.approx(220)
    g = {r["period"]: r for r in deflation.growth(real, 12).collect()}[year[12]]
    assert [g[c] for c in ("nominal_growth", "inflation", "real_growth", "approximation", "error")] == pytest.approx([65, 50, 10, 15, 5])
    v = {r["period"]: r["index"] for r in deflation.volume_index(real, "2000").collect()}
    assert v[year[0]] == 100 and v[year[23]] == pytest.approx(110)
    assert deflation.volume_index(real.filter("period < '2000-12-01'"), "2000").count() == 0
    label = deflation.labels(n, d.filter("period >= '2000-03-01'"), "2001", "real wage", allow_partial=True).collect()
    assert [(r["label"], r["left_out"]) for r in label] == [("wage, real wage in prices of 2001, deflated by cpi (2001 = 100), monthly", 2)]


def test_parities(spark):
    m, a = months(24), months(2, step=12)
    values = series(spark, ("x", m, [10.0] * 24), ("y", a, [10.0, 12.0]), ("z", m, [1.0] * 24), ("w", a, [1.0, 1.0]))
    ppp = series(spark, ("x", a, [2.0, 4.0]), ("y", a, [5.0, 4.0]), ("w", a, [-1.0, 1.0])).withColumnRenamed("value", "ppp")
    assert told(deflation.parity_refusals(values, ppp)) == {"x": "the series is monthly, the parity annual", "z": "there is no parity", "w": "the parity has values of 0 or less"}
    assert sorted(told(deflation.parity_refusals(values, ppp, broadcast_annual=True))) == ["w", "z"]
    got = {(r["series"], r["period"]): r["converted"] for r in deflation.convert(values, ppp, broadcast_annual=True).collect()}
    assert len(got) == 26 and got["x", m[0]] == 5 and got["x", m[23]] == 2.5 and got["y", a[1]] == 3
    short = ppp.filter("not (series = 'x' and period > '2000-06-01')")
    assert told(deflation.parity_refusals(values, short, broadcast_annual=True))["x"] == "the parity has fewer than two periods"
    rate = series(spark, ("x", a, [4.0, 4.0]), ("y", m, [1.0] * 24)).withColumnRenamed("value", "rate")
    assert {(r["series"], r["period"]): r["index"] for r in deflation.price_levels(ppp, rate).collect()} == {("x", a[0]): 50, ("x", a[1]): 100}


def test_nothing_in_nothing_out(spark):
    n, d = nominal(spark), deflators(spark)
    assert deflation.refusals(n, d, "2000").count() == deflation.deflate(n, d, "2000").count() == 0
    assert deflation.to_frequency(series(spark), "A").count() == housing.rebased(series(spark)).count() == 0


def test_owner_occupied_housing(spark):
    q = months(9, step=3)
    prices = series(spark, ("home", q, [100.0, 102.0, 104.0, 106.0, 110.0, 112.0, 114.0, 116.0, 121.0]), ("nil", q, [0.0] * 9))
    assert [r["series"] for r in housing.unbased(prices).collect()] == ["nil"]
    assert {r["series"] for r in housing.rental_equivalence(prices).collect()} == {"home"}
    land = series(spark, ("home", q[:8], [50.0] * 7 + [75.0]))
    got = sorted(housing.net_acquisitions(prices, 0.2, land).collect(), key=lambda r: r["period"])
    assert [got[k]["index"] for k in (0, 7, 8)] == [pytest.approx(100), pytest.approx((116 - 0.2 * 150) / 0.8), None]
    assert all(r["index"] == r["price"] for r in housing.net_acquisitions(prices).collect())
    with pytest.raises(housing.HousingError):
        housing.net_acquisitions(prices, 1.5, land)
    with pytest.raises(housing.HousingError):
        housing.net_acquisitions(prices, 0.2)
    rates = spark.createDataFrame([(p, 4.0) for p in q], "period date, rate double")
    u = sorted(housing.user_cost(prices, rates, years=2).collect(), key=lambda r: r["period"])
    assert u[0]["cost"] == pytest.approx(7) and u[0]["index"] == 100
    assert u[4]["expected"] == pytest.approx(10) and u[4]["cost"] == pytest.approx(110 * (4 + 3 - 10) / 100)
    assert u[8]["expected"] == pytest.approx(10) and u[8]["realised_cost"] == pytest.approx(121 * (7 - 10) / 100)
    assert [(r["series"], r["n"]) for r in housing.rate_gaps(prices.filter("series = 'home'"), rates.filter("period > '2000-01-01'")).collect()] == [("home", 1)]
    assert housing.user_cost(prices, rates.filter("period > '2000-01-01'")).count() == 0


def test_payments_leave_out_saving_and_part_periods(spark):
    rows = [("s", p, k, v) for p, vs in zip(months(3), [(10.0, 5.0), (12.0, None), (20.0, 10.0)], strict=True) for k, v in zip(("interest", "repairs"), vs, strict=True)]
    o = spark.createDataFrame(rows, "series string, period date, kind string, value double")
    assert sorted((r["period"].month, r["total"], r["index"]) for r in housing.payments(o).collect()) == [(1, 15, 100), (3, 30, 200)]
    with pytest.raises(housing.HousingError, match="Principal repaid"):
        housing.payments(o.unionByName(spark.createDataFrame([("s", months(1)[0], "Principal repaid", 1.0)], o.schema)))


def test_tender_prices_against_input_costs(spark):
    m = months(4)
    rates = [("b", m[0], "pipe", 1.0), ("b", m[1], "pipe", 2.0), ("b", m[1], "pipe", 4.0), ("b", m[1], "wall", 10.0), ("b", m[2], "wall", 11.0), ("b", m[3], "pipe", 6.0), ("b", m[3], "wall", 20.0), ("b", m[3], "sky", 9.0)]
    out = housing.output_price_index(spark.createDataFrame(rates, "series string, period date, item string, rate double"), {"pipe": 10.0, "wall": 2.0})
    assert {r["period"]: r["index"] for r in out.collect()} == {m[0]: None, m[1]: 100, m[2]: None, m[3]: 200}
    inputs = series(spark, ("b", m, [80.0, 100.0, 110.0, 125.0])).withColumnRenamed("value", "index")
    got = {r["period"]: (r["input"], r["output"], r["gap"]) for r in housing.output_over_input(inputs, out).collect()}
    assert got == {m[1]: (100, 100, 100), m[3]: (125, 200, 160)}
