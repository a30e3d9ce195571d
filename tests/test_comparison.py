"""Multilateral indices beside each other, on small fixtures."""

import math
from datetime import date

import pytest

from basketry.operators import comparison, multilateral

PANEL = "category string, period date, item_id string, price double, quantity double, expenditure double"


def months(n, start=0):
    return [date(2000 + m // 12, m % 12 + 1, 1) for m in range(start, start + n)]


def panel(spark, rows):
    return spark.createDataFrame([(c, p, i, float(v), float(q), float(v * q)) for c, p, i, v, q in rows], PANEL)


def moving(n, items=4, category="c"):
    """Items whose prices all move alike, so every method gives their common level."""
    level = [1 + 0.02 * k + 0.1 * math.sin(k) for k in range(n)]
    return [(category, p, f"{category}{i}", (i + 1) * x, 5 + (i * 7 + k) % 3) for k, (p, x) in enumerate(zip(months(n), level, strict=True)) for i in range(items)], [100 * x / level[0] for x in level]


def by_period(df, column="index"):
    return [r[column] for r in sorted(df.collect(), key=lambda r: r["period"])]


def test_windows_start_in_a_month_and_where_they_are_full():
    assert comparison.anchors(months(26), 12, 25) == [0, 11, 23]
    assert comparison.anchors(months(8), 12, 4) == [0, 3, 6]
    assert comparison.anchors(months(1), 12, 25) == [0] and comparison.anchors([], 12, 25) == [0]


@pytest.mark.parametrize("splice", ["fbew", "fbmw"])
def test_common_movement_is_found_by_every_extension(spark, splice):
    rows, want = moving(15)
    got = comparison.extend_fixed_base(panel(spark, rows), splice, window=9)
    assert by_period(got) == pytest.approx(want)
    assert by_period(got, "spread") == pytest.approx([0.0] * 15, abs=1e-9)
    assert by_period(got, "anchor")[:3] == [date(2000, 1, 1)] * 3 and by_period(got, "anchor")[-1] == date(2000, 12, 1)


def test_fixed_base_is_the_index_of_the_window_itself(spark):
    rows = [("c", p, f"i{i}", 1 + ((i * 5 + k * 3) % 7) / 10, 1 + (i + 2 * k) % 4) for k, p in enumerate(months(5)) for i in range(6)]
    p = panel(spark, rows)
    level = by_period(comparison.extend_fixed_base(p, "fbew"))
    move = by_period(comparison.extend_fixed_base(p, "fbmw"))
    for k in range(1, 5):
        part = by_period(multilateral.geks(p.filter(f"period <= '{months(5)[k]}'")))
        assert level[k] == pytest.approx(part[k])
        assert move[k] / move[k - 1] == pytest.approx(part[k] / part[k - 1])


def test_a_window_that_does_not_compare_leaves_null(spark):
    rows, want = moving(4)
    lone = [(c, p, f"other{i}" if p == months(4)[2] else i, v, q) for c, p, i, v, q in rows]
    for splice in ("fbew", "fbmw"):
        got = by_period(comparison.extend_fixed_base(panel(spark, lone), splice))
        assert got == [100, pytest.approx(want[1]), None, None]


def test_seasons_are_compared_with_themselves(spark):
    summer = [("c", date(y, m, 1), f"s{m}{i}", (y - 1999) * 10 * (i + 1), 2) for y in (2000, 2001, 2002) for m in range(1, 13) for i in range(2)]
    got = {r["period"]: r for r in comparison.seasonal(panel(spark, summer)).collect()}
    assert got[date(2000, 3, 1)]["year_over_year"] is None and got[date(2001, 3, 1)]["year_over_year"] == pytest.approx(200)
    assert got[date(2002, 3, 1)]["level"] == pytest.approx(300) and got[date(2002, 3, 1)]["year_over_year"] == pytest.approx(150)
    assert got[date(2001, 11, 1)]["rolling_year"] is None and got[date(2001, 12, 1)]["rolling_year"] == pytest.approx(200)
    step = math.exp((11 * math.log(2) + math.log(1.5)) / 12)
    assert got[date(2002, 1, 1)]["rolling_year"] == pytest.approx(200 * step)
    with pytest.raises(ValueError):
        comparison.seasonal(panel(spark, summer), per_year=7)


def test_seasons_left_out_are_named(spark):
    rows = [("c", date(y, 1, 1), f"i{i}", 1 + i, 1) for y in (2000, 2001) for i in range(3)]
    rows += [("c", date(2000, 2, 1), f"i{i}", 1, 1) for i in range(3)] + [("c", date(y, 3, 1), f"y{y}{i}", 1, 1) for y in (2000, 2001) for i in range(3)]
    p = panel(spark, rows)
    assert {r["season"]: r["reason"] for r in comparison.skipped_seasons(p).collect()} == {2: "there is one year of it only", 3: "no period compares with all others"}
    assert {r["season"] for r in comparison.seasonal(p).collect()} == {1}


def test_groups_on_their_own_and_together(spark):
    a, want = moving(5, category="a")
    flat = [("b", p, f"b{i}", 3, 4) for p in months(5) for i in range(3)]
    lone = [("z", p, f"z{p}{i}", 3, 4) for p in months(5) for i in range(3)]
    p = panel(spark, a + flat + lone)
    got = {}
    for r in comparison.by_group(p).collect():
        got.setdefault(r["series"], {})[r["period"]] = r["index"]
    assert set(got) == {"a", "b", "All items"}
    assert list(dict(sorted(got["a"].items())).values()) == pytest.approx(want)
    assert all(v == pytest.approx(100) for v in got["b"].values())
    last = months(5)[-1]
    assert 100 < got["All items"][last] < got["a"][last]
    assert [(r["category"], r["periods"]) for r in comparison.skipped_groups(p).collect()] == [("z", 5)]
    shares = {r["category"]: (r["items"], r["always"], r["share"]) for r in comparison.matched_share(p).collect()}
    assert shares == {"a": (4, 4, 1.0), "b": (3, 3, 1.0), "z": (15, 0, 0.0)}


def test_drift_of_a_sale_that_everyone_buys(spark):
    prices, quantities = [1.0, 0.5, 1.0, 1.0], [10.0, 100.0, 2.0, 10.0]
    rows = [("c", p, "sale", v, q) for p, v, q in zip(months(4), prices, quantities, strict=True)] + [("c", p, "calm", 1.0, 10.0) for p in months(4)]
    p = panel(spark, rows)
    got = sorted(comparison.drift(p, multilateral.geks(p, "tornqvist")).collect(), key=lambda r: r["period"])
    assert got[-1]["multilateral"] == pytest.approx(100) and not got[0]["beyond"]
    w = [10 / 20, 50 / 60, 2 / 12, 10 / 20]
    link = [0.5 * (w[k] + w[k + 1]) * math.log(prices[k + 1] / prices[k]) for k in range(3)]
    assert got[-1]["chained"] == pytest.approx(100 * math.exp(sum(link))) and got[-1]["beyond"] and got[-1]["drift"] < -1


def test_comparison_keeps_methods_that_fail(spark):
    index = "period date, index double"
    good = spark.createDataFrame([(p, 100 * 1.01**k) for k, p in enumerate(months(13))], index)
    flat = spark.createDataFrame([(p, 100.0) for p in months(13)], index)
    cut = spark.createDataFrame([(p, 100.0 if k < 12 else None) for k, p in enumerate(months(13))], index)
    t = comparison.compare({"good": good, "flat": flat, "cut": cut, "none": good.limit(0)})
    got = {r["method"]: (r["final_level"], r["annualised"], r["reason"]) for r in t.collect()}
    assert got["good"] == (pytest.approx(100 * 1.01**12), pytest.approx((1.01**12 - 1) * 100), None)
    assert got["cut"] == (None, None, "the last window does not compare") and got["none"] == (None, None, "no period compares with all others")
    s = comparison.spread(t).collect()[0]
    assert s["computed"] == 2 and s["level_spread"] == pytest.approx(s["level_max"] - 100) and s["rate_spread"] == pytest.approx(got["good"][1])
    assert comparison.spread(t.filter("method = 'none'")).collect()[0]["computed"] == 0
