"""Axioms and published values of the index formulae, and recovery of known truths."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.functions.formulas import BILATERAL, ELEMENTARY
from basketry.operators import domain, index, multilateral, quality
from basketry.plans import indices
from basketry.sources import panels


def month(k):
    return dt.date(2020 + k // 12, k % 12 + 1, 1)


def panel(spark, rows):
    """rows: (period number, category, item, price, quantity)."""
    data = [(month(t), c, i, p, q, None if p is None or q is None else p * q) for t, c, i, p, q in rows]
    return spark.createDataFrame(data, "period date, category string, item_id string, price double, quantity double, expenditure double")


def test_gaps_hold_the_level(spark):
    rows = [(0, "c", "a", 1.0, 1.0), (0, "c", "b", 2.0, 1.0), (1, "c", "a", None, None), (1, "c", "b", None, None), (2, "c", "a", 2.0, 1.0), (2, "c", "b", 4.0, 1.0), (3, "c", "a", 3.0, 1.0), (3, "c", "b", 6.0, 1.0)]
    got = [(r["index"], r["matched"]) for r in index.chained_index(panel(spark, rows)).orderBy("period").collect()]
    assert got[0] == (100.0, None) and got[1] == (100.0, 0) and got[2] == (100.0, 0)
    assert math.isclose(got[3][0], 150.0) and got[3][1] == 2


def test_axioms(spark):
    rng = np.random.default_rng(0)
    rows = []
    for g in range(60):
        for i in range(int(rng.integers(2, 8))):
            rows.append((f"g{g}", *[float(x) for x in rng.uniform(0.05, 50, 4)]))
    df = spark.createDataFrame(rows, "g string, p0 double, pt double, q0 double, qt double").withColumn("w", F.col("p0") * F.col("q0")).withColumn("qb", F.col("q0")).withColumn("sb", F.col("w"))
    swapped = df.select("g", F.col("pt").alias("p0"), F.col("p0").alias("pt"), F.col("qt").alias("q0"), F.col("q0").alias("qt"))
    f = df.groupBy("g").agg(*[F.expr(e).alias(f"e_{n}") for n, e in ELEMENTARY.items()], *[F.expr(e).alias(f"b_{n}") for n, e in BILATERAL.items()])
    back = swapped.groupBy("g").agg(*[F.expr(BILATERAL[n]).alias(f"r_{n}") for n in ("fisher", "tornqvist", "walsh", "marshall_edgeworth")], F.expr(ELEMENTARY["jevons"]).alias("r_jevons"))
    for r in f.join(back, "g").collect():
        assert r["e_harmonic"] <= r["e_jevons"] * (1 + 1e-12) <= r["e_carli"] * (1 + 1e-9)
        assert min(r["b_laspeyres"], r["b_paasche"]) <= r["b_fisher"] <= max(r["b_laspeyres"], r["b_paasche"])
        assert math.isclose(r["b_fisher"] * r["b_fisher_quantity"], r["b_value_ratio"], rel_tol=1e-9)
        for n in ("fisher", "tornqvist", "walsh", "marshall_edgeworth"):
            assert math.isclose(r[f"b_{n}"] * r[f"r_{n}"], 1.0, rel_tol=1e-9)
        assert math.isclose(r["e_jevons"] * r["r_jevons"], 1.0, rel_tol=1e-9)
        assert math.isclose(r["b_lowe"], r["b_laspeyres"], rel_tol=1e-9) and math.isclose(r["b_young"], r["e_young"], rel_tol=1e-9)


@pytest.fixture(scope="module")
def bouncing(spark):
    """Two items whose prices and quantities return to where they began."""
    rows = []
    for t in range(13):
        k = t % 6 if t < 12 else 0
        rows += [(t, "c", "a", 1.0 + 0.3 * k, 10.0 / (1 + k)), (t, "c", "b", 2.0 - 0.1 * k, 5.0 + k)]
    return panel(spark, rows)


def test_no_chain_drift(bouncing):
    for made in (multilateral.geks(bouncing), multilateral.geks(bouncing, "tornqvist"), multilateral.time_product_dummy(bouncing), multilateral.time_product_dummy(bouncing, weighted=True), multilateral.geary_khamis(bouncing)):
        rows = made.orderBy("period").collect()
        assert math.isclose(rows[0]["index"], 100.0) and math.isclose(rows[12]["index"], 100.0, rel_tol=1e-9)


def test_two_periods(spark):
    rows = [(t, "c", i, p, q) for t, i, p, q in ((0, "a", 1.0, 10.0), (0, "b", 2.0, 5.0), (0, "d", 4.0, 2.0), (1, "a", 1.2, 8.0), (1, "b", 1.9, 7.0), (1, "d", 4.0, 1.5))]
    p = panel(spark, rows)
    fisher = index.bilateral(p, "fisher").filter(F.col("period") == month(1)).first()["value"]
    assert math.isclose(multilateral.geks(p).filter(F.col("period") == month(1)).first()["index"], 100 * fisher, rel_tol=1e-12)
    jevons = index.links(p).filter("link is not null").first()["link"]
    assert math.isclose(multilateral.time_product_dummy(p).filter(F.col("period") == month(1)).first()["index"], 100 * jevons, rel_tol=1e-9)


def test_parities_are_recovered(spark):
    rng = np.random.default_rng(3)
    truth = {"A": 1.0, "B": 1.7, "C": 0.8, "D": 120.0}
    rows = []
    for i in range(30):
        base, q = float(rng.uniform(1, 50)), float(rng.uniform(1, 9))
        rows += [(r, f"p{i}", base * t, q, base * t * q) for r, t in truth.items() if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "region string, product string, price double, quantity double, expenditure double")
    for made in (domain.country_product_dummy(df, "A"), domain.country_product_dummy(df, "A", weighted=True), domain.spatial_geary_khamis(df, "A")):
        for r in made.collect():
            assert math.isclose(r["parity"], truth[r["region"]], rel_tol=1e-6)


def test_cascading_fill_has_the_loops_result(spark):
    rng = np.random.default_rng(5)
    rows, price = [], {}
    for t in range(12):
        for i in range(6):
            price[t, i] = None if t and rng.random() < 0.35 else float(10 * (i + 1) * 1.02**t * rng.uniform(0.95, 1.05))
            rows.append((t, "c", f"i{i}", price[t, i], 1.0))
    df = panel(spark, rows).withColumn("price_clean", F.col("price"))
    filled = dict(price)
    for t in range(1, 12):
        both = [math.log(price[t, i] / price[t - 1, i]) for i in range(6) if price[t, i] and price[t - 1, i]]
        for i in range(6):
            if price[t, i] is None and both and filled[t - 1, i]:
                filled[t, i] = filled[t - 1, i] * math.exp(sum(both) / len(both))
    for r in quality.impute_by_movement(df).collect():
        t = (r["period"].year - 2020) * 12 + r["period"].month - 1
        want = filled[t, int(r["item_id"][1:])]
        assert (r["price_imputed"] is None) == (want is None) and (want is None or math.isclose(r["price_imputed"], want, rel_tol=1e-9))


def test_repeat_sales_recover_the_market(spark):
    rng = np.random.default_rng(7)
    market = np.cumsum(np.concatenate(([0.0], rng.normal(0.02, 0.01, 11))))
    rows = []
    for i in range(300):
        base = float(rng.uniform(4, 6))
        for t in sorted(rng.choice(12, 2, replace=False).tolist()):
            rows.append((i, month(3 * t), float(np.exp(base + market[t]))))
    df = spark.createDataFrame(rows, "property_id long, period date, price double")
    for weighted in (False, True):
        got = [r["index"] for r in domain.repeat_sales(df, weighted).orderBy("period").collect()]
        assert np.allclose(got, 100 * np.exp(market - market[0]), rtol=1e-6)


def test_unit_value_bias(spark):
    rows = [(month(0), "export", "x", 1000.0, 100.0), (month(0), "export", "y", 900.0, 10.0), (month(1), "export", "x", 100.0, 10.0), (month(1), "export", "y", 9000.0, 100.0)]
    r = domain.unit_value_bias(spark.createDataFrame(rows, "period date, flow string, product string, value double, quantity double"), "export").orderBy("period").collect()[1]
    assert round(r["unit_value"], 3) == 478.947 and math.isclose(r["price"], 100.0)


def test_suppression(spark):
    rows = [("g", "a", 5.0, 2), ("g", "b", 9.0, 10), ("g", "c", 7.0, 10), ("h", "a", 5.0, 10), ("h", "b", 5.0, 10)]
    got = {(r["g"], r["k"]): r["suppressed"] for r in domain.suppress(spark.createDataFrame(rows, "g string, k string, v double, n int"), "g", "v", "n").collect()}
    assert got == {("g", "a"): "primary", ("g", "b"): None, ("g", "c"): "secondary", ("h", "a"): None, ("h", "b"): None}


@given(st.floats(0.1, 10))
@settings(max_examples=5, deadline=None)
def test_proportional_prices(spark, k):
    rows = [(0, "c", i, p, 1.0) for i, p in (("a", 1.0), ("b", 3.0))] + [(1, "c", i, p * k, 1.0) for i, p in (("a", 1.0), ("b", 3.0))]
    for name in ("jevons", "dutot", "carli", "fisher", "tornqvist"):
        assert math.isclose(index.links(panel(spark, rows), name).filter("link is not null").first()["link"], k, rel_tol=1e-9)


@pytest.mark.parametrize("name", ["ml_tpd", "ml_wtpd", "ml_gk"])
def test_multilateral_queries_cover_all_periods(spark, name):
    folder = "/root/testdata/sf0.001"
    want = {r["period"] for r in multilateral.unit_value_panel(panels.sparse_panel(spark, folder)).select("period").distinct().collect()}
    got = {r["period"]: r["index"] for r in indices.queries()[name](spark, folder).collect()}
    assert set(got) == want and max(want) > dt.date(1998, 1, 1)
    assert all(x > 0 for x in got.values())


def test_time_product_dummy_over_all_periods(spark):
    folder = "/root/testdata/sf0.001"
    cells = multilateral.unit_value_panel(panels.sparse_panel(spark, folder)).collect()
    times, items = sorted({r["period"] for r in cells}), sorted({r["item_id"] for r in cells})
    x = np.zeros((len(cells), len(times) - 1 + len(items)))
    for k, r in enumerate(cells):
        if t := times.index(r["period"]):
            x[k, t - 1] = 1
        x[k, len(times) - 1 + items.index(r["item_id"])] = 1
    effects = np.linalg.lstsq(x, np.log([r["price"] for r in cells]), rcond=None)[0]
    got = {r["period"]: r["index"] for r in indices.queries()["ml_tpd"](spark, folder).collect()}
    assert len(got) == len(times)
    assert all(math.isclose(got[t], 100 * math.exp(e), rel_tol=1e-5) for t, e in zip(times[1:], effects))
