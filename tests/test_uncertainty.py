"""Resampling designs, sensitivity and vintages: rules, refusals and comparisons by hand."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import domain, resampling, scenarios, vintages

DAY = datetime.date
DESIGN = resampling.Design("outlet", "stratum")


def sample(spark, strata=2, outlets=6, quotes=5, seed=0, between=0.05, within=0.05):
    rng = np.random.default_rng(seed)
    rows = [("c", f"{h}-{o}-{q}", f"o{o}", f"s{h}", float(e + rng.normal(0, within))) for h in range(strata) for o in range(outlets) for e in [rng.normal(0.05, between)] for q in range(quotes)]
    return spark.createDataFrame(rows, "category string, item_id string, outlet string, stratum string, log_relative double")


def test_draws_add_up_in_every_stratum(spark):
    held = resampling.clusters(sample(spark), DESIGN)
    sums = resampling.draws(held, 50, 7, 1).groupBy("stratum", "replicate").agg(F.sum("times").alias("n"), F.max("rank").alias("r"))
    assert {(r["n"], r["r"] < 6) for r in sums.collect()} == {(5, True)} and sums.count() == 100
    again = {tuple(r) for r in resampling.draws(held.repartition(3), 50, 7, 1).collect()}
    assert again == {tuple(r) for r in resampling.draws(held, 50, 7, 1).collect()}
    assert again != {tuple(r) for r in resampling.draws(held, 50, 8, 1).collect()}


def test_draws_are_even(spark):
    held = resampling.clusters(sample(spark, strata=1, outlets=4), DESIGN)
    n = {r["rank"]: r["n"] for r in resampling.draws(held, 4000, 1, 0).groupBy("rank").agg(F.sum("times").alias("n")).collect()}
    assert len(n) == 4 and all(abs(x - 4000) < 4 * math.sqrt(4000) for x in n.values())


def test_interval_from_its_draws(spark):
    """The interval is the quantiles of the headlines that the draws give by hand."""
    r = sample(spark, strata=2, outlets=4, quotes=2)
    held = resampling.clusters(r, DESIGN)
    sums = {(x["stratum"], x["rank"]): (x["s"], x["n"]) for x in held.collect()}
    by = {}
    for x in resampling.draws(held, 99, 0, 1).collect():
        s, n = sums[x["stratum"], x["rank"]]
        a, b = by.get(x["replicate"], (0.0, 0))
        by[x["replicate"]] = (a + x["times"] * s, b + x["times"] * n)
    values = [(math.exp(a / b) - 1) * 100 for a, b in by.values()]
    got = resampling.bootstrap(r, DESIGN, replicates=99, level=0.9).first()
    assert (got["lower"], got["upper"]) == pytest.approx(tuple(np.quantile(values, [0.05, 0.95])))
    assert (got["replicates"], got["strata"], got["clusters"]) == (99, 2, 8)
    logs = [x["log_relative"] for x in r.collect()]
    assert got["estimate"] == pytest.approx((math.exp(np.mean(logs)) - 1) * 100)


def test_weights_and_their_refusal(spark):
    r = sample(spark, strata=1, quotes=4).withColumn("category", F.when(F.substring("item_id", -1, 1) == "0", "a").otherwise("b"))
    w = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "category string, weight double")
    mean = {x["category"]: x["m"] for x in r.groupBy("category").agg(F.avg("log_relative").alias("m")).collect()}
    got = resampling.bootstrap(r, DESIGN, replicates=20, weights=w).first()
    assert got["estimate"] == pytest.approx(((math.exp(mean["a"]) + 3 * math.exp(mean["b"])) / 4 - 1) * 100)
    with pytest.raises(resampling.UncertaintyError, match="no weight for .'b'"):
        resampling.bootstrap(r, DESIGN, weights=w.filter("category = 'a'"))


def test_refusals(spark):
    r = sample(spark)
    with pytest.raises(resampling.UncertaintyError, match="no sampling design"):
        resampling.bootstrap(r, None)
    with pytest.raises(resampling.UncertaintyError, match="0.5 and 1"):
        resampling.bootstrap(r, DESIGN, level=0.4)
    with pytest.raises(resampling.UncertaintyError, match="'shop'"):
        resampling.bootstrap(r, resampling.Design("shop"))
    with pytest.raises(resampling.UncertaintyError, match="single cluster: .'s1'"):
        resampling.bootstrap(r.filter("stratum = 's0' or outlet = 'o1'"), DESIGN)


def test_naive_is_narrower_on_clustered_quotes(spark):
    got = resampling.design_effect(sample(spark, outlets=8, quotes=20, between=0.1, within=0.01), DESIGN, replicates=150).first()
    assert got["ratio"] > 2


def test_coverage(spark):
    """Of 60 samples' intervals nearly all hold the true mean: all samples in one job, as categories of their own."""
    truth, samples, outlets = 0.05, 60, 12
    rng = np.random.default_rng(4)
    rows = [(f"{k}", f"{k}-{h}-{o}", f"o{o}", f"{k}|{h}", float(rng.normal(truth, 0.1))) for k in range(samples) for h in range(2) for o in range(outlets)]
    r = spark.createDataFrame(rows, "category string, item_id string, outlet string, stratum string, log_relative double")
    held = resampling.clusters(r, DESIGN)
    drawn = resampling.draws(held, 199, 0, 1).join(held, ["stratum", "rank"]).groupBy("category", "replicate").agg((F.sum(F.col("times") * F.col("s")) / F.sum(F.col("times") * F.col("n"))).alias("m"))
    q = drawn.groupBy("category").agg(F.percentile("m", [0.025, 0.975]).alias("q")).collect()
    inside = sum(x["q"][0] <= truth <= x["q"][1] for x in q)
    assert 0.85 <= inside / samples <= 1


# --- sensitivity ---


def panel(spark):
    rows = [(DAY(2020, m, 1), c, f"{c}{i}", float(10 + i + m * (i + 1) * (1 if c == "a" else -0.3)) if (m, i) != (2, 0) else None, 1.0 + i, 10.0 * (i + 1)) for m in range(1, 5) for c in "ab" for i in range(3)]
    return spark.createDataFrame(rows, "period date, category string, item_id string, price_clean double, quantity double, expenditure double")


def test_sensitivity_rows(spark):
    got = {(r["dimension"], r["setting"]): r for r in scenarios.sensitivity(panel(spark)).collect()}
    assert len(got) == 18 and got["run", "jevons"]["difference"] == 0
    rows = panel(spark).collect()
    level = {}
    for c in "ab":
        level[c] = 100.0
        for m in (2, 3, 4):
            p = {(r["period"].month, r["item_id"]): r["price_clean"] for r in rows if r["category"] == c}
            both = [math.log(p[m, f"{c}{i}"] / p[m - 1, f"{c}{i}"]) for i in range(3) if p[m, f"{c}{i}"] and p[m - 1, f"{c}{i}"]]
            level[c] *= math.exp(sum(both) / len(both))
    assert got["run", "jevons"]["headline"] == pytest.approx(math.sqrt(level["a"] * level["b"]))
    assert got["aggregation formula", "equal arithmetic mean"]["headline"] == pytest.approx((level["a"] + level["b"]) / 2)
    assert got["aggregation formula", "equal harmonic mean"]["headline"] == pytest.approx(2 / (1 / level["a"] + 1 / level["b"]))
    assert got["run", "jevons"]["share_run"] == 0 and got["imputation method", "carry_forward"]["share_run"] > 0
    span = scenarios.sensitivity_range(scenarios.sensitivity(panel(spark))).first()
    values = [r["headline"] for r in got.values()]
    assert (span["low"], span["high"], span["alternatives"]) == (pytest.approx(min(values)), pytest.approx(max(values)), 17)


def test_settings_without_a_value(spark):
    got = {r["setting"]: r["status"] for r in scenarios.sensitivity(panel(spark).withColumn("quantity", F.lit(None).cast("double"))).collect()}
    assert got["jevons"] == "computed" and got["carli"] == "computed"


def test_one_scan_of_the_panel(spark, tmp_path):
    """Whatever the number of settings, the given panel is read once."""
    panel(spark).write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    plan = scenarios.sensitivity(p)._jdf.queryExecution().executedPlan().toString()
    assert str(tmp_path / "p") not in plan  # only tables written from it


# --- vintages ---


def test_vintages_equal_fits_on_known_sales(spark):
    rng = random.Random(2)
    rows = [(f"h{k}", DAY(2015 + t // 4, 3 * (t % 4) + 1, 1), 100.0 * math.exp(0.02 * t + rng.gauss(0, 0.1))) for k in range(80) for t in sorted(rng.sample(range(12), rng.randint(1, 4)))]
    sales = spark.createDataFrame(rows, "property_id string, period date, price double")
    got = {}
    for r in vintages.repeat_sales_vintages(sales).collect():
        got.setdefault(r["vintage_end"], {})[r["period"]] = r["index"]
    periods = sorted({r[1] for r in rows})
    assert sorted(got) == periods[2:]
    for end, index in got.items():
        want = {r["period"]: r["index"] for r in domain.repeat_sales(sales.filter(F.col("period") <= end)).collect()}
        assert index == pytest.approx(want)
    v = vintages.repeat_sales_vintages(sales)
    assert max(abs(r["residual"]) for r in vintages.vintage_residuals(sales, v).collect()) < 1e-8
    later = vintages.repeat_sales_vintages(sales, first_end=periods[9])
    assert later.select("vintage").distinct().count() == 3


def test_no_pairs(spark):
    with pytest.raises(vintages.PropertyError):
        vintages.repeat_sales_vintages(spark.createDataFrame([("h", DAY(2020, 1, 1), 1.0)], "property_id string, period date, price double"))


def test_draws_are_dealt_over_tasks_and_follow_their_hash(spark):
    """One stratum of many clusters is drawn in more than one task, each slot by the hash that uniform() names."""
    held = spark.range(9000).select(F.lit("all").alias("stratum"), F.col("id").alias("rank"), F.lit("c").alias("category"), F.lit(1.0).alias("s"), F.lit(1).cast("long").alias("n"))
    dealt = resampling._dealt(held, 3, 5, 1)
    sizes = [r["n"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3 * 8999 and len(sizes) > 1
    slots = spark.range(1, 9000).select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("replicate"), F.col("id").alias("slot"))
    want = slots.select("replicate", F.floor(resampling.uniform(F.lit("all"), F.col("replicate"), F.col("slot"), F.lit(5)) * 9000).alias("rank"))
    assert sorted(map(tuple, dealt.select("replicate", "rank").collect())) == sorted(map(tuple, want.collect()))
