"""Steps that must read their input once, or deal it over several tasks."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import comparison, domain, hedonic, linalg, multilateral, seasonal, spatial, trees
from basketry.plans import reading, structure
from basketry.sources import readers

DAY = datetime.date


def counted(spark, df):
    """df and an accumulator of the rows read of it."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema), seen


def regions(spark):
    rng = np.random.default_rng(1)
    rows = [(f"r{r}", f"p{p}", float(rng.uniform(1, 9)), float(rng.uniform(1, 5))) for r in range(4) for p in range(12) if (r + p) % 5]
    return spark.createDataFrame(rows, "region string, product string, price double, quantity double").withColumn("expenditure", F.col("price") * F.col("quantity"))


def panel(spark):
    rng = np.random.default_rng(2)
    rows = [(DAY(2020, m, 1), "ab"[i % 2], f"i{i}", float(rng.uniform(1, 9)), float(rng.uniform(1, 5))) for m in range(1, 7) for i in range(20) if rng.random() < 0.7]
    return spark.createDataFrame(rows, "period date, category string, item_id string, price double, quantity double").withColumn("expenditure", F.col("price") * F.col("quantity"))


def test_weights_of_large_trees_add_up(spark, tmp_path):
    """orders whose sum of doubles is off by more than the tolerance are no inconsistency."""
    d = str(tmp_path)
    spark.sql("select 0 as r_regionkey, 'R' as r_name").write.parquet(f"{d}/region.parquet")
    spark.sql("select 0 as n_nationkey, 'N' as n_name, 0 as n_regionkey").write.parquet(f"{d}/nation.parquet")
    spark.range(40).selectExpr("id as c_custkey", "0 as c_nationkey", "concat('S', id % 5) as c_mktsegment").write.parquet(f"{d}/customer.parquet")
    spark.range(4000).selectExpr("id % 40 as o_custkey", "'O' as o_orderstatus", "cast(9876543210123.37 + id * 7919.01 as double) as o_totalprice").write.parquet(f"{d}/orders.parquet")
    assert structure.queries()["val_weight_tree"](spark, d).collect() == []


def test_parities_read_prices_once(spark):
    """F3."""
    p, seen = counted(spark, regions(spark))
    spatial.parities(p, "r0").collect()
    assert seen.value == regions(spark).count()


def test_weighted_product_dummy_reads_prices_once(spark):
    """F8."""
    p, seen = counted(spark, regions(spark))
    domain.country_product_dummy(p, "r0", weighted=True).collect()
    assert seen.value == regions(spark).count()


@pytest.mark.parametrize("dense", [4, 1 << 21])
def test_item_sums_read_cells_once(spark, monkeypatch, dense):
    """effects are those of least squares, from one pass over the cells, however few items fit a table."""
    monkeypatch.setattr(linalg, "DENSE", dense)
    cells = multilateral.product_cells(panel(spark), weighted=True)
    rows = cells.collect()
    c, seen = counted(spark, cells)
    times, effects = linalg.two_way_dummies(c)
    assert seen.value == len(rows)
    items = sorted({r["i"] for r in rows})
    x = np.array([[float(r["t"] == t) for t in times[1:]] + [float(r["i"] == i) for i in items] for r in rows])
    w = np.sqrt([r["w"] for r in rows])
    want = np.linalg.lstsq(x * w[:, None], np.array([r["y"] for r in rows]) * w, rcond=None)[0]
    assert effects[1:] == pytest.approx(want[: len(times) - 1])
    g, seen = counted(spark, multilateral.unit_value_panel(panel(spark)).select(F.col("period").alias("t"), F.col("item_id").alias("i"), F.col("price").alias("p"), F.col("quantity").alias("q")))
    linalg.fixed_point_levels(g)
    assert seen.value == len(rows)


def test_matched_share_reads_the_panel_once(spark):
    """F14."""
    p, seen = counted(spark, panel(spark))
    comparison.matched_share(p).collect()
    assert seen.value == panel(spark).count()


def sales(spark):
    rng = np.random.default_rng(3)
    rows = [(i, DAY(2020, 1 + 3 * int(rng.integers(0, 4)), 1), "xyz"[i % 3], float(rng.uniform(40, 200)), float(rng.uniform(100, 900))) for i in range(200)]
    return spark.createDataFrame(rows, "property_id long, period date, stratum string, floor_area double, price double")


@pytest.mark.parametrize("run", [hedonic.hedonic_index, hedonic.cross_validate])
def test_hedonics_read_sales_once(spark, run):
    """F5, F11."""
    df, seen = counted(spark, sales(spark))
    run(df, ["floor_area"], ["stratum"]).collect()
    assert seen.value == 200


def test_counter_seasonal_reads_the_panel_once(spark):
    """F10."""
    p, seen = counted(spark, panel(spark))
    seasonal.counter_seasonal(p).collect()
    assert seen.value == panel(spark).count()


def test_long_text_files_are_written_and_read_in_parts(spark):
    """no task holds all lines; only the first part has a header."""
    lines = spark.range(-1, 5000).select(F.col("id").alias("at"), F.when(F.col("id") < 0, "key,name").when(F.col("id") % 50 == 7, F.col("id").cast("string")).otherwise(F.concat_ws(",", F.col("id").cast("string"), F.lit("n"))).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        folder = reading._written(lines)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(readers._files(spark, folder)) > 1
    df = readers.read_table(spark, folder)
    assert df.columns == ["key", "name"]
    assert sorted(int(r["key"]) for r in df.collect()) == [k for k in range(5000) if k % 50 != 7]
    assert readers.malformed_rows(spark, folder).count() == 100
