"""Streams give what the batch gives, in any order of arrival within the lateness allowed."""

import datetime
import random
import uuid

import pytest
from pyspark.sql import functions as F

from basketry.operators.quality import carry_forward
from basketry.sources.staging import shared_folder
from basketry.streaming.carry import replayed

START = datetime.datetime(2020, 1, 1)


def quotes():
    rng = random.Random(3)
    return [(i, START + datetime.timedelta(days=30 * m), None if rng.random() < 0.4 else round(rng.uniform(1, 9), 2)) for i in "abc" for m in range(12) if rng.random() < 0.9]


def write(spark, files):
    """One Parquet file for each list of rows, in order of time, and a last one far ahead that lets all others leave."""
    folder = f"{shared_folder(spark)}/quotes-{uuid.uuid4().hex}"
    for rows in [*files, [("~", START + datetime.timedelta(days=9000), 1.0)]]:
        spark.createDataFrame(rows, "item_id string, period timestamp, price double").coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("seed", [0, 1])
def test_any_order_gives_the_batch(spark, seed):
    rows = quotes()
    months = sorted({r[1] for r in rows})
    files = [[r for r in rows if r[1] in months[k : k + 6]] for k in (0, 6)]
    if seed:  # every second quote of the first half comes with the second half
        late = files[0][::2]
        files = [[r for r in files[0] if r not in late], late + files[1]]
        random.Random(seed).shuffle(files[1])
    folder = write(spark, files)
    got = replayed(spark, folder, shared_folder(spark), late="400 days" if seed else "31 days").filter("item_id <> '~'")
    batch = carry_forward(spark.createDataFrame(rows, "item_id string, period timestamp, price_clean double").withColumn("category", F.lit("c")))
    want = {(r["item_id"], r["period"], r["price_clean"], r["price_imputed"], r["imputation"]) for r in batch.collect()}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_quotes_behind_the_watermark_are_dropped(spark):
    early, later = ("a", START, 1.0), ("a", START + datetime.timedelta(days=300), None)
    folder = write(spark, [[later], [("b", START + datetime.timedelta(days=400), 2.0)], [early]])
    got = {(r["item_id"], r["price_imputed"]) for r in replayed(spark, folder, shared_folder(spark)).filter("item_id <> '~'").collect()}
    assert got == {("a", None), ("b", 2.0)}
