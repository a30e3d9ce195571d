"""Tables that a plan reads several times, written once to the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset (tests, one machine), one of the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.basketry"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df, written as Parquet and read back: its plan runs once however often it is used, and lost executors cost a reread."""
    path = f"{shared_folder(df.sparkSession)}/price-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds the 0-based number of each row within its group in the order given; no group is gathered in one task.

    Rows are dealt by range, numbered within each part, and moved on by the group's rows in the parts before.
    """
    parts = staged(df.repartitionByRange(*[F.col(c) for c in [*group, *order]]).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1
    j = parts.withColumn("_i", inside).join(sizes.select(*group, "_part", before.alias("_before")), [*group, "_part"])
    return j.withColumn(name, (F.col("_i") + F.col("_before")).cast("long")).drop("_i", "_before", "_part")


def placed(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written in the order given with the 0-based number of each row in the whole table; no task holds all rows.

    A row is written with its part of the sorted rows and its place there; the parts' sizes, a number for each, are
    collected. Sorting reads df twice.
    """
    rows = staged(df.sort(*order).withColumn("_id", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("_id", 33).cast("int"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dict(rows.groupBy(part).count().collect())
    before = [0]
    for p in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(p, 0))
    return rows.withColumn(name, F.get(F.array(*[F.lit(n).cast("long") for n in before]), part) + inside).drop("_id")
