"""Tables that a job writes half-way, so that lost executors cost a reread and not a rerun."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as spark.checkpoint.dir names it.

    Where that is unset it is `.basketry` in the warehouse, which driver and executors share too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/.basketry"


#: Rows and bytes of a batch that Spark hands to a Python worker at once.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on Python workers get batches of BATCH_ROWS and BATCH_BYTES at most, or less where the session says so.

    A batch stands in the executor's direct memory and in its Python worker, there as Python objects too.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:  # 0 and less: no limit
        spark.conf.set(rows, BATCH_ROWS)
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(size))
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


#: The folders that staged() has made and nobody has discarded.
SCRATCH: list[str] = []


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage and the known partitioning."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{tag}"
    df.write.parquet(path)
    SCRATCH.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bucketed(df: DataFrame, key: str, move: bool = True) -> DataFrame:
    """Write df to the shared folder as a table that is bucketed by key: joins on key do not move its rows again.

    Without move every task writes a file for each bucket that it has rows of: for tables of few, large rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"basketry_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"
    (df.repartition(n, key) if move else df).write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    SCRATCH.append(path)
    out = spark.table(name)
    out._scratch = path
    return out


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch folders, and the tables that stand in them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        if (name := path.rpartition("/")[2]).startswith("basketry_"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        at = jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
        at.getFileSystem(conf).delete(at, True)
        if path in SCRATCH:
            SCRATCH.remove(path)


_last_collection = [0.0]


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no plan to come reads: what was made of them has been staged itself.

    Spark deletes shuffle files when the driver's garbage is collected, so that is asked for, twice a minute at most.
    """
    for df in tables:
        remove(df.sparkSession, [df._scratch])
    if time.monotonic() - _last_collection[0] > 30:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()
        _last_collection[0] = time.monotonic()


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the 0-based rank of each row in the order given, without sending all rows to one task.

    Rows are dealt by range, ranked within each part, and shifted by the rows of the parts before.
    Only one count per part reaches the driver, so its size is the number of partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = {r["_part"]: r["n"] for r in parts.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part] = at
        at += counts[part]
    shift = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else F.lit(None)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    rank = (inside + (shift[F.col("_part")] if before else F.lit(0))).cast("long")
    out = parts.withColumn(name, rank).drop("_part")
    out._scratch = parts._scratch
    return out
