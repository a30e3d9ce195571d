"""Stored layers named by their content: raw tables written once, cleaned ones with the log that makes them again, results of runs."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.operators.governance import frame_hash
from basketry.operators.index import chained_index, geometric_all_items
from basketry.operators.quality import carry_forward, impute_by_movement, recode_missing, repair_units

MANIFEST = "layer string, content_hash string, rows long, columns string, written_at timestamp"
RECEIPT = "content_hash string, kind string, source string, file_sha256 string, received_by string, received_at timestamp"


class ImmutableLayerError(ValueError):
    """A stored layer does not hold what its name says, or a log belongs to another one."""


@dataclass(frozen=True)
class Log:
    """What made a cleaned layer: the content of the raw one and the settings of cleaning."""

    raw_hash: str
    settings: str

    def to_json(self) -> str:
        return json.dumps({"raw_hash": self.raw_hash, "settings": json.loads(self.settings)}, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Log:
        data = json.loads(text)
        return Log(data["raw_hash"], json.dumps(data["settings"], sort_keys=True))


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _whole(spark: SparkSession, name: str) -> bool:
    """Whether a write to the folder has ended."""
    store, at = _path(spark, f"{name}/_SUCCESS")
    return store.exists(at)


def _told(spark: SparkSession, root: str, layer: str, content: str, df: DataFrame) -> None:
    row = spark.createDataFrame([(layer, content, df.count(), ",".join(sorted(df.columns)))], "layer string, content_hash string, rows long, columns string")
    row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/manifest")


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row for each layer that was written: layer, content_hash, rows, columns, written_at."""
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest") if _path(spark, f"{root}/manifest")[0].exists(_path(spark, f"{root}/manifest")[1]) else spark.createDataFrame([], MANIFEST)


def write_raw(df: DataFrame, root: str) -> str:
    """Store a table under root/raw/<hash of its content> and return the hash; the same rows in any order are the same content.

    The table is written aside first, so what is hashed is what is stored, and moved to its name once whole. Where the
    name is taken the stored rows are hashed again: equal content is no second write, anything else is an error.
    """
    spark = df.sparkSession
    aside = f"{root}/incoming/{uuid.uuid4().hex}"
    df.write.parquet(aside)
    stored = spark.read.parquet(aside)
    content = frame_hash(stored)
    target = f"{root}/raw/{content}"
    store, at = _path(spark, target)
    if _whole(spark, target):
        read_raw(spark, root, content)
    else:
        store.delete(at, True)  # what a lost write left
        store.mkdirs(at.getParent())
        if not store.rename(_path(spark, aside)[1], at):
            raise ImmutableLayerError(f"{target} could not be written")
        _told(spark, root, "raw", content, spark.read.parquet(target))
    store.delete(_path(spark, aside)[1], True)
    return content


def read_raw(spark: SparkSession, root: str, content: str) -> DataFrame:
    """The stored table of that content; an error if there is none or its rows hash to something else."""
    if not _whole(spark, f"{root}/raw/{content}"):
        raise ImmutableLayerError(f"no raw layer {content}")
    df = spark.read.parquet(f"{root}/raw/{content}")
    if (found := frame_hash(df)) != content:
        raise ImmutableLayerError(f"the raw layer {content} holds content {found}")
    return df


def record_receipt(df: DataFrame, root: str, *, kind: str, source: str, file_sha256: str, actor: str) -> str:
    """Store a table that someone supplied and append a receipt; the same content again adds a receipt and no layer."""
    content = write_raw(df, root)
    row = df.sparkSession.createDataFrame([(content, kind, source, file_sha256, actor)], "content_hash string, kind string, source string, file_sha256 string, received_by string")
    row.withColumn("received_at", F.current_timestamp()).write.mode("append").parquet(f"{root}/receipts")
    return content


def receipts(spark: SparkSession, root: str, content: str) -> DataFrame:
    """The receipts of a content."""
    return spark.read.schema(RECEIPT).parquet(f"{root}/receipts").filter(F.col("content_hash") == content)


def cleaned(raw: DataFrame, settings: dict) -> DataFrame:
    """The raw panel with price_clean, price_imputed and imputation.

    settings: repair (unit faults, default true) and imputation (none, carry_forward, class_mean, targeted_mean or
    overall_mean). Writing and replaying both come through here.
    """
    p = repair_units(raw) if settings.get("repair", True) else recode_missing(raw)
    method = settings.get("imputation", "none")
    if method == "none":
        return p.withColumn("price_imputed", F.col("price_clean")).withColumn("imputation", F.lit(None).cast("string"))
    return carry_forward(p) if method == "carry_forward" else impute_by_movement(p, method)


def write_cleaned(spark: SparkSession, root: str, content: str, settings: dict) -> tuple[str, Log]:
    """Clean a stored raw layer and store the result with its log; path and log. The same settings again write nothing."""
    log = Log(content, json.dumps(settings, sort_keys=True))
    path = f"{root}/cleaned/{content}/{uuid.uuid5(uuid.NAMESPACE_OID, log.to_json()).hex}"
    if not _whole(spark, f"{path}/rows"):
        cleaned(read_raw(spark, root, content), settings).write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([(log.to_json(),)], "log string").coalesce(1).write.mode("overwrite").text(f"{path}/log")
        _told(spark, root, "cleaned", content, spark.read.parquet(f"{path}/rows"))
    return path, log


def read_log(spark: SparkSession, path: str) -> Log:
    return Log.from_json(spark.read.text(f"{path}/log").first()[0])


def replay(raw: DataFrame, log: Log) -> DataFrame:
    """The cleaned layer made again from a raw table; an error if its content is not what the log was written for."""
    if (found := frame_hash(raw)) != log.raw_hash:
        raise ImmutableLayerError(f"the raw table has content {found}, the log is of {log.raw_hash}")
    return cleaned(raw, json.loads(log.settings))


def differing(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """keys, side (left, right or both) of rows that the two tables do not share, or that differ in another column.

    Numbers differ beyond the tolerance relative to the larger one: sums may be made in another order. Keys may be null.
    """
    kinds = dict(a.dtypes)
    rest = [c for c in a.columns if c not in keys]
    left = a.select(*[F.col(k).alias(f"l_{k}") for k in keys], F.struct(F.lit(1).alias("_there"), *rest).alias("x"))
    right = b.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.struct(F.lit(1).alias("_there"), *rest).alias("y"))
    on = [F.col(f"l_{k}").eqNullSafe(F.col(f"r_{k}")) for k in keys]
    j = left.join(right, on, "full")

    def same(c: str):
        x, y = F.col(f"x.{c}"), F.col(f"y.{c}")
        return F.abs(x - y) <= tolerance * F.greatest(F.abs(x), F.abs(y), F.lit(1.0)) if kinds[c] in ("double", "float") else x == y

    off = F.lit(False)
    for c in rest:
        off = off | ~(F.coalesce(same(c), F.lit(False)) | (F.col(f"x.{c}").isNull() & F.col(f"y.{c}").isNull()))
    side = F.when(F.col("y._there").isNull(), "left").when(F.col("x._there").isNull(), "right").when(off, "both")
    return j.select(*[F.coalesce(f"l_{k}", f"r_{k}").alias(k) for k in keys], side.alias("side")).filter("side is not null")


def compiled(panel: DataFrame, settings: dict) -> DataFrame:
    """series, period, index of a cleaned panel: categories and All items, chained by the formula of the settings."""
    ix = chained_index(panel, settings.get("formula", "jevons"), price="price_imputed").select(F.col("category").alias("series"), "period", "index")
    total = geometric_all_items(ix).select(F.lit("All items").alias("series"), "period", "index")
    return ix.unionByName(total)


def store_run(spark: SparkSession, root: str, run: str, content: str, settings: dict) -> DataFrame:
    """Compile a run from a stored raw layer and store its result under root/runs/<run>, with what it was made of; once."""
    path = f"{root}/runs/{run}"
    if not _whole(spark, f"{path}/result"):
        made = spark.createDataFrame([(Log(content, json.dumps(settings, sort_keys=True)).to_json(),)], "log string")
        made.coalesce(1).write.mode("overwrite").text(f"{path}/log")
        compiled(cleaned(read_raw(spark, root, content), settings), settings).write.mode("overwrite").parquet(f"{path}/result")
        _told(spark, root, "run", run, spark.read.parquet(f"{path}/result"))
    return spark.read.parquet(f"{path}/result")


def reproduce(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The result of a stored run made again from its stored input and settings; an error that names what differs.

    The input's content is checked first, so a changed layer is found before anything is computed on it.
    """
    log = read_log(spark, f"{root}/runs/{run}")
    settings = json.loads(log.settings)
    again = compiled(cleaned(read_raw(spark, root, log.raw_hash), settings), settings)
    stored = spark.read.parquet(f"{root}/runs/{run}/result")
    if off := differing(stored, again, ["series", "period"]).orderBy("series", "period").limit(5).collect():
        raise ImmutableLayerError(f"run {run} is not reproduced at {[(r['series'], str(r['period']), r['side']) for r in off]}")
    return again
