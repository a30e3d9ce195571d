"""A corpus pipeline: five stages over the table documents, each written and read again."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm import decontam, jaccard, lines, mixing, store, toxicity
from basketry.llm.store import shared_dir


_SCRATCH: dict[str, list[str]] = {}


def _stage(function):
    """A stage that first deletes the scratch tables of the stage before: by the contract its result has been written.

    It also sets small batches for Python workers, and leaves them set, as its result is made after it returns.
    """

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        store.small_batches(spark)
        store.remove(spark, _SCRATCH.pop(app, []))
        before = set(store.SCRATCH)
        out = function(spark, docs, sf_dir)
        _SCRATCH[app] = [p for p in store.SCRATCH if p not in before]
        return out

    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on labels scores under 0.5.

    Null and empty texts have the score of no feature, equal rows equal scores; without labels of both classes the model
    is the share of toxic ones, so all documents stay or go together. An empty table gives no row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.toxicity(model, F.col("text")) < 0.5)


@_stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier equal or nearly equal line makes needless; n_chars follows the text.

    Null and empty texts stay as they are; of repeated rows the first stays; a document that loses all lines goes. An
    empty table gives no row; other columns stay, whatever their names.
    """
    kept = lines.dedup_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


@_stage
def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at a similarity of 0.8.

    Texts without words are linked with nothing and stay; of repeated rows one stays. An empty table gives no row.
    """
    return jaccard.dedup_near(docs, n=5, percent=80)


@_stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover half of a benchmark item with tiles.

    Null and empty texts stay, as do all documents if no item has a text; repeated rows are judged alike.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with size, source_size, target and taken (words, repeats counted).

    Null and empty texts have no words and are not taken; a null source is one of its own; a given column of one of
    the four names is replaced. An empty table gives no row.
    """
    return mixing.take_mix(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_near), ("benchmark decontamination", drop_leaks), ("mixing sources", mix)]

#: No stage can be written in SQL as a whole; tests/llm compares each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
