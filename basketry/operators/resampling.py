"""Sampling intervals of a headline movement: whole clusters resampled within strata, and the naive form beside them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.sources.staging import numbered, staged

#: Between the parts of a draw's key.
SEP = "\x1f"
#: Slots that are numbered from one row.
BLOCK = 4096


class UncertaintyError(ValueError):
    """The data or the design carry no interval."""


@dataclass(frozen=True)
class Design:
    """How the sample was drawn: the column of the clusters, and of the strata they were drawn within (None: one)."""

    cluster: str
    strata: str | None = None


def uniform(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(SEP, *[k.cast("string") for k in key])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def clusters(relatives: DataFrame, design: Design | None) -> DataFrame:
    """stratum, cluster, rank, category, s, n: sums of log relatives of the clusters, numbered within strata.

    Without a design each row of relatives is a cluster of one stratum. Raises if a column of the design is missing.
    """
    if design is None:
        rows = relatives.select(F.lit("all quotes").alias("stratum"), F.col("category"), F.col("item_id").cast("string").alias("cluster"), "log_relative")
    else:
        for c in (design.cluster, design.strata):
            if c is not None and c not in relatives.columns:
                raise UncertaintyError(f"the design names {c!r}, which the data lack")
        stratum = F.col(design.strata).cast("string") if design.strata else F.lit("all")
        rows = relatives.select(stratum.alias("stratum"), F.col("category"), F.col(design.cluster).cast("string").alias("cluster"), "log_relative")
    sums = staged(rows.groupBy("stratum", "cluster", "category").agg(F.sum("log_relative").alias("s"), F.count("*").alias("n")), "sums")
    ranks = numbered(sums.select("stratum", "cluster").distinct(), ["stratum"], ["cluster"], "rank")
    return staged(sums.join(ranks, ["stratum", "cluster"]), "clusters")


def _dealt(held: DataFrame, replicates: int, seed: int, fewer: int) -> DataFrame:
    """stratum, replicate, rank of every single draw.

    A stratum's slots of a replicate are cut into blocks that are dealt over all tasks before they are numbered, as
    strata are few; the number of tasks is given, or the few blocks' rows would be put together again.
    """
    tasks = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = held.groupBy("stratum").agg((F.max("rank") + 1).alias("size")).filter(F.col("size") > fewer)
    runs = sizes.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    blocks = runs.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size") - fewer, F.lit(BLOCK).cast("long"))))
    dealt = blocks.repartition(tasks, "stratum", "replicate", "first").select("stratum", "replicate", "first", (F.col("size") - fewer).alias("last"), "size")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n = min(BLOCK, r["last"] - r["first"] + 1)
                head = SEP.join([*([] if r["stratum"] is None else [r["stratum"]]), str(r["replicate"]), ""]).encode()
                tail = f"{SEP}{seed}".encode()
                digests = b"".join([hashlib.md5(b"%b%d%b" % (head, k, tail), usedforsecurity=False).digest() for k in range(r["first"], r["first"] + n)])
                u = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)) / float(1 << 52)  # as uniform()
                rank = np.floor(u * r["size"]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([r["stratum"]] * n, pa.string()), pa.array(np.full(n, r["replicate"], np.int32)), pa.array(rank)], ["stratum", "replicate", "rank"])

    return dealt.mapInArrow(run, "stratum string, replicate int, rank long")


def draws(held: DataFrame, replicates: int, seed: int, fewer: int) -> DataFrame:
    """stratum, replicate, rank, times: how often each cluster is drawn, n - fewer draws with replacement from n a stratum.

    Every draw is a slot (stratum, replicate, number) that a hash deals to a rank, so the times of a stratum add up to
    its draws exactly and do not depend on how the data lie.
    """
    return _dealt(held, replicates, seed, fewer).groupBy("stratum", "replicate", "rank").agg(F.count("*").alias("times"))


def _headline(means: DataFrame, key: list[str], weights: DataFrame | None) -> DataFrame:
    """key, change: mean log relatives by category to the movement of the headline in percent."""
    if weights is None:
        value = (F.exp(F.avg("mean")) - 1) * 100
    else:
        means = means.join(weights, "category")
        value = (F.sum(F.col("weight") * F.exp("mean")) / F.sum("weight") - 1) * 100
    return (means.groupBy(*key) if key else means.groupBy()).agg(value.alias("change"))


def replicate_changes(held: DataFrame, replicates: int, seed: int, fewer: int, weights: DataFrame | None = None) -> DataFrame:
    """replicate, change: the headline of each replicate; a category that none of its clusters reached is left out of it."""
    # Single draws meet their cluster's sums: one shuffle by (stratum, rank), no count of each (replicate, rank) held. The
    # sums are neither sent to all executors through the driver nor sorted against the draws.
    drawn = _dealt(held, replicates, seed, fewer).join(held.select("stratum", "rank", "category", "s", "n").hint("shuffle_hash"), ["stratum", "rank"])
    means = drawn.groupBy("replicate", "category").agg((F.sum("s") / F.sum("n")).alias("mean"))
    return _headline(means, ["replicate"], weights)


def bootstrap(relatives: DataFrame, design: Design | None, *, replicates: int = 999, level: float = 0.95, seed: int = 0, weights: DataFrame | None = None, naive: bool = False) -> DataFrame:
    """estimate, lower, upper (changes in percent), replicates, strata, clusters of a percentile bootstrap.

    relatives has category, item_id, log_relative and the design's columns. With a design, n - 1 of the n clusters of
    each stratum are drawn with replacement; naive draws single quotes, as many as there are, and is for comparison.
    The headline is the geometric mean of the categories' mean relatives, or with weights (category, weight) the
    weighted arithmetic mean of the categories' levels.

    Raises without a design (unless naive), for a level not between 0.5 and 1, for a stratum of one cluster, which has
    no variation to draw from, and for a category without a weight.
    """
    if design is None and not naive:
        raise UncertaintyError("no sampling design was declared, so the sampling uncertainty is not quantified")
    if not 0.5 < level < 1:
        raise UncertaintyError("the confidence level must lie between 0.5 and 1")
    if weights is not None:
        lacking = relatives.select("category").distinct().join(weights.filter("weight is not null"), "category", "left_anti").orderBy("category").limit(5).collect()
        if lacking:
            raise UncertaintyError(f"no weight for {[r['category'] for r in lacking]}")
    held = clusters(relatives, None if naive else design)
    sizes = held.groupBy("stratum").agg((F.max("rank") + 1).alias("size"))
    if not naive and (thin := sizes.filter("size < 2").orderBy("stratum").limit(5).collect()):
        raise UncertaintyError(f"strata with a single cluster: {[r['stratum'] for r in thin]}")
    changes = replicate_changes(held, replicates, seed, 0 if naive else 1, weights)
    q = changes.agg(F.percentile("change", [(1 - level) / 2, (1 + level) / 2]).alias("q"), F.count("change").alias("replicates"))
    point = _headline(held.groupBy("category").agg((F.sum("s") / F.sum("n")).alias("mean")), [], weights).withColumnRenamed("change", "estimate")
    whole = sizes.agg(F.count("*").alias("strata"), F.sum("size").alias("clusters"))
    return point.join(F.broadcast(q)).join(F.broadcast(whole)).select("estimate", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"), "replicates", "strata", "clusters")  # one row each


def design_effect(relatives: DataFrame, design: Design, **options) -> DataFrame:
    """designed, naive (widths of the intervals in points) and ratio, on the same data and seed."""
    d = bootstrap(relatives, design, **options).select((F.col("upper") - F.col("lower")).alias("designed"))
    n = bootstrap(relatives, None, naive=True, **options).select((F.col("upper") - F.col("lower")).alias("naive"))
    return d.join(F.broadcast(n)).select("designed", "naive", (F.col("designed") / F.col("naive")).alias("ratio"))  # one row
