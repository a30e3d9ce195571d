"""Exact dedup by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import staged
from basketry.llm.words import as_bytes

SPACES = b"\t\n\x0b\x0c\r "
GEAR = np.random.default_rng(8).integers(0, 2**32, 256, dtype=np.uint32)
WINDOW = 32  # bytes that decide whether a chunk ends


def chunk_ends(data: bytes, mean: int) -> list[int]:
    """Where the chunks of data end: after each byte whose last WINDOW bytes have a gear hash with log2(mean) zero bits.

    The place depends on the content alone, so the same run of bytes is cut alike wherever it stands.
    A chunk has at most 16 * mean bytes; empty data has no chunk.
    """
    ends: list[int] = []
    step = 1 << 20
    for at in range(0, len(data), step):
        low = max(0, at - WINDOW)
        h = GEAR[np.frombuffer(data[low : at + step], np.uint8)]
        reach = 1
        while reach < WINDOW:
            h[reach:] += h[:-reach].copy() << np.uint32(reach)
            reach *= 2
        cut = np.flatnonzero((h >> np.uint32(32 - (mean.bit_length() - 1))) == 0) + 1 + low
        ends += cut[cut > at].tolist()
    out, last = [], 0
    for end in [*ends, len(data)]:
        while end - last > 16 * mean:
            last += 16 * mean
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def chunks_of(data: bytes, mean: int, seed: int) -> Iterator[tuple[bytes, bytes]]:
    last = 0
    for end in chunk_ends(data, mean):
        part = data[last:end]
        yield xxhash.xxh3_128_digest(part, seed=seed), part
        last = end


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = 4096, seed: int = 0) -> DataFrame:
    """One row per row of docs: _row, id, n_chars (code points), text_sha256 and recipe, the ordered chunk identifiers.

    What is cut and hashed is the text without white space; null is empty, and an empty text has an empty recipe.
    """

    def run(batches):
        for b in batches:
            raw = as_bytes(b.column(1))
            rows = [[], [], []]
            for t in raw:
                data = t.translate(None, SPACES)
                rows[0].append(len(t.decode()))
                rows[1].append(hashlib.sha256(data).hexdigest())
                rows[2].append([k for k, _ in chunks_of(data, mean, seed)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.list_(pa.binary()))],
                ["id", "n_chars", "text_sha256", "recipe"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_chars long, text_sha256 string, recipe array<binary>").withColumn("_row", F.monotonically_increasing_id())


def chunk_table(docs: DataFrame, text_col: str = "text", mean: int = 4096, seed: int = 0) -> DataFrame:
    """The distinct (chunk_id, chunk): each distinct chunk is moved once, copies are combined before the shuffle."""

    def run(batches):
        for b in batches:
            seen: dict[tuple[bytes, bytes], None] = {}
            size = 0
            for t in as_bytes(b.column(0)):
                for k, part in chunks_of(t.translate(None, SPACES), mean, seed):
                    if (k, part) not in seen:
                        seen[k, part] = None
                        size += len(part)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([p for _, p in seen], pa.binary())], ["chunk_id", "chunk"])
                    seen, size = {}, 0
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.binary()), pa.array([p for _, p in seen], pa.binary())], ["chunk_id", "chunk"])

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "chunk_id binary, chunk binary").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean_chunk: int = 4096) -> DataFrame:
    """Classes of texts that are identical once white space ([\\x20\\x09-\\x0D]) is deleted.

    Every text is cut into content-defined chunks. Chunk identifiers are 128-bit hashes that are verified: the
    distinct chunks are counted under each identifier, and if two ever share one, all are hashed anew with another
    seed. Texts are then compared by their ordered identifier lists; no text is moved but as distinct chunks, once.

    Returns one row per row of docs: id_col, keep_id, group_size, kept, text_sha256. Of a class the row with the most
    code points in the original text stays, then the smallest id (null last); of wholly equal rows one stays.
    Null text counts as empty, empty texts form one class, an empty table gives no row, other columns are ignored.
    """
    seed = 0
    while True:
        rows = staged(recipes(docs, id_col, text_col, mean_chunk, seed), "recipes")
        shared = chunk_table(docs, text_col, mean_chunk, seed).groupBy("chunk_id").agg(F.count("*").alias("n")).filter("n > 1")
        if shared.isEmpty():
            break
        seed += 1
    first = F.struct((-F.col("n_chars")).alias("c"), F.col("id").isNull().alias("z"), F.col("id").alias("id"), F.col("_row").alias("r"))
    groups = staged(rows.groupBy("recipe").agg(F.min(first).alias("first"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first.r")).alias("kept"),
        "text_sha256",
    )
