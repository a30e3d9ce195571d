"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from basketry.llm.store import staged
from basketry.llm.toxicity import PLAIN
from basketry.llm.words import as_bytes, hashed_words, in_chunks, shingles


BASE = 0x9E3779B97F4A7C15  # of the running hashes


class _Side:
    """The words of one side with their running hash, and which of them no tile has marked."""

    def __init__(self, words: np.ndarray):
        self.words, n = words, len(words)
        self.hash, self.free = np.zeros(n + 1, np.uint64), np.ones(n, bool)
        self.hash[1:] = np.cumsum(words * _powers(1 << n.bit_length())[:n], dtype=np.uint64)

    def windows(self, k: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows of k words that no tile touches; `longest`, at least all places, is common to both sides."""
        marked = np.concatenate(([0], np.cumsum(~self.free)))
        at = np.flatnonzero(marked[k:] == marked[:-k]) if k <= len(self.free) else np.zeros(0, np.int64)
        return at, (self.hash[at + k] - self.hash[at]) * _powers(longest)[longest - at]


@functools.lru_cache(64)
def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, BASE, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def greedy_tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (place in a, place in b, length) of equal words: the longest unmarked matches first, none overlapping.

    The length of the longest match of unmarked words is found by halving: windows of one length have running hashes
    (Karp-Rabin), and some window of a stands in b or none does. All matches of that length are then marked from left
    to right, each checked word by word; the next length is shorter. Matches under `least` words are left out. Memory
    is in proportion to the words; tiles of m words have under sqrt(2 m) different lengths, and each costs about
    log(m) passes over the words.
    """
    if least < 1 or len(a) < least or len(b) < least:
        return []
    x, y, tiles = _Side(a), _Side(b), []
    n = 1 << max(len(a), len(b)).bit_length()

    def meet(k: int) -> bool:
        return bool(np.isin(y.windows(k, n)[1], x.windows(k, n)[1]).any())

    most = min(len(a), len(b))
    while most >= least and meet(least):
        low, high = least, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if meet(mid) else (low, mid - 1)
        (at_a, hash_a), (at_b, hash_b) = x.windows(low, n), y.windows(low, n)
        hit = np.isin(hash_a, hash_b)
        where: dict[int, list[int]] = {}
        there = np.isin(hash_b, hash_a)
        for j, h in zip(at_b[there][::-1].tolist(), hash_b[there][::-1].tolist(), strict=True):
            where.setdefault(h, []).append(j)
        end = 0
        for i, h in zip(at_a[hit].tolist(), hash_a[hit].tolist(), strict=True):
            places = where[h]
            while places and not y.free[places[-1] : places[-1] + low].all():
                places.pop()
            if i < end or not places or not (a[i : i + low] == b[places[-1] : places[-1] + low]).all():
                continue
            j, end = places.pop(), i + low
            x.free[i:end] = y.free[j : j + low] = False
            tiles.append((i, j, low))
        most = low - 1
    return tiles


class Items:
    """The words of benchmark items with an index of their seeds, as one task holds them."""

    def __init__(self, ids: list, texts: list[bytes], least: int):
        h, offsets = hashed_words([t.translate(PLAIN) for t in texts])
        self.least, self.items = least, [(i, h[offsets[k] : offsets[k + 1]]) for k, i in enumerate(ids)]
        self.seeds: dict[int, dict[int, list[int]]] = {}  # by length, then hash: items
        for k, (_, words) in enumerate(self.items):
            n = min(least, len(words))
            for s in set(shingles(words, n).tolist()) if n else ():
                self.seeds.setdefault(n, {}).setdefault(s, []).append(k)
        self.maps = {}
        for n, found in self.seeds.items():
            bits = np.zeros(1 << 22, bool)
            bits[(np.fromiter(found, np.uint64, len(found)) >> np.uint64(42)).astype(np.int64)] = True
            self.maps[n] = bits

    def matches(self, texts: list[bytes]) -> list[list[tuple]]:
        """For each text (id, item words, covered words, tiles) of every item that shares a seed with it."""
        out: list[list[tuple]] = [[] for _ in texts]
        for a, b in in_chunks(texts):
            h, offsets = hashed_words([t.translate(PLAIN) for t in texts[a:b]])
            near: set[tuple[int, int]] = set()
            for n, found in self.seeds.items():
                if len(h) < n:
                    continue
                windows = shingles(h, n)
                at = np.flatnonzero(self.maps[n][(windows >> np.uint64(42)).astype(np.int64)])
                doc = np.searchsorted(offsets, at, side="right") - 1
                inside = at + n <= offsets[doc + 1]
                for d, w in zip(doc[inside].tolist(), windows[at[inside]].tolist(), strict=True):
                    near.update((d, k) for k in found.get(w, ()))
            for d, k in sorted(near):
                item, words = self.items[k]
                tiles = greedy_tiles(h[offsets[d] : offsets[d + 1]], words, min(self.least, len(words)))
                if tiles:
                    out[a + d].append((item, len(words), sum(t[2] for t in tiles), len(tiles)))
        return out


def _pairs_type(item_type: DataType) -> tuple[pa.DataType, str]:
    kind = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("item_words", pa.int64()), ("covered", pa.int64()), ("tiles", pa.int64())]))
    return kind, f"array<struct<item:{item_type.simpleString()},item_words:long,covered:long,tiles:long>>"


def _as_structs(found: list[list[tuple]]) -> list[list[dict]]:
    return [[dict(zip(("item", "item_words", "covered", "tiles"), t, strict=True)) for t in x] for x in found]


def _tiler(items: DataFrame, least: int, broadcast_bytes: int):
    """A function from a text column to its matches with all items, which every task holds; None beyond the size bound."""
    size = items.agg(F.sum(F.octet_length("_item_text") + 64).alias("n")).first()["n"] or 0
    if size > broadcast_bytes:
        return None
    rows = items.collect()
    shared = items.sparkSession.sparkContext.broadcast(([r["_item"] for r in rows], [r["_item_text"].encode() for r in rows]))
    kind, sql = _pairs_type(items.schema["_item"].dataType)
    cache: dict = {}

    @F.arrow_udf(sql)
    def tile(column: pa.Array) -> pa.Array:
        if "items" not in cache:
            cache["items"] = Items(*shared.value, least)
        return pa.array(_as_structs(cache["items"].matches(as_bytes(column))), kind)

    return tile


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    text = F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))
    return benchmark.select(F.col(item_col).alias("_item"), text.alias("_item_text")).filter("_item is not null")


MAP = 27  # bits of a seed by which it stands in the bit map


def _item_seeds(least: int):
    """A task's function over items: their distinct seeds, with the item's words, the seed's words and its places."""

    def run(batches):
        for batch in batches:
            for k, t in zip(batch.column(0), as_bytes(batch.column(1)), strict=True):
                h, _ = hashed_words([t.translate(PLAIN)])
                n = min(least, len(h))
                s, times = np.unique(shingles(h, n), return_counts=True) if n else (h, np.zeros(0, np.int64))
                cols = [np.full(len(s), len(h), np.int32), np.full(len(s), n, np.int32), times.astype(np.int32), s.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(s)), *map(pa.array, cols)], ["_item", "words", "size", "times", "seed"])

    return run


def _text_seeds(seeds: DataFrame):
    """A task's function over texts: those of their windows that the bit map of seeds has."""
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << (MAP - 10), bool)
        bits[(table.column("seed").to_numpy().view(np.uint64) >> np.uint64(64 - MAP)).astype(np.int64) & (len(bits) - 1)] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    parts = seeds.select(F.shiftrightunsigned("seed", 54).cast("int").alias("part"), "seed").distinct()
    parts = {r["part"]: r["bits"] for r in parts.groupBy("part").applyInArrow(pack, "part int, bits binary").collect()}
    empty = bytes(1 << (MAP - 13))
    shared = seeds.sparkSession.sparkContext.broadcast(b"".join(parts.get(i, empty) for i in range(1 << 10)))

    def run(batches):
        there = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            for row, t in zip(batch.column(0).to_numpy(), as_bytes(batch.column(1)), strict=True):
                h, _ = hashed_words([t.translate(PLAIN)])
                found = [w[there[(w >> np.uint64(64 - MAP)).astype(np.int64)]] for n in sizes if n <= len(h) for w in [shingles(h, n)]]
                s = np.unique(np.concatenate(found)) if found else h[:0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), row)), pa.array(s.view(np.int64))], ["_row", "seed"])

    return run


def tiled_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 4,
    broadcast_bytes: int = 16 << 20,
    coverage: float = 0.0,
) -> DataFrame:
    """Every (document, item) that shares a tile of at least `least` words: _row, id_col, item_col, item_words, covered, tiles.

    Words are runs of bytes other than white space, ASCII punctuation counting as white space, A-Z lower-cased. Seeds
    are an item's windows of `least` words (an item with fewer words is one seed, one without words has none). Up to
    broadcast_bytes of item text every task holds the items with their seed index and whole documents are tiled where
    they are read, without a shuffle. Beyond it the seeds of both sides are joined, and the pairs that share one are
    tiled after joining their texts. A document's windows are made of the lengths that items have, and only where a bit
    map of all seeds (16 MB, whatever their number) has them. Where pairs under a `coverage` of the item's words need
    not be found, an item's most frequent seeds are left out of the join: tiles that cover w words hold w / least of
    its windows at least, so as long as fewer places are left out, one of the others is met.
    """
    items = _items(benchmark, item_col, item_text_col)
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    item_type = items.schema["_item"].dataType
    kind, sql = _pairs_type(item_type)
    tile = _tiler(items, least, broadcast_bytes)
    if tile is not None:
        found = source.select("_id", F.explode(tile(F.col("_text"))).alias("_m"))
    else:

        rows = staged(source.withColumn("_row", F.monotonically_increasing_id()), "documents")
        right = staged(items.mapInArrow(_item_seeds(least), f"_item {item_type.simpleString()}, words int, size int, times int, seed long"), "seeds")
        left = rows.select("_row", "_text").mapInArrow(_text_seeds(right), "_row long, seed long")
        left = staged(left, "left")
        spread = left.groupBy("seed").agg(F.count("*").alias("docs"))
        common = Window.partitionBy("_item").orderBy(F.col("docs").desc(), "seed").rowsBetween(Window.unboundedPreceding, 0)
        wanted = right.join(spread, "seed").withColumn("places", F.sum("times").over(common)).filter(F.col("places") >= F.ceil(F.col("words") * coverage / F.col("size")))
        near = left.join(wanted.select("seed", "_item"), "seed").select("_row", "_item").distinct()

        @F.arrow_udf(sql)
        def tile_pair(text: pa.Array, item: pa.Array, item_text: pa.Array) -> pa.Array:
            out = [Items([i], [t], least).matches([d])[0] for d, i, t in zip(as_bytes(text), item.to_pylist(), as_bytes(item_text), strict=True)]
            return pa.array(_as_structs(out), kind)

        found = near.join(rows, "_row").join(items, "_item").select("_id", F.explode(tile_pair("_text", "_item", "_item_text")).alias("_m"))
    return found.select(F.col("_id").alias(id_col), F.col("_m.item").alias(item_col), F.col("_m.item_words").alias("item_words"), F.col("_m.covered").alias("covered"), F.col("_m.tiles").alias("tiles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id", **options) -> DataFrame:
    """The (document, benchmark item) pairs whose tiles cover `threshold` of the item's words or more.

    Tiles may stand in any order, so a passage whose sentences were moved about is caught too. Returns id_col,
    item_col, item_words, covered, tiles, coverage, one row per row of docs and row of benchmark that match. Null and
    empty texts match nothing, nor do items with a null id; an empty table on either side gives no row; repeated
    rows each match; other columns are ignored. options go to tiled_pairs().
    """
    pairs = tiled_pairs(docs, benchmark, id_col=id_col, item_col=item_col, coverage=threshold, **options)
    return pairs.withColumn("coverage", F.col("covered") / F.col("item_words")).filter(F.col("coverage") >= threshold)


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    least: int = 4,
    broadcast_bytes: int = 16 << 20,
) -> DataFrame:
    """docs without the rows that contaminated() pairs with an item: a filter where every task can hold the items.

    Keeps the columns of docs, whatever their names. Rows are told apart by their place, not their id, so null and
    repeated ids are judged like others.
    """
    tile = _tiler(_items(benchmark, item_col, item_text_col), least, broadcast_bytes)
    if tile is not None:
        return docs.filter(~F.exists(tile(F.col(text_col).cast("string")), lambda m: m["covered"] / m["item_words"] >= threshold))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(text_col).cast("string").alias("_text"))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    options = {"text_col": "_text", "item_col": item_col, "item_text_col": item_text_col, "least": least, "broadcast_bytes": broadcast_bytes}
    bad = contaminated(rows, benchmark, threshold=threshold, id_col="_row", **options).select("_row").distinct()
    return rows.join(bad, "_row", "left_anti").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
