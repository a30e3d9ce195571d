"""Jaccard join of word shingles in the metric space of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.graph import components
from basketry.llm.store import discard, staged
from basketry.llm.words import as_bytes, hashed_words, in_chunks, mix, shingles

SAMPLE = 16  # the first sites of a document hold 1/SAMPLE of its shingles beyond those that a partner may lack


def sets_of(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text."""
    for a, b in in_chunks(texts):
        h, offsets = hashed_words(texts[a:b])
        for i in range(b - a):
            yield np.unique(shingles(h[offsets[i] : offsets[i + 1]], n))


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    a, b = mix(s ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), mix(s + np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def lacking(n, percent: int):
    """The most shingles of a set of n that a set linked with it can lack: overlap is percent % of n at least."""
    return n - (n * percent + 99) // 100


def _needed(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100).cast("long")


def _overlap(left: str, right: str) -> Column:
    @F.arrow_udf("int")
    def common(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x, y, strict=True)
        return pa.array([len(np.intersect1d(np.asarray(a.values), np.asarray(b.values), assume_unique=True)) for a, b in pairs], pa.int32())

    return common(left, right)


def _linked(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _ring_links(percent: int):
    """A task's function: links among the members of one ring of a region and to the ring inside it.

    Members whose distances to the pivot differ by more than the threshold are not compared (triangle inequality),
    nor are those that links found before already connect; one link is returned for each pair of parts it connects.
    A group of two blocks compares one block's members with the other's.
    """

    def run(table: pa.Table) -> pa.Table:
        row, own, n, home, i0, j0 = (table.column(c).to_numpy() for c in ("row", "own", "n", "home", "i", "j"))
        across = len(row) > 0 and i0[0] != j0[0]
        far = table.column("far").to_numpy()
        sets = [np.asarray(s.values) for s in table.column("set")]
        part = list(range(len(row)))

        def root(i: int) -> int:
            while part[i] != i:
                part[i] = part[part[i]]
                i = part[i]
            return i

        order = np.argsort(far, kind="stable")
        sorted_far = far[order]
        eps = 1 - percent / 100 + 1e-9
        links = []
        for i in np.flatnonzero(own):
            lo, hi = np.searchsorted(sorted_far, [far[i] - eps, far[i] + eps], side="left")
            for j in order[lo : hi + 1]:
                if i == j or (across and home[i] == home[j]) or (own[j] and row[j] < row[i]) or 100 * min(n[i], n[j]) < percent * max(n[i], n[j]) or root(i) == root(j):
                    continue
                if _linked(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), n[i], n[j], percent):
                    links.append((int(row[i]), int(row[j])))
                    part[root(i)] = root(j)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


def set_links(sets: DataFrame, percent: int, block: int = 2000, load: int = 8_000_000) -> DataFrame:
    """Links a, b (rows) that connect what the links of all sets connect: sets has row, n, set (sorted, distinct sets).

    Shingles are ranked, rarest first. A linked pair's first common shingle is among the first lacking(n) + 1 of
    either; those are a document's sites. The least row at a site is a pivot. Every document is dealt to the regions
    of the pivots at its sites, so any two linked documents meet in one. A document within the threshold of a pivot
    is linked with it, and such balls need no further comparison inside. The others lie in rings of one threshold's
    width around the pivot; by the triangle inequality a ring is joined with itself and with the ring inside it, whose
    documents are copied to it. A ring of more than `block` documents or `load` shingles is parted by the sites of its
    pivot, since linked documents also share one of these: every document goes to its own sites there. What is still
    fuller, as all its documents share a site, is dealt to blocks, and every two blocks are one group: a task holds
    two blocks of sets at most.
    """
    items = sets.select("row", "n", F.explode("set").alias("s"))
    counts = items.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    shared = staged(items.join(counts, "s"), "shared")
    found = shared
    enough = shared.groupBy("row", "n").agg(F.count("*").alias("k")).filter(F.col("k") >= _needed(F.col("n"), percent)).select("row")
    shared = shared.join(enough, "row")
    # Shingles that nobody else has come first in rank: they take that many of the first places.
    place = Window.partitionBy("row").orderBy("df", "s")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("row"))
    allowed = F.col("n") - _needed(F.col("n"), percent) + 1
    sites = staged(shared.withColumn("i", F.row_number().over(place) + alone).filter(F.col("i") <= allowed).select("row", "s"), "sites")
    discard(found)
    pivots = sites.groupBy("s").agg(F.min("row").alias("p"), F.max("row").alias("q")).filter("p < q").select("s", "p")
    pivots = staged(pivots, "pivots")
    met = sites.join(pivots, "s").select("p", "row").distinct()
    member = sets.select("row", "n", "set")
    regions = met.join(member, "row").join(sets.select(F.col("row").alias("p"), F.col("n").alias("pn"), F.col("set").alias("pset")), "p")
    regions = regions.withColumn("o", F.when(F.col("p") == F.col("row"), F.col("n")).otherwise(_overlap("set", "pset")))
    far = staged(regions.select("p", "row", "n", "o", "pn", (1 - F.col("o") / (F.col("n") + F.col("pn") - F.col("o"))).alias("far")), "regions")
    near = _linked(F.col("o"), F.col("n"), F.col("pn"), percent)
    stars = far.filter(near & (F.col("p") != F.col("row"))).select(F.col("p").alias("a"), F.col("row").alias("b"))
    eps = 1 - percent / 100
    ring = F.when(near, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("far") / eps - 1e-9).cast("int") - 1))
    ringed = far.withColumn("ring", ring)
    own = ringed.filter("ring > 0")
    inside = ringed.withColumn("ring", F.col("ring") + 1).join(own.select("p", "ring").distinct(), ["p", "ring"], "left_semi")
    every = own.withColumn("own", F.lit(True)).unionByName(inside.withColumn("own", F.lit(False)))

    def sized(rows: DataFrame, *keys: str) -> DataFrame:
        found = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.sum("n").alias("all"), F.max("own").alias("any")).filter("size > 1 and any")
        blocks = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all") / load), F.lit(1)).cast("int")
        return staged(found.select(*keys, blocks.alias("blocks")), "sizes")

    rings = sized(every, "p", "ring")
    every = every.select("p", "ring", "row", "n", "own", "far").join(rings, ["p", "ring"])
    cells = every.filter("blocks = 1").withColumn("s", F.lit(0).cast("long"))
    if not rings.filter("blocks > 1").isEmpty():
        placed = sites.join(pivots, "s").select("p", "row", "s")
        parted = staged(every.filter("blocks > 1").drop("blocks").join(placed, ["p", "row"]), "parted")
        cells = cells.unionByName(parted.join(sized(parted, "p", "ring", "s"), ["p", "ring", "s"]))
    cells = cells.withColumn("home", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("p", "ring", "s", F.least("home", "other").alias("i"), F.greatest("home", "other").alias("j"), "row", "own", "home", "far")
    across = cells.join(member, "row").groupBy("p", "ring", "s", "i", "j").applyInArrow(_ring_links(percent), "a long, b long")
    return stars.unionByName(across)


def grouped(source: DataFrame, n: int, percent: int, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of source (row, id, text) with n, the size of their shingle set, and g, the key of their component.

    Equal sets are one point of the space. First, points that no other can reach are set aside, exactly: in the order
    of hashes, of a document's first lacking + 1/16 shingles one in sixteen must stand among the first of another
    set. The full sets of the rest, made anew from their texts, are joined by set_links(). Up to broadcast_rows
    points are looked up by a broadcast of their ids, more by a shuffle of the texts.
    """
    kind = source.schema["id"].dataType.simpleString()

    def first_sites(batches):
        for batch in batches:
            size, fa, fb, prefix = [], [], [], []
            for s in sets_of(as_bytes(batch.column(2)), n):
                size.append(len(s))
                a, b = fingerprint(s)
                fa.append(a)
                fb.append(b)
                prefix.append(s[: lacking(len(s), percent) + max(1, len(s) // SAMPLE)].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(fa, pa.int64()), pa.array(fb, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                ["row", "id", "n", "fa", "fb", "first"],
            )

    points = staged(source.mapInArrow(first_sites, f"row long, id {kind}, n long, fa long, fb long, first array<long>"), "points")
    at = points.filter("n > 0").select("row", "fa", F.explode("first").alias("s"))
    shared = at.groupBy("s").agg(F.min("fa").alias("lo"), F.max("fa").alias("hi")).filter("lo < hi").select("s")
    shared = staged(shared, "sites")
    hits = at.select("row", "s").join(shared, "s").groupBy("row").agg(F.count("*").alias("k"))
    least = F.greatest(F.lit(1), F.floor(_needed(F.col("n"), percent) / SAMPLE))
    reached = hits.join(points.drop("first"), "row").filter(F.col("k") >= least)
    one = staged(reached.groupBy("fa", "fb", "n").agg(F.min("row").alias("row"), F.min_by("id", "row").alias("id")), "reached")
    discard(shared)

    def full_sets(batches):
        for batch in batches:
            for k, s in enumerate(sets_of(as_bytes(batch.column(0)), n)):
                if fingerprint(s) == (batch.column(1)[k].as_py(), batch.column(2)[k].as_py()):
                    yield pa.RecordBatch.from_arrays([batch.column(3).slice(k, 1), pa.array([len(s)], pa.int64()), pa.array([s.view(np.int64)], pa.list_(pa.int64()))], ["row", "n", "set"])

    wanted = F.broadcast(one) if one.count() <= broadcast_rows else one
    wanted = wanted.withColumnRenamed("id", "_id").withColumnRenamed("row", "_row")
    sets = source.join(wanted, source["id"].eqNullSafe(F.col("_id"))).select("text", "fa", "fb", "_row")
    sets = staged(sets.mapInArrow(full_sets, "row long, n long, set array<long>").dropDuplicates(["row"]), "sets")
    links = staged(set_links(sets, percent), "links")
    discard(sets)
    parts = components(links, "a", "b").select(F.col("node").alias("row"), F.col("component").alias("part"))
    parts = parts.join(one.select("row", "fa", "fb", "n"), "row").select("fa", "fb", "n", "part")
    parts = staged(parts, "parts")
    keyed = points.drop("first").join(parts, ["fa", "fb", "n"], "left")


    def key(t: int, a: str, b: Column) -> Column:
        return F.struct(F.lit(t).alias("t"), F.col(a).alias("a"), b.cast("long").alias("b"))

    group = F.when(F.col("n") == 0, key(2, "row", F.lit(0))).when(F.col("part").isNull(), key(1, "fa", F.col("fb"))).otherwise(key(0, "part", F.lit(0)))
    keyed = staged(keyed.withColumn("g", group), "keyed")
    discard(points, one, links, parts)
    return keyed


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Components of the documents whose n-word shingle sets have a Jaccard similarity of percent / 100 or more.

    Words are runs of bytes other than white space, A-Z lower-cased; fewer than n words make one shingle.

    Returns one row per row of docs: id_col, n_shingles, component_id, the least id reachable by links, itself
    included. Null, empty and blank texts have no shingle and link with nothing; rows with equal ids are separate
    points; null ids are left out of a component's least id; an empty table gives no row; other columns are ignored.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = grouped(source, n, percent)
    least = staged(keyed.groupBy("g").agg(F.min("id").alias("component_id")), "least")
    return keyed.join(least, "g").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def dedup_near(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component of jaccard_components(): the least id (null last), then the first row.

    Documents without a shingle all stay. Keeps the columns of docs, whatever their names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    keyed = grouped(rows.select("row", "id", "text"), n, percent)
    first = F.min(F.struct(F.col("id").isNull().alias("z"), F.col("id").alias("i"), F.col("row").alias("r")))
    kept = staged(keyed.groupBy("g").agg(first.alias("first")).select(F.col("first.r").alias("row")), "kept")
    discard(keyed)
    return rows.join(kept, "row", "left_semi").select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
