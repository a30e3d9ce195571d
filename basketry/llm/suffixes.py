"""Removal of repeated byte strings by common-prefix intervals of an enhanced suffix array."""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import bucketed, discard, ranked, staged
from basketry.llm.words import as_bytes, in_chunks, mix, slices

GRAM = 28  # bytes of an anchor
CODES = np.random.default_rng(4).integers(0, 2**64, 256, dtype=np.uint64)
HOT = 60_000  # contexts of an anchor beyond which it is split by whole windows


def _joined(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes that begin at each place, by doubling."""
    runs, n = {1: CODES[data]}, 1
    power = {1: 0x9E3779B97F4A7C15}
    while 2 * n <= size:
        h = runs[n]
        runs[2 * n] = h[:-n] * np.uint64(power[n]) + h[n:]
        power[2 * n] = power[n] * power[n] % 2**64
        n *= 2
    out, at = None, 0
    while n:
        if size & n:
            part = runs[n][at:]
            out = part if out is None else out[: len(part)] * np.uint64(power[n]) + part
            at += n
        n //= 2
    return mix(out[: len(data) - size + 1])


def _slide(h: np.ndarray, width: int, fold) -> np.ndarray:
    """The least or greatest (fold) of each run of `width` numbers."""
    n, out = 1, h
    while 2 * n <= width:
        out = fold(out[:-n], out[n:])
        n *= 2
    return fold(out[: len(h) - width + 1], out[width - n :][: len(h) - width + 1]) if n < width else out


def anchors(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text the places and hashes of its anchors: every string of `length` bytes holds the same ones wherever it stands.

    An anchor is a gram of GRAM bytes with the least hash among those of some string of `length` bytes.
    """
    for a, b in in_chunks(texts, 1 << 19):
        sizes = np.array([len(t) for t in texts[a:b]], np.int64)
        begins = np.concatenate(([0], np.cumsum(sizes)))
        data = np.frombuffer(b"".join(texts[a:b]), np.uint8)
        width = length - GRAM + 1
        if len(data) < length:
            for _ in range(a, b):
                yield np.zeros(0, np.int64), np.zeros(0, np.uint64)
            continue
        h = _joined(data, GRAM)
        low = _slide(h, width, np.minimum)
        high = _slide(np.concatenate((np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64))), width, np.maximum)
        at = np.flatnonzero(high == h)
        text = np.searchsorted(begins, at, side="right") - 1
        inside = (at + GRAM <= begins[text + 1]) & (sizes[text] >= length)
        at, text = at[inside], text[inside]
        cut = np.searchsorted(text, np.arange(b - a + 1))
        for i in range(b - a):
            part = at[cut[i] : cut[i + 1]]
            yield part - begins[i], h[part]


def common(x: bytes, y: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n]) ^ int.from_bytes(y[:n])
    return n - (differ.bit_length() + 7) // 8


def intervals(rights: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(common prefix length, first, last) of every common-prefix interval of sorted suffixes, by a stack over their LCPs."""
    lcps = [common(x, y) for x, y in zip(rights, rights[1:], strict=False)] + [-1]
    stack: list[tuple[int, int]] = []
    for i, lcp in enumerate(lcps):
        first = i
        while stack and stack[-1][0] > lcp:
            value, first = stack.pop()
            yield value, first, i
        if lcp >= 0 and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, first))


def bucket_covers(contexts: list[tuple[bytes, bytes, tuple]], length: int) -> dict[int, tuple[int, int]]:
    """The covers of the contexts of one anchor: (right, left reversed, place), sorted; {member: (begin, end)}.

    For every interval of suffixes that share l bytes to the right, each member is set against the earlier ones: the
    longest left extension it shares with one of them. If left and right make up `length`, the bytes from -left to l
    around its anchor repeat. Neighbours alone would miss this: any earlier member of the interval counts. Only members
    that share the `length` - l bytes to their left can make it up, so the others are not compared. All covers of a
    member hold the anchor, so together they are one run of bytes. Intervals come longest first, so a member whose
    whole left context is covered gains nothing from a wider interval.
    """
    if len(contexts) == 2:
        (x, p, first), (y, q, second) = contexts
        left, right = common(p, q), common(x, y)
        return {int(first < second): (-left, right)} if left + right >= length else {}
    covers: dict[int, tuple[int, int]] = {}
    for right, first, last in intervals([c[0] for c in contexts]):
        least = max(0, length - right)
        groups: dict[bytes, list[int]] = {}
        for i in range(first, last + 1):
            if len(left := contexts[i][1]) >= least:
                groups.setdefault(left[:least], []).append(i)
        for members in groups.values():
            if len(members) < 2:
                continue
            members.sort(key=lambda i: contexts[i][2])
            if all(i in covers and -covers[i][0] == len(contexts[i][1]) for i in members[1:]):
                continue
            seen: list[bytes] = [contexts[members[0]][1]]
            for i in members[1:]:
                left = contexts[i][1]
                at = bisect_left(seen, left)
                best = max(common(left, x) for x in seen[max(0, at - 1) : at + 1])
                a, b = covers.get(i, (0, 0))
                covers[i] = (min(a, -best), max(b, right))
                insort(seen, left)
    return covers


def maximal_repeats(contexts: list[tuple[bytes, bytes, tuple]], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) of the maximal repeats around one anchor that make up `length`.

    The members of a suffix interval agree in `right` bytes; sorted by what stands to their left, they fall into
    intervals of their own, whose members agree in `left` bytes and differ in the byte before. Such a group is maximal
    if it differs in the byte behind too: otherwise a narrower suffix interval has it with more bytes.
    """
    for right, first, last in intervals([c[0] for c in contexts]):
        if right + max(len(contexts[i][1]) for i in range(first, last + 1)) < length:
            continue
        order = sorted(range(first, last + 1), key=lambda i: contexts[i][1])
        for left, a, b in intervals([contexts[i][1] for i in order]):
            members = order[a : b + 1]
            if left + right >= length and common(contexts[min(members)][0], contexts[max(members)][0]) == right:
                yield left, right, members


def prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """rows (row, id, text) and texts (row, id, ord, n_bytes, hash, copy): ord is the order of (id, row), null last.

    copy tells rows whose whole text came before. rows is bucketed by row: texts are moved once, here, and what is
    found out about them later is brought to them.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = bucketed(rows, "row")
    texts = rows.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("hash"))
    texts = ranked(texts, [F.col("id").isNull(), F.col("id"), F.col("row")], "ord")
    texts = staged(texts, "texts")
    firsts = staged(texts.groupBy("hash").agg(F.min("ord").alias("first")), "firsts")
    return rows, staged(texts.join(firsts, "hash").withColumn("copy", F.col("ord") != F.col("first")).drop("first"), "ordered")


def repeat_contexts(rows: DataFrame, texts: DataFrame, length: int, reach: int) -> DataFrame:
    """Every occurrence of an anchor that has another one: ca, cb (hash of its context), h, row, ord, pos, nl, nr.

    The context is the `reach` - GRAM bytes before the anchor and the `reach` bytes from it on; nl and nr are how
    many of them the text has.
    """
    firsts = texts.filter(~F.col("copy") & (F.col("n_bytes") >= length)).select("row", "ord")
    use = rows.select("row", "text").join(firsts, "row")

    def grams(batches):
        for batch in (part for b in batches for part in slices(b)):
            hashes, owners, twice = [], [], []
            for key, (_, h) in zip(batch.column(0).to_numpy(), anchors(as_bytes(batch.column(1)), length), strict=True):
                one, n = np.unique(h, return_counts=True)
                hashes.append(one)
                owners.append(np.full(len(one), key))
                twice.append(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(twice))], ["h", "row", "twice"])

    found = staged(use.select("row", "text").mapInArrow(grams, "h long, row long, twice boolean"), "grams")
    shared = found.groupBy("h").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.max("twice").alias("twice")).filter("lo < hi or twice").select("h")
    shared = staged(shared, "shared")
    own = staged(found.select("h", "row").join(shared, "h").groupBy("row").agg(F.collect_list("h").alias("hs")), "own")
    discard(found, shared)

    def contexts(batches):
        before = reach - GRAM
        for batch in (part for b in batches for part in slices(b)):
            out: list[list] = [[], [], [], [], [], []]
            data, wanted = as_bytes(batch.column(2)), batch.column(3)
            digest = xxhash.xxh3_128_digest
            for i, (places, h) in enumerate(anchors(data, length)):
                keep = np.isin(h, np.asarray(wanted[i].values).view(np.uint64))
                text, p = data[i], places[keep]
                found = [digest(text[max(0, k - before) : k + reach], min(k, before)) for k in p.tolist()]
                out[0].append(np.frombuffer(b"".join(found), np.int64).reshape(-1, 2))
                out[1].append(h[keep].view(np.int64))
                out[2].append(np.full(len(p), batch.column(0)[i].as_py()))
                out[3].append(np.full(len(p), batch.column(1)[i].as_py()))
                out[4].append(p)
                out[5].append(np.minimum(reach, len(text) - p))
            ca, h, row, order, p, nr = (np.concatenate(x) for x in out)
            cols = [ca[:, 0], ca[:, 1], h, row, order, p.astype(np.int32), np.minimum(p, before).astype(np.int32), nr.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], ["ca", "cb", "h", "row", "ord", "pos", "nl", "nr"])

    made = use.join(own, "row").select("row", "ord", "text", "hs").mapInArrow(contexts, "ca long, cb long, h long, row long, ord long, pos int, nl int, nr int")
    made = staged(made, "contexts")
    discard(own)
    return made


def with_bytes(rows: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Places (row, ord, pos, h, ca, cb) with the context's bytes: right, and left reversed."""
    lists = places.groupBy("row").agg(F.collect_list(F.struct("ord", "pos", "h", "ca", "cb")).alias("places"))

    def run(batches):
        for batch in (part for b in batches for part in slices(b)):
            out: list[tuple] = []
            for text, found in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                out += [(x["h"], text[x["pos"] : x["pos"] + length], text[max(0, x["pos"] - (length - GRAM)) : x["pos"]][::-1], x["ord"], x["pos"], x["ca"], x["cb"]) for x in found]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CONTEXT, strict=True)], schema=CONTEXT)

    return rows.join(lists, "row").select("text", "places").mapInArrow(run, CONTEXT_SQL)


CONTEXT = pa.schema([("h", pa.int64()), ("right", pa.binary()), ("left", pa.binary()), ("ord", pa.int64()), ("pos", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64())])
CONTEXT_SQL = "h long, right binary, left binary, ord long, pos long, ca long, cb long"


def _buckets(batches) -> Iterator[list[tuple[bytes, bytes, tuple]]]:
    """The contexts of each anchor from rows sorted by anchor, right and left; equal ones are one, at its first place."""
    now, bucket = None, []
    for batch in batches:
        whole = [batch.column(c).to_numpy().tolist() for c in ("h", "ord", "pos", "ca", "cb")]
        for h, order, pos, ca, cb, right, left in zip(*whole, as_bytes(batch.column("right")), as_bytes(batch.column("left")), strict=True):
            if h != now:
                if len(bucket) > 1:
                    yield bucket
                now, bucket = h, []
            if bucket and bucket[-1][0] == right and bucket[-1][1] == left:
                if (order, pos) < bucket[-1][2][:2]:
                    bucket[-1] = (right, left, (order, pos, ca, cb))
            else:
                bucket.append((right, left, (order, pos, ca, cb)))
    if len(bucket) > 1:
        yield bucket


def _scan(length: int):
    def run(batches):
        out = []
        for bucket in _buckets(batches):
            out += [(bucket[i][2][2], bucket[i][2][3], a, b) for i, (a, b) in bucket_covers(bucket, length).items()]
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["ca", "cb", "a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["ca", "cb", "a", "b"])

    return run


GROUPED = pa.schema([("ca", pa.int64()), ("cb", pa.int64()), ("left", pa.int64()), ("size", pa.int64()), ("g1", pa.int64()), ("g2", pa.int64())])
GROUPED_SQL = "ca long, cb long, left long, size long, g1 long, g2 long"


def _string_key(text: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(text)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _scan_groups(length: int):
    """Which contexts hold which maximal repeat, named by the hash of its bytes."""

    def run(batches):
        out = []
        for bucket in _buckets(batches):
            for left, right, members in maximal_repeats(bucket, length):
                x = bucket[members[0]]
                key = _string_key(x[1][:left][::-1] + x[0][:right])
                for i in members:
                    out.append((*bucket[i][2][2:], left, left + right, *key))
                    if len(out) > 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=GROUPED)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=GROUPED)

    return run


def _whole_contexts(length: int):
    """The same for contexts that stand in several places: all of their bytes repeat."""

    def run(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("ca", "cb", "left", "right")]
            out = [(ca, cb, len(x), len(x) + len(y), *_string_key(x[::-1] + y)) for ca, cb, x, y in zip(*cols, strict=True) if len(x) + len(y) >= length]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=GROUPED)

    return run


def _windows(length: int):
    """Whole windows of contexts: wa, wb (their hash), place of the context, and the offset before the anchor."""

    def run(batches):
        for batch in (part for b in batches for part in slices(b, 256)):
            out = []
            for ca, cb, order, pos, left, right in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "ord", "pos", "left", "right")), strict=True):
                text, n = left[::-1] + right, len(left)
                for t in range(max(0, length - len(right)), n + 1):
                    d = xxhash.xxh3_128_digest(text[n - t : n - t + length], seed=t)
                    out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), order, pos, ca, cb, t))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["wa", "wb", "ord", "pos", "ca", "cb", "t"])

    return run


def context_covers(rows: DataFrame, firsts: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """For the first occurrences of contexts the covers a..b (around the anchor) that an earlier other context gives.

    firsts has ca, cb, h and first (ord, pos, row). An anchor with one context needs no look at bytes. The contexts
    of the others are dealt by anchor, sorted by suffix and scanned. An anchor with more than `hot` contexts is not
    put in one task: its contexts are compared as whole windows, by a minimum with map-side partial results.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = staged(firsts.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1"), "many")
    held = firsts.join(many, "h").select("h", "m", "ca", "cb", "first.*")
    usual = with_bytes(rows, held.filter(F.col("m") <= hot), length)
    split = not many.filter(F.col("m") > hot).isEmpty()
    scanned = usual.repartition(n, "h").sortWithinPartitions("h", "right", "left").mapInArrow(_scan(length), "ca long, cb long, a long, b long")
    if not split:
        return scanned
    windows = with_bytes(rows, held.filter(F.col("m") > hot), length).mapInArrow(_windows(length), "wa long, wb long, ord long, pos long, ca long, cb long, t long")
    windows = staged(windows, "windows")
    earliest = staged(windows.groupBy("wa", "wb").agg(F.min(F.struct("ord", "pos")).alias("first")), "earliest")
    later = windows.join(earliest, ["wa", "wb"]).filter(F.struct("ord", "pos") > F.col("first"))
    return scanned.unionByName(later.select("ca", "cb", (-F.col("t")).alias("a"), (length - F.col("t")).alias("b")).distinct())


def repeat_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, reach: int = 2000) -> DataFrame:
    """Maximal repeats of `length` bytes or more, with all their places: group, id_col, begin, size.

    A repeat is maximal if its places differ both in the byte before and in the byte behind. It is followed up to
    `reach` bytes to either side of an anchor, so a longer one is told in overlapping parts. A group is named by the
    hash of its bytes. Bytes of UTF-8; null is empty; equal texts all have their places; an empty table gives no row.
    Equal contexts are scanned once and get their places back by a join. The different contexts of one anchor are
    scanned in one task, `reach` bytes to either side each.
    """
    rows, texts = prepared(docs, id_col, text_col)
    every = repeat_contexts(rows, texts, length, reach)
    firsts = every.groupBy("ca", "cb").agg(F.min("h").alias("h"), F.min(F.struct("ord", "pos", "row")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts, "first-contexts")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = firsts.select("h", "ca", "cb", "n", "first.*")
    scanned = with_bytes(rows, held, reach).repartition(n, "h").sortWithinPartitions("h", "right", "left").mapInArrow(_scan_groups(length), GROUPED_SQL)
    whole = with_bytes(rows, held.filter("n > 1"), reach).mapInArrow(_whole_contexts(length), GROUPED_SQL)
    found = scanned.unionByName(whole).join(every.select("ca", "cb", "ord", "pos"), ["ca", "cb"])
    found = found.select("ord", (F.col("pos") - F.col("left")).alias("begin"), "size", "g1", "g2").distinct()
    found = staged(found, "groups")
    discard(every, firsts)
    # Equal texts: the places of the first hold for all, and each is a repeat as a whole if nothing else has all of it.
    ids = texts.select(F.col("id").alias(id_col), "hash", F.col("row").alias("_row"))
    spread = found.join(texts.select("ord", "hash"), "ord").join(ids, "hash").select(F.struct("g1", "g2", "size").alias("group"), id_col, "_row", "begin", "size")
    twice = texts.groupBy("hash").agg(F.count("*").alias("k"), F.min("ord").alias("ord"), F.first("n_bytes").alias("size")).filter((F.col("k") > 1) & (F.col("size") >= length))
    twice = twice.join(found.filter("begin = 0").select("ord", "size"), ["ord", "size"], "left_anti")
    g = [F.xxhash64("hash", F.lit(i)).alias(f"g{i}") for i in (1, 2)]
    alike = twice.join(ids, "hash").select(F.struct(*g, "size").alias("group"), id_col, "_row", F.lit(0).cast("long").alias("begin"), "size")
    return spread.unionByName(alike).drop("_row")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 100, hot: int = HOT) -> DataFrame:
    """What is left of every text when each byte goes that a string of `length` bytes covers which also starts earlier.

    Earlier is a smaller id (null last), then an earlier row, then an earlier place in the text; strings are judged
    on the input and do not cross texts. A text that came before goes as a whole. Otherwise anchors (see anchors())
    that occur twice are compared with their contexts by a scan of sorted suffixes.

    Returns one row per row of docs: id_col, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and kept,
    the bytes that stay. Null counts as empty; texts under `length` bytes are left alone; an empty table gives no row;
    other columns are ignored.
    """
    rows, texts = prepared(docs, id_col, text_col)
    contexts = repeat_contexts(rows, texts, length, length)
    firsts = contexts.groupBy("ca", "cb").agg(F.min("h").alias("h"), F.min(F.struct("ord", "pos", "row")).alias("first"), F.count("*").alias("n"))
    firsts = staged(firsts, "first-contexts")
    covers = staged(context_covers(rows, firsts, length, hot), "covers")
    places = contexts.select("ca", "cb", "row", "ord", "pos", "nl", "nr")
    again = places.join(firsts.filter("n > 1"), ["ca", "cb"]).filter(((F.col("ord") != F.col("first.ord")) | (F.col("pos") != F.col("first.pos"))) & (F.col("nl") + F.col("nr") >= length))
    again = again.select("row", (F.col("pos") - F.col("nl")).cast("long").alias("a"), (F.col("pos") + F.col("nr")).cast("long").alias("b"))
    at_first = covers.join(firsts, ["ca", "cb"]).select("first.row", (F.col("first.pos") + F.col("a")).alias("a"), (F.col("first.pos") + F.col("b")).alias("b"))
    whole = texts.filter(F.col("copy") & (F.col("n_bytes") >= length)).select("row", F.lit(0).cast("long").alias("a"), F.col("n_bytes").alias("b"))
    spans = again.unionByName(at_first).unionByName(whole).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    spans = staged(spans, "spans")
    discard(contexts, firsts, covers, texts)

    def cut(batches):
        for batch in (part for b in batches for part in slices(b)):
            out = []
            for text, found in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                kept, at, runs, end = [], 0, 0, -1
                for s in found or ():
                    if s["a"] > end:
                        runs += 1
                        kept.append(text[at : s["a"]])
                    end = max(end, s["b"])
                    at = end
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = rows.schema["id"].dataType.simpleString()
    joined = rows.join(spans, "row", "left").select("id", "text", "spans")
    return joined.mapInArrow(cut, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
