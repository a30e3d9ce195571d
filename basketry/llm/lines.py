"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import discard, ranked, staged


def lines_of(text: str | None, least: int) -> Iterator[tuple[int, str]]:
    """Place and stripped content of the lines with `least` characters or more."""
    for i, line in enumerate((text or "").split("\n")):
        if len(line) >= least and len(line := line.strip()) >= least:
            yield i, line


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """(begin, size) of the even segments of a line; the last ones are longer by one where it doesn't divide."""
    size, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=1 << 14)
def key_places(n: int, edits: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(begin, end, seed) of the own segments of a line of n characters, and of its probes, see segment_keys()."""
    parts = edits + 1
    own = [(at, at + size, n * 64 + i) for i, (at, size) in enumerate(segments(n, parts))]
    probes = []
    for short in range(max(parts, n - edits), n + 1):
        shift = n - short
        for i, (at, size) in enumerate(segments(short, parts)):
            low = max(at - i, at + shift - (edits - i), 0)
            high = min(at + i, at + shift + (edits - i), n - size)
            probes += [(p, p + size, short * 64 + i) for p in range(low, high + 1) if shift or p != at]
    return own, probes


def segment_keys(line: str, edits: int) -> tuple[list[int], list[int]]:
    """Hashes of the line's own segments, and of the substrings by which it finds lines that are up to `edits` shorter.

    Two lines within `edits` edits share a segment of the shorter one. Of the longer one only those substrings are
    probed that can stand against it if the edits before and after are counted from both ends (multi-match-aware).
    A substring that is a segment of the line itself is not probed again.
    """
    digest = xxhash.xxh3_64_intdigest
    own, probes = key_places(len(line), edits)
    if line.isascii():
        raw = line.encode()
        return [digest(raw[a:b], seed) for a, b, seed in own], [digest(raw[a:b], seed) for a, b, seed in probes]
    return [digest(line[a:b].encode(), seed) for a, b, seed in own], [digest(line[a:b].encode(), seed) for a, b, seed in probes]


@cache
def _dealt(total: int, most: int, bins: int, low: int) -> list[tuple[int, ...]]:
    """All ways to write `total` as `bins` numbers from low to most each."""
    if not bins:
        return [()] if not total else []
    return [(x, *rest) for x in range(low, most + 1) for rest in _dealt(total - x, most, bins - 1, low)]


#: Free stretches of the shorter line, flat: begin, end, edits that it may hold, letters that the longer line has more there.
Spec = tuple[int, ...]


def split_spec(spec: Spec, parts: int, own: bool) -> Iterator[Spec]:
    """Specs with each free stretch cut in `parts` and its edits dealt to the pieces; pieces without edits are no longer free.

    For an own line the longer line is itself. Two lines that a spec lets differ by their edits also meet in one of its
    pieces' specs, as each edit falls in a piece (an insertion at a cut in either).
    """
    out: list[Spec] = [()]
    for at in range(0, len(spec), 4):
        lo, hi, edits, more = spec[at : at + 4]
        n = max(1, min(parts, hi - lo))
        cuts = [(lo + b, lo + b + size) for b, size in segments(hi - lo, n)]
        ways = []
        for dealt in _dealt(edits, edits, n, 0):
            free = [(cut, e) for cut, e in zip(cuts, dealt, strict=True) if e]
            for shift in [(0,) * len(free)] if own else _dealt(more, edits, len(free), -edits):
                if all(abs(x) <= e for x, (_, e) in zip(shift, free, strict=True)):
                    ways.append(tuple(v for (cut, e), x in zip(free, shift, strict=True) for v in (*cut, e, x)))
        out = [a + b for a in out for b in ways]
    yield from out


def spec_key(line: str, short: int, spec: Spec) -> int:
    """The hash of what is not free: lines that can differ by the free stretches alone have the same one."""
    fixed, at, more = [], 0, 0
    for k in range(0, len(spec), 4):
        lo, hi, _, x = spec[k : k + 4]
        fixed.append(line[at + more : lo + more])
        at, more = hi, more + x
    fixed.append(line[at + more :])
    shape = [short, *(v for k in range(0, len(spec), 4) for v in spec[k : k + 3])]
    return _signed(xxhash.xxh3_64_intdigest("\n".join([*fixed, repr(shape)]).encode("utf-8", "surrogatepass")))


def free_ends(line: str, spec: Spec) -> tuple[int, int]:
    """Hashes of the line's first and last free stretch."""
    lo, hi, _, x = spec[:4]
    first = line[lo : hi + x]
    last = line[spec[-4] + sum(spec[3:-4:4]) : spec[-3] + sum(spec[3::4])]
    return tuple(_signed(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))) for t in (first, last))


def edit_distance(a: str, b: str, most: int) -> int:
    """The edit distance of two lines, or most + 1 if it is more.

    Bit-parallel over a diagonal band: bit 63 of a word is the band's lowest row, vertical differences of a column
    are two words, and the pattern's match words slide along with the band.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    begin = 0
    while begin < len(b) and a[begin] == b[begin]:
        begin += 1
    tail = 0
    while tail < len(b) - begin and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[begin : len(a) - tail], b[begin : len(b) - tail]
    if not b or len(a) <= most:
        return plain_distance(a, b, most)
    full, top = (1 << 64) - 1, 1 << 63
    up, down = (full << (63 - most)) & full, 0
    seen: dict[str, tuple[int, int]] = {}  # character: column of its word, word
    for j in range(most):
        at, word = seen.get(a[j], (j - most, 0))
        seen[a[j]] = (j - most, (word >> (j - most - at)) | top)
    dist, edge, worst = most, 1 << 62, 2 * most + len(b) - len(a)
    for j, c in enumerate(b):
        enters = j + most < len(a)
        if enters:
            at, word = seen.get(a[j + most], (j, 0))
            seen[a[j + most]] = (j, (word >> (j - at)) | top)
        at, word = seen.get(c, (j, 0))
        match = word >> (j - at)
        diagonal = ((((match & up) + up) & full) ^ up) | match | down
        plus = down | (full & ~(diagonal | up))
        minus = diagonal & up
        if enters:
            dist += not diagonal & top
        else:
            dist += bool(plus & edge) - bool(minus & edge)
            edge >>= 1
        if dist > worst:
            return most + 1
        up = minus | (full & ~((diagonal >> 1) | plus))
        down = (diagonal >> 1) & plus
    return min(dist, most + 1)


def plain_distance(a: str, b: str, most: int) -> int:
    """The edit distance by rows, for short remains."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row[-1], most + 1)


def _values(column: pa.Array, step: int = 256) -> Iterator:
    """The values of a column, a few at a time, so that a batch of long texts is not held twice."""
    for at in range(0, len(column), step):
        yield from column.slice(at, step).to_pylist()


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """hh, line: the contents of lines at given places (l, hh) of the texts; an error if a place holds another line."""
    for batch in batches:
        out: list[tuple] = []
        for places, text in zip(batch.column(0).to_pylist(), _values(batch.column(1)), strict=True):
            its = text.split("\n")
            for at in places:
                line = its[at["l"]].strip()
                if xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass")) != at["hh"]:
                    raise ValueError("the texts are not those that the places were found in")
                out.append((at["hh"], line))
        hh, line = zip(*out, strict=True) if out else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hh, pa.binary()), pa.array(line, pa.string())], ["hh", "line"])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _line_hash(hh: bytes) -> int:
    """64 bits of a line's hash, the last of them 0."""
    return int.from_bytes(hh[:8], "big", signed=True) & -2


KEY = pa.schema([("key", pa.int64()), ("h", pa.int64())])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, own segments first, those whose key has an own segment and two lines or more.

    A key's rows may go on in the next batch. What is held back for that are its first line's rows, each once, and
    one row of another line, so the memory doesn't grow with a key. Some rows may be given twice.
    """
    k, h = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        k, h = np.concatenate((k, batch.column(0).to_numpy())), np.concatenate((h, batch.column(1).to_numpy()))
        if not len(k):
            continue
        begins = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.append(begins, len(k)))
        line, own = h & -2, (h & 1).astype(bool)
        other = line != np.repeat(line[begins], sizes)
        keep = np.repeat(np.logical_or.reduceat(other, begins) & own[begins], sizes)
        yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(line[keep]), pa.array(own[keep])], ["key", "h", "own"])
        last = begins[-1]
        held = np.concatenate((np.unique(h[last:][~other[last:]])[::-1], h[last:][other[last:]][:1]))
        k, h = np.full(len(held), k[last]), held


def _packed(keys: list[int] | np.ndarray, of: list[int] | np.ndarray, parts: int) -> pa.RecordBatch:
    """part, rows: the keys and their lines' hashes by range of keys, each range as the bytes of its keys and then of the hashes."""
    k, h = np.asarray(keys, np.uint64), np.asarray(of, np.int64)
    order = np.argsort(k)
    k, h = k[order], h[order]
    part = ((k >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
    begins = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(begins[1:], len(k))
    return pa.RecordBatch.from_arrays([pa.array(part[begins], pa.int32()), pa.array([k[a:b].tobytes() + h[a:b].tobytes() for a, b in zip(begins, ends, strict=True)], pa.binary())], schema=PACKED)


def _unpacked(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and hashes of some packed rows."""
    k = np.frombuffer(b"".join(x[: len(x) // 2] for x in rows), np.uint64)
    return k, np.frombuffer(b"".join(x[len(x) // 2 :] for x in rows), np.int64)


PACKED = pa.schema([("part", pa.int32()), ("rows", pa.binary())])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, h: of packed rows sorted by part, those whose key stands twice or more, sorted by key, own segments first."""

    def sorted_part(held: list[bytes]) -> pa.RecordBatch:
        k, h = _unpacked(held)
        order = np.argsort(k)
        k = k[order]
        same = k[1:] == k[:-1]
        twice = np.append(same, False) | np.append(False, same)
        k, h = k[twice], h[order[twice]]
        order = np.lexsort((h, ~h & 1, k))
        return pa.RecordBatch.from_arrays([pa.array(k[order].view(np.int64)), pa.array(h[order])], schema=KEY)

    now, held = None, []
    for batch in batches:
        for part, rows in zip(batch.column(0).to_pylist(), _values(batch.column(1)), strict=True):
            if part != now and held:
                yield sorted_part(held)
                held = []
            now = part
            held.append(rows)
    if held:
        yield sorted_part(held)


def shared_keys(texts: DataFrame, least: int, edits: int) -> DataFrame:
    """Rows (key, h, own) of the segment keys at which a line's own segment meets another line; h is a line's _line_hash().

    What is moved is key and h alone, 16 bytes, packed by range of keys: own is the last bit of h on the way, which a
    hash leaves free. All keys are dealt by range once, and a task sorts one range of 1,024 or more at a time. A key of
    which a sample of lines (one in 64) holds a thousandth or more is not dealt: there are a thousand such keys at
    most, and their rows are all kept.
    """
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1024, n)

    def packed(made: list[int], of: list[int]) -> Iterator[pa.RecordBatch]:
        yield _packed(made, of, parts)
        chosen = (np.array(of, np.int64) >> 8) & 63 == 0  # the sample, as part -1
        if chosen.any():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.array(made, np.uint64)[chosen].tobytes()], pa.binary())], schema=PACKED)

    def keys(batches):
        seen: set[bytes] = set()
        made: list[int] = []
        of: list[int] = []
        for batch in batches:
            if len(seen) > 100_000:
                seen.clear()
            for text in _values(batch.column(0)):
                for _, line in lines_of(text, least):
                    hh = xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))
                    if hh in seen:
                        continue
                    seen.add(hh)
                    h = _line_hash(hh)
                    own, probes = segment_keys(line, edits)
                    made += own
                    made += probes
                    of += [h | 1] * len(own)
                    of += [h] * len(probes)
                if len(made) > 200_000:
                    yield from packed(made, of)
                    made, of = [], []
        if made:
            yield from packed(made, of)

    def sampled(batches):
        for batch in batches:
            for rows in _values(batch.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rows, np.int64))], ["key"])

    rows = staged(texts.mapInArrow(keys, "part int, rows binary"), "keys")
    dealt = rows.filter("part >= 0")
    counts = staged(rows.filter("part < 0").mapInArrow(sampled, "key long").groupBy("key").agg(F.count("*").alias("n")), "counts")
    floor = max(1000, (counts.agg(F.sum("n")).first()[0] or 0) // 1000)
    heavy = np.array([r["key"] for r in counts.filter(F.col("n") >= floor).collect()], np.int64).view(np.uint64)

    def usual(batches):
        for batch in batches:
            for held in _values(batch.column(1)):
                k, h = _unpacked([held])
                keep = ~np.isin(k, heavy)
                if keep.any():
                    yield _packed(k[keep], h[keep], parts)

    def kept_whole(batches):
        for batch in batches:
            for held in _values(batch.column(1)):
                k, h = _unpacked([held])
                keep = np.isin(k, heavy)
                if keep.any():
                    k, h = k[keep].view(np.int64), h[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(h & -2), pa.array((h & 1).astype(bool))], ["key", "h", "own"])

    met = (dealt.mapInArrow(usual, "part int, rows binary") if len(heavy) else dealt).repartition(n, "part").sortWithinPartitions("part")
    found = met.mapInArrow(lambda batches: _meeting(_in_order(batches)), "key long, h long, own boolean")
    if len(heavy):
        found = found.unionByName(dealt.mapInArrow(kept_whole, "key long, h long, own boolean"))
    out = staged(found, "shared")
    discard(rows, counts)
    return out


def _refined(lines: DataFrame, rows: DataFrame, edits: int) -> DataFrame:
    """Narrower keys for rows (ord, own, short, spec): spec null stands for a line in all its parts."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            cols = [batch.column(c).to_pylist() for c in ("ord", "line", "own", "short", "spec")]
            for number, line, own, short, spec in zip(*cols, strict=True):
                n = len(line)
                todo = [(own, short, tuple(spec))] if spec else [(True, n, (0, n, edits, 0))] + [(False, s, (0, s, edits, n - s)) for s in range(max(1, n - edits), n + 1)]
                for mine, size, old in todo:
                    made = [(mine, new) for new in split_spec(old, 4 if spec else 9, mine) if mine or any(new[3::4])]  # a probe without any shift is an own key
                    if mine and spec:  # a letter more in one piece and one less in another
                        made += [(False, new) for new in split_spec(old, 4, False) if any(new[3::4])]
                    out += [(spec_key(line, size, new), number, is_own, size, list(new), *free_ends(line, new)) for is_own, new in made]
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), KEYED, strict=True)], schema=KEYED)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), KEYED, strict=True)], schema=KEYED)

    n = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)  # a line makes hundreds of keys, so few lines are spread too
    found = rows.join(lines, "ord").select("ord", "line", "own", "short", "spec").repartition(n).mapInArrow(run, KEYED_SQL)
    return staged(found.distinct(), "refined")


KEYED = pa.schema([("key", pa.int64()), ("ord", pa.int64()), ("own", pa.bool_()), ("short", pa.int32()), ("spec", pa.list_(pa.int32())), ("u", pa.int64()), ("v", pa.int64())])
KEYED_SQL = "key long, ord long, own boolean, short int, spec array<int>, u long, v long"


def later_lines(rows: DataFrame, lines: DataFrame, edits: int, hot: int) -> DataFrame:
    """The numbers (ord) of the lines within `edits` edits of one with a smaller number.

    rows (key, ord, own) has the lines that share a key, lines (ord, line) their contents. Only whether there is such
    a line is asked, so pairs aren't made: every line at a key is set against the key's first line, and against the
    first that has the key as its own. Lines that this decides ask no more. What is left is compared with all earlier
    lines at the key if the key has `hot` lines or so many undecided ones at most, so a row meets `hot` others. Fuller
    keys are narrowed: their lines are cut in nine parts, of which those with the edits are free and all others have
    to be equal, and the free parts in four as often as needed. When free stretches have one character each, a key's
    lines are as many as the alphabet allows, whatever the number of documents, and are all compared.
    """

    @F.arrow_udf("boolean")
    def within(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([edit_distance(a, b, edits) <= edits for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.bool_())

    # What is left here is a small part of all lines: an eighth of the usual partitions, so that small tables are few files.
    parts = max(1, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)

    def kept(df: DataFrame, tag: str) -> DataFrame:
        return staged(df.coalesce(parts), tag)

    def decide(pairs: DataFrame) -> None:
        first = lines.select(F.col("ord").alias("cand"), F.col("line").alias("first"))
        told.append(kept(pairs.distinct().join(lines, "ord").join(first, "cand").filter(within("line", "first")).select("ord"), "decided"))

    def decided() -> DataFrame:
        return functools.reduce(DataFrame.unionByName, told)

    told: list[DataFrame] = []
    rows = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("short", "int"), ("spec", "array<int>"), ("u", "long"), ("v", "long"))])
    rows = kept(rows.distinct(), "level")
    while True:
        # Each of several free stretches has an edit: a key whose lines all agree in one has nothing that a narrower key lacks.
        differ = (F.coalesce(F.max(F.size("spec")), F.lit(0)) <= 4) | ((F.min("u") != F.max("u")) & (F.min("v") != F.max("v")))
        firsts = rows.groupBy("key").agg(F.min(F.when(F.col("own"), F.col("ord"))).alias("i0"), F.min("ord").alias("r0"), F.count("*").alias("c"), differ.alias("differ"))
        at = kept(rows.join(firsts.filter("i0 is not null and c > 1 and differ").drop("differ"), "key"), "at")
        star = at.filter("i0 < ord").select("ord", F.col("i0").alias("cand")).unionByName(at.filter("own and r0 < i0 and r0 < ord").select("ord", F.col("r0").alias("cand")))
        decide(star)
        # Rows that an earlier line but those two may decide.
        more = at.filter("c > 2 and ord > if(own, r0, i0)").join(decided(), "ord", "left_anti")
        leaf = F.when(F.col("spec").isNull(), False).otherwise(F.forall(F.sequence(F.lit(0), (F.size("spec") / 4 - 1).cast("int")), lambda i: F.get("spec", i * 4 + 1) - F.get("spec", i * 4) <= 1))
        sizes = kept(more.groupBy("key").agg((F.min(leaf) | (F.least(F.count("*"), F.first("c")) <= hot)).alias("direct")), "sizes")
        asking = more.join(sizes.filter("direct"), "key", "left_semi").select("key", "ord", "own", "i0", "r0")
        earlier = rows.select(F.col("key").alias("same"), F.col("ord").alias("cand"), F.col("own").alias("other"))
        direct = asking.join(earlier, (F.col("key") == F.col("same")) & (F.col("cand") < F.col("ord")) & (F.col("own") | F.col("other")) & (F.col("cand") != F.col("i0")) & ~(F.col("own") & (F.col("cand") == F.col("r0"))))
        decide(direct.select("ord", "cand"))
        full = sizes.filter("not direct")
        more_levels = not full.isEmpty()
        if more_levels:
            full = rows.join(full, "key", "left_semi")
            whole = full.filter("spec is null").select("ord", F.lit(True).alias("own"), "short", "spec").distinct()
            wider, lines = lines, kept(lines.join(full.select("ord").distinct(), "ord", "left_semi"), "contents")  # later rounds move these only
            narrowed = _refined(lines, full.filter("spec is not null").select("ord", "own", "short", "spec").unionByName(whole), edits)
        discard(rows, at, sizes)
        if not more_levels:
            out = kept(decided().distinct(), "near")
            discard(*told)
            return out
        if hasattr(wider, "_scratch"):
            discard(wider)
        rows = narrowed


def near_lines(rows: DataFrame, firsts: DataFrame, *, least: int, edits: int, hot: int = 32, broadcast_rows: int = 500_000) -> DataFrame:
    """The 128-bit hashes (hh) of the lines within `edits` edits of an earlier, different one, staged.

    rows has _row and _text; firsts has hh and first, the place (row r, line l) of a line that comes before all others
    like it, which gives the order. Only the first of equal lines is read again, at its place. Up to broadcast_rows
    wanted hashes (of 8 bytes) and rows with wanted places are looked up by a broadcast.
    """
    shared = shared_keys(rows.select("_text"), least, edits)
    wanted = staged(shared.select("h").distinct(), "wanted")
    few = wanted.count() <= broadcast_rows
    known = firsts.withColumn("h", F.conv(F.hex(F.substring("hh", 1, 8)), 16, -10).cast("long").bitwiseAND(F.lit(-2)))  # _line_hash()
    order = ranked(known.join(F.broadcast(wanted) if few else wanted, "h", "left_semi").select("h", "hh", "first"), [F.col("first")], "ord")
    places = order.groupBy(F.col("first.r").alias("_row")).agg(F.collect_list(F.struct(F.col("first.l").alias("l"), "hh")).alias("places"))
    found = rows.select("_row", "_text").join(F.broadcast(places) if few else places, "_row").select("places", "_text").mapInArrow(_contents, "hh binary, line string")
    lines = staged(found.join(order.select("h", "hh", "ord"), "hh"), "lines")
    keyed = shared.join(lines.select("h", "ord"), "h").select("key", "ord", "own")
    later = later_lines(keyed, lines.select("ord", "line"), edits, hot)
    out = staged(lines.join(later, "ord", "left_semi").select("hh"), "later")
    discard(shared, wanted, order, lines, later)
    return out


def line_decisions(rows: DataFrame, *, least: int = 32, edits: int = 2, hot: int = 32) -> DataFrame:
    """Which lines go: rows has _row (unique), _id, _text; returns _row, _id, n_lines, removed (ascending line numbers).

    A line goes if an equal one comes earlier: in a document with a smaller id (null last), then row, then line number.
    A line of `least` characters or more also goes if one within `edits` edits of it (characters) comes earlier; in
    shorter lines two edits change what is said ("Chapter 12", "Chapter 13"), so these have to be equal. White space
    around a line doesn't count, and blank lines stay.
    """

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for row, key, text in zip(*map(_values, batch.columns), strict=True):
                out.append((row, key, -1, 0 if text is None or text == "" else text.count("\n") + 1, None))
                out += [(row, key, i, 0, xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))) for i, line in lines_of(text, 1)]
            cols = list(zip(*out, strict=True)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(1).type), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary())],
                ["_row", "_id", "line", "n_lines", "hh"],
            )

    kind = rows.schema["_id"].dataType.simpleString()
    lines = staged(rows.select("_row", "_id", "_text").mapInArrow(run, f"_row long, _id {kind}, line int, n_lines long, hh binary"), "lines")
    place = F.struct(F.col("_id").isNull().alias("z"), F.col("_id").alias("i"), F.col("_row").alias("r"), F.col("line").alias("l"))
    firsts = staged(lines.filter("hh is not null").groupBy("hh").agg(F.min(place).alias("first"), F.count("*").alias("times")), "firsts")
    later = near_lines(rows.select("_row", "_text"), firsts, least=least, edits=edits, hot=hot)
    judged = firsts.join(later.withColumn("gone", F.lit(True)), "hh", "left").filter("gone or times > 1")
    judged = staged(judged.select("hh", "gone", F.col("first.r").alias("r"), F.col("first.l").alias("l")), "judged")
    discard(later, firsts)
    # Only lines that are equal to another or go are looked at again: most are neither.
    goes = lines.filter("hh is not null").select("_row", "line", "hh").join(judged, "hh").filter("gone or _row != r or line != l")
    goes = goes.groupBy("_row").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    texts = lines.filter("hh is null").select("_row", "_id", "n_lines")
    return texts.join(goes, "_row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 32, edits: int = 2) -> DataFrame:
    """docs with every line removed that an earlier equal or nearly equal line makes needless.

    See line_decisions() for what goes. A document all of whose lines go has no text left and goes too; one that
    lost none is unchanged, null and empty texts included. Keeps the columns of docs, whatever their names; of
    repeated rows the first stays; an empty table gives no row.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    gone = line_decisions(rows, least=least, edits=edits).filter(F.size("removed") > 0).select("_row", "n_lines", "removed")

    @F.arrow_udf("string")
    def without(text: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, gone in zip(text.to_pylist(), removed.to_pylist(), strict=True):
            drop = set(gone or ())
            out.append("\n".join(line for i, line in enumerate(t.split("\n")) if i not in drop) if drop else t)
        return pa.array(out, pa.string())

    joined = rows.join(gone, "_row", "left").filter(F.col("removed").isNull() | (F.size("removed") < F.col("n_lines")))
    kept = joined.select("_doc", F.when(F.col("removed").isNull(), F.col("_text")).otherwise(without("_text", "removed")).alias("_new"))
    return kept.select(*[F.col("_new").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])
