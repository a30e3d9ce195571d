"""How far the sources of a language differ in their words: exact counts, divergences of pairs, telling terms."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.store import discard, staged

#: Delimiters, all of \x00-\x7F but letters, become a space; A-Z are lower-cased; other bytes belong to terms.
PLAIN = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256)).lower()
PIECE = 1 << 20  # bytes of a text in hand at once
ENTRIES = 300_000  # sums that a task holds before it sends them
TERMS = 200_000  # of one automaton
BLOCK = 512  # sources of a block of pairs


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in plain form, padded with delimiters, cut at delimiters to pieces of about PIECE bytes."""
    plain = b" " + text.translate(PLAIN) + b" "
    at = 0
    while at < len(plain) - 1:
        end = plain.find(b" ", min(at + PIECE, len(plain) - 1))
        yield plain[at : end + 1]
        at = end


def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, term, n: in how many of the task's documents each term stands, in several parts if there are many."""
    sums: dict[str, Counter] = {}

    def told():
        for lang, c in sums.items():
            if c:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()).cast(pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "term", "n"])
        sums.clear()

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            seen: set[bytes] = set()
            for piece in pieces(text.as_py().encode()):
                seen.update(piece.split())
            sums.setdefault(lang, Counter()).update(seen)
            if sum(map(len, sums.values())) > ENTRIES:
                yield from told()
    yield from told()


def automata(terms: dict[str, list[tuple[str, int]]]) -> dict:
    """Of each language an automaton over its terms, each between delimiters; a match gives the term's number."""
    out = {}
    for lang, own in terms.items():
        out[lang] = a = ahocorasick.Automaton()
        for term, number in own:
            a.add_word(f" {term} ", number)
        a.make_automaton()
    return out


_BUILT: dict = {}


def recount(kept, name: str):
    """lang, source, number, n: occurrences of the kept terms, a broadcast called `name`, in a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:  # a worker runs many tasks
            _BUILT.clear()
            _BUILT[name] = automata(kept.value)
        found = _BUILT[name]
        sums: dict[tuple[str, str], Counter] = {}

        def told():
            for (lang, source), c in sums.items():
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array([source] * len(c), pa.string()), pa.array(list(c), pa.int64()), pa.array(list(c.values()), pa.int64())], names=["lang", "source", "number", "n"])
            sums.clear()

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text"), strict=True):
                if lang in found:
                    own = sums.setdefault((lang, source), Counter())
                    for piece in pieces(text.as_py().encode()):
                        own.update(map(itemgetter(1), found[lang].iter(piece.decode())))
            if sum(map(len, sums.values())) > ENTRIES:
                yield from told()
        yield from told()

    return run


def occurrences(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, number, n over all rows (lang, source, text). kept: lang, term, number.

    The vocabulary goes to the tasks in parts of about TERMS terms, dealt by hash, each with a pass over the texts: one
    part up to that size, which is counted first.
    """
    spark = rows.sparkSession
    parts = kept.count() // TERMS + 1
    found = None
    for part in range(parts):
        terms: dict[str, list[tuple[str, int]]] = {}
        for r in kept.filter(F.pmod(F.xxhash64("lang", "term"), F.lit(parts)) == part).toLocalIterator():
            terms.setdefault(r["lang"], []).append((r["term"], r["number"]))
        own = rows.mapInArrow(recount(spark.sparkContext.broadcast(terms), uuid.uuid4().hex), "lang string, source string, number long, n long")
        found = own if found is None else found.unionByName(own)
    return found.groupBy("lang", "source", "number").agg(F.sum("n").alias("n"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 kept)), exactly."""
    ten9 = F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.call_function("div", ten9 * (n + 5).cast("decimal(20,0)"), (total + 5 * kept).cast("decimal(20,0)")).cast("long") + 1


def lone_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: sum over a's own terms of |p - p0 of b| - |p0 of a - p0 of b|, for every b of the language.

    A row has the group a, its p0, how many of its terms have which p, and the p0 of all groups of the language.
    """
    for batch in batches:
        for r in batch.to_pylist():
            p, k = np.array(r["p"], np.int64), np.array(r["k"], np.int64)
            order = np.argsort(p)
            p, k = p[order], k[order]
            many, mass = np.concatenate(([0], np.cumsum(k))), np.concatenate(([0], np.cumsum(p * k)))
            b, zero = np.array([x["b"] for x in r["zeros"]], np.int64), np.array([x["p0"] for x in r["zeros"]], np.int64)
            at = np.searchsorted(p, zero)
            far = mass[-1] - 2 * mass[at] + zero * (2 * many[at] - many[-1])
            value = far - many[-1] * np.abs(r["p0"] - zero)
            other = b != r["a"]
            n = int(other.sum())
            yield pa.RecordBatch.from_arrays([pa.array([r["lang"]] * n, pa.string()), pa.array([r["a"]] * n, pa.int64()), pa.array(b[other]), pa.array(value[other])], names=["lang", "a", "b", "value"])


def shared_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value for a < b: what terms of both groups change in the sum that lone_terms() makes.

    Rows (lang, x, y, left, right: postings of a term in two blocks of sources) come sorted by lang, x and y, so a task
    holds the sums of one pair of blocks.
    """
    key, sums = None, None

    def told():
        a, b = np.nonzero(sums)
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array(a + key[1] * BLOCK), pa.array(b + key[2] * BLOCK), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])

    for batch in batches:
        sides = [(c.offsets.to_numpy(), *(c.values.field(k).to_numpy(zero_copy_only=False) for k in ("g", "p", "p0"))) for c in (batch.column("left"), batch.column("right"))]
        for i, now in enumerate(zip(*(batch.column(k).to_pylist() for k in ("lang", "x", "y")), strict=True)):
            if key != now:
                if key:
                    yield told()
                key, sums = now, np.zeros((BLOCK, BLOCK), np.int64)
            (a, p, p0), (b, q, q0) = ([x[at[i] : at[i + 1]] for x in its] for at, *its in sides)
            p, p0 = p[:, None], p0[:, None]
            value = np.abs(p - q) - np.abs(p - q0) - np.abs(p0 - q) + np.abs(p0 - q0)
            sums[np.ix_(a % BLOCK, b % BLOCK)] += np.where(a[:, None] < b, value, 0)
    if key:
        yield told()


def audit_sources(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = 30, top: int = 50) -> DataFrame:
    """How far the sources of each language lie apart, and the terms that set each source off from its language.

    Terms are runs of bytes other than ASCII non-letters, A-Z lower-cased. A first pass counts exactly in how many
    documents of a language each term stands, and keeps those of `least` or more; a second one counts occurrences of
    kept terms by automata over terms between delimiters. A group (language and source) or a whole language gives a
    kept term p = 1 + floor(10^9 (n + 5) / (N + 5 V)): n its occurrences there, N those of all V kept terms.

    Returns lang, source, part, item, value, rank. Part `pair`: item is another source of the language, value the sum
    of |p - q| over all kept terms (0 without any). Part `term`: item is a term of the group with p above the q of the
    language, value p - q, the `top` first. Ranks are by value downwards, then item in UTF-8 order.

    Sums of pairs come from postings alone: terms that both lack count at once, terms of one group by how many have
    which p (lone_terms), terms of both for each pair of groups that has them (shared_terms), by blocks of sources, so
    no row for each term and pair of sources exists. Tasks hold bounded sums and send them on when full.

    Nulls are ''; empty texts and texts without terms still make a group; long texts are read piece by piece, whole;
    repeated rows count each; an empty table gives no row; other columns are ignored.
    """
    blank = F.lit("")
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), blank).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    found = rows.select("lang", "text").mapInArrow(document_counts, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))
    kept = staged(found.filter(F.col("n") >= least).select("lang", "term", F.monotonically_increasing_id().alias("number")), "kept")
    counts = staged(occurrences(rows, kept), "counts")

    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = rows.groupBy("lang", "source").agg(F.lit(1).alias("one")).join(sums, ["lang", "source"], "left").join(size, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"))
    zero = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.when(F.col("kept") > 0, F.col("kept")))).otherwise(F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = staged(groups.select("lang", "source", "total", "kept", zero.alias("p0"), number.cast("long").alias("g")), "groups")
    whole = counts.groupBy("lang", "number").agg(F.sum("n").alias("all"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("whole"))
    postings = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    q = share(F.col("all"), F.col("whole"), F.col("kept"))
    above = postings.join(whole, ["lang", "number"]).join(totals, "lang").withColumn("value", F.col("p") - q).filter("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    named = above.join(kept, ["lang", "number"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    terms = named.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    zeros = groups.groupBy("lang").agg(F.collect_list(F.struct(F.col("g").alias("b"), "p0")).alias("zeros"))
    levels = postings.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("k")).groupBy("lang", "g", "p0").agg(F.collect_list("p").alias("p"), F.collect_list("k").alias("k"))
    lone = levels.join(zeros, "lang").select("lang", F.col("g").alias("a"), "p0", "p", "k", "zeros").mapInArrow(lone_terms, "lang string, a long, b long, value long")
    block = F.floor(F.col("g") / BLOCK).cast("long")
    listed = postings.withColumn("x", block).groupBy("lang", "number", "x").agg(F.collect_list(F.struct("g", "p", "p0")).alias("left"))
    other = listed.select("lang", "number", F.col("x").alias("y"), F.col("left").alias("right"))
    both = listed.join(other, ["lang", "number"]).filter("x <= y").select("lang", "x", "y", "left", "right").sortWithinPartitions("lang", "x", "y")
    shared = both.mapInArrow(shared_terms, "lang string, a long, b long, value long")
    side = lambda a, b: groups.select("lang", F.col("g").alias(a), F.col("source").alias(b), F.col("p0").alias(f"zero_{a}"), "kept")
    start = side("a", "source").join(side("b", "item").drop("kept"), "lang").filter("a < b")
    parts = lone.unionByName(shared).groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("value").alias("sum"))
    value = F.col("kept") * F.abs(F.col("zero_a") - F.col("zero_b")) + F.coalesce("sum", F.lit(0))
    pairs = start.join(parts, ["lang", "a", "b"], "left").select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("two"), value.alias("value"))
    pairs = pairs.select("lang", "two.source", F.lit("pair").alias("part"), "two.item", "value").withColumn("rank", F.row_number().over(order))
    out = staged(terms.unionByName(pairs), "audit")
    discard(kept, counts, groups)
    return out
