"""Spelling variants of words: near words at one edit, the form that each is a variant of, and its root."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import discard, staged

RUN = re.compile("[a-zÀ-ÿ]+")
LONG = 1 << 20  # characters; the words of longer texts are not listed at once
ENTRIES = 300_000  # sums that a task holds before it sends them
HOT = 256  # words of a segment that are compared with one another


def counted_words(least_length: int, every: int):
    """word, n: the words of a task's documents (key, text).

    Runs of letters, A-Z lower-cased. Where `every` divides h, the crc32 of `<key>:<run>`, the run's character
    h % length is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}

        def told():
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["word", "n"])
            sums.clear()

        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                plain = text.as_py().encode().lower().decode()
                own = Counter(RUN.findall(plain)) if len(plain) < LONG else Counter(m.group() for m in RUN.finditer(plain))
                start = zlib.crc32(f"{key}:".encode())
                for word, n in own.items():
                    if len(word) >= least_length:
                        h = zlib.crc32(word.encode(), start)
                        if h % every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least_length:
                                continue
                        sums[word] = sums.get(word, 0) + n
                if len(sums) > ENTRIES:
                    yield from told()
        yield from told()

    return run


def segments(least_length: int) -> Column:
    """The keys of a word: array of (key, seg, probe, rest), rest being what the key leaves out.

    A word of length l has two segments, its first l // 2 characters and the rest. It is indexed under both, and it
    probes for words one shorter with the places of their segments: the first at the start, the second moved by one.
    """
    w, size = F.col("word"), F.col("size")
    half, short = F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")

    def key(length: Column, seg: int, part: Column, probe: bool, rest: Column) -> Column:
        return F.struct(F.xxhash64(length, F.lit(seg), part).alias("key"), F.lit(seg).alias("seg"), F.lit(probe).alias("probe"), rest.alias("rest"))

    own = [key(size, 1, F.substr(w, F.lit(1), half), False, F.substr(w, half + 1)), key(size, 2, F.substr(w, half + 1), False, F.substr(w, F.lit(1), half))]
    probes = [key(size - 1, 1, F.substr(w, F.lit(1), short), True, F.substr(w, short + 1)), key(size - 1, 2, F.substr(w, short + 2), True, F.substr(w, F.lit(1), short + 1))]
    return F.concat(F.array(*own), F.when(size > least_length, F.array(*probes)).otherwise(F.array().cast("array<struct<key:bigint,seg:int,probe:boolean,rest:string>>")))


def near_words(words: DataFrame, least_length: int = 5, hot: int = HOT) -> DataFrame:
    """a, a_n, b, b_n: pairs of words (word, n, size) that differ by one inserted, deleted or replaced character, once each.

    Even-partition pigeonhole join: one edit leaves one of two segments as it is, at its place or moved by one, so near
    words meet under a key of segments(). A pair that meets under both counts under the first; the rest is verified by
    edit distance. A key of more than `hot` rows is narrowed by what its rows have besides the segment: the remainder
    with each character left out in turn (for words of its length), or the whole remainder against those of words one
    longer with each character left out. All rows that meet there are near, so no group is compared in all pairs.
    """
    keys = staged(words.select("word", "n", F.explode(segments(least_length)).alias("k")).select("word", "n", "k.*"), "keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(~F.col("probe")).alias("own"))
    heavy = staged(sizes.filter((F.col("rows") > hot) & (F.col("own") > 0)).select("key"), "heavy")
    light, full = keys.join(heavy, "key", "left_anti"), keys.join(heavy, "key", "left_semi")

    def met(rows: DataFrame, on: str) -> DataFrame:
        """Own rows with those of the same key: own ones of later words, and probes not found by the first segment."""
        left = rows.filter("not probe").select(on, F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("seg").alias("s"))
        right = rows.select(on, F.col("word").alias("b"), F.col("n").alias("b_n"), "probe")
        start = F.floor(F.length("a") / 2).cast("int")
        again = (F.col("s") == 2) & (F.substr("a", F.lit(1), start) == F.substr("b", F.lit(1), start))
        fits = F.when(F.col("probe"), ~again & (F.length("b") == F.length("a") + 1)).otherwise((F.col("a") < F.col("b")) & (F.length("a") == F.length("b")))
        return left.join(right, on).filter(fits & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n")

    without = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.substr("rest", F.lit(1), i - 1), F.substr("rest", i + 1)))
    without = F.when(F.col("rest") == "", F.array().cast("array<string>")).otherwise(without)
    narrow = F.when(F.col("probe"), F.transform(F.array_distinct(without), lambda x: F.xxhash64("key", F.lit(0), x))).otherwise(
        F.concat(F.array(F.xxhash64("key", F.lit(0), "rest")), F.transform(without, lambda x, i: F.xxhash64("key", i + 1, x)))
    )
    finer = full.select("word", "n", "seg", "probe", F.explode(narrow).alias("finer"))
    out = staged(met(light, "key").unionByName(met(finer, "finer")).distinct(), "near")
    discard(keys, heavy)
    return out


def group_spellings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least: int = 3, ratio: int = 2, every: int = 97) -> DataFrame:
    """The words of all texts with the frequent near word that each is taken for a variant of.

    Words are runs of [A-Za-z] and U+00C0 to U+00FF, only A-Z lower-cased, of least_length characters or more that
    stand `least` times or more in all; where `every` divides the crc32 of `<id>:<run>` the run loses one character
    (see counted_words). Near words differ by exactly one edit. A word's form is its near word of largest n, ties to the
    smallest in code-point order, if that n is ratio times its own or more; root is reached by following forms.

    Returns word, form (null without one), root, n, n_near, form_n. n grows along forms, so they end, after at most
    log2 of the largest n; roots are found by doubling the steps, a few joins in all.

    Null texts have no words, a null id counts as an empty one, empty texts give nothing, long texts are read whole;
    repeated rows count each; an empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    counts = rows.mapInArrow(counted_words(least_length, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = staged(counts.filter(F.col("n") >= least).withColumn("size", F.length("word")), "words")
    pairs = near_words(words, least_length)
    ways = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    best = pairs.select(ways.alias("w")).select("w.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), "near")).alias("best"))
    is_form = -F.col("best.down") >= ratio * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.down")).alias("form_n"))
    forms = staged(forms, "forms")
    steps = staged(forms.filter("form is not null").select("word", F.col("form").alias("root")), "steps")
    while True:
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        old, steps = steps, staged(steps.select("word", "root").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "steps")
        discard(old)
        if not steps.filter("moved").head(1):
            break
    out = staged(forms.join(steps.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "spellings")
    discard(words, pairs, forms, steps)
    return out
