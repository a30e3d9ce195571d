"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.store import discard, ranked, staged


def word_count(text: Column) -> Column:
    """The number of words, runs of characters other than [\\x20\\x09-\\x0D]; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """Targets of the sources: sizes has _null, _src (the source, null told apart) and source_size, one row for each.

    Sources in code point order, null last, weigh weights in turn and share the sum of all sizes by weight. A target
    above cap times its source's size stops there and the excess is shared anew by weight among the others. The level
    (words for each unit of weight) is found by fixed-point rounds; each sends two sums to the driver.
    """
    order = ranked(sizes, [F.col("_null"), F.col("_src")], "_rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    t = staged(order.select("_null", "_src", "source_size", w.alias("_w"), (cap * F.col("source_size")).alias("_cap")), "sources")
    total = t.agg(F.sum("source_size")).first()[0] or 0
    level, open_w, held = 0.0, None, 0.0
    while True:
        full = F.col("_cap") <= level * F.col("_w")
        row = t.agg(F.sum(F.when(~full, F.col("_w"))).alias("w"), F.sum(F.when(full, F.col("_cap")).otherwise(0)).alias("c")).first()
        if row["w"] is None or (open_w == row["w"] and held == row["c"]):
            break
        open_w, held = row["w"], row["c"]
        level = max(level, (total - held) / open_w)
    return t.select("_null", "_src", "source_size", F.least(F.col("_cap"), level * F.col("_w")).alias("target"))


def inclusion(rows: DataFrame) -> DataFrame:
    """_c and _top of each source: documents longer than _top are certain, others have the chance _c * size, below 1.

    rows has _null, _src, _size and _rest, the words to expect. Sizes are counted first, so what is put in order are
    the distinct sizes of a source. _top is the largest size s for which the chance (rest - words of longer documents)
    / (sum of squares of sizes up to s) * s stays below 1; without one all documents that are short enough are certain.
    """
    key = ["_null", "_src"]
    sizes = rows.filter("_size > 0 and _size <= _rest").groupBy(*key, "_size").agg(F.count("*").cast("double").alias("_n"), F.first("_rest").alias("_rest"))
    longer = Window.partitionBy(*key).orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    shorter = Window.partitionBy(*key).orderBy("_size").rowsBetween(Window.unboundedPreceding, 0)
    size = F.col("_size").cast("double")
    c = (F.col("_rest") - F.coalesce(F.sum(size * F.col("_n")).over(longer), F.lit(0.0))) / F.sum(size * size * F.col("_n")).over(shorter)
    return sizes.withColumn("_c", c).filter((F.col("_c") >= 0) & (F.col("_c") * size < 1)).groupBy(*key).agg(F.max_by("_c", "_size").alias("_c"), F.max("_size").alias("_top"))


def filled(order: DataFrame, plan: DataFrame, near: float, rounds: int) -> DataFrame:
    """The stretches of each source's order that fill its rest: _null, _src, _steps, an array of (r, begin, end), `rounds` at most.

    A document is taken if its place is in one of the stretches (begin included, null for the first; end excluded, null
    for the last) and its size is r, what was missing at the stretch's begin, or less. order has _null, _src, _size,
    _bin and _pos, plan has _null, _src, _rest and target.
    """
    key, pos = ["_null", "_src"], order.schema["_pos"].dataType.simpleString()
    none = F.lit(None).cast(pos)
    state = staged(plan.select(*key, "target", F.col("_rest").cast("double").alias("_r"), none.alias("_at"), F.lit(None).cast(f"array<struct<r:double,begin:{pos},end:{pos}>>").alias("_steps")), "state")
    run = Window.partitionBy(*key).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    for k in range(rounds + 1):
        asking = state.filter(F.col("_r") > near * F.col("target")).filter("_steps is null or _at is not null").select(*key, "_r", "_at")
        left = order.join(asking, key).filter("_size <= _r and (_at is null or _pos > _at)")
        bins = staged(left.groupBy(*key, "_bin", "_r").agg(F.sum("_size").alias("_words")).withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0))), "bins")
        if k == rounds or bins.isEmpty():
            break
        cut = bins.filter("_before <= _r and _before + _words > _r").select(*key, F.col("_bin").alias("_cut"), "_before")
        at_cut = left.join(cut, key).filter("_bin = _cut").withColumn("_sum", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
        over = at_cut.filter("_sum + _size > _r").groupBy(*key).agg(F.min(F.struct("_pos", "_sum")).alias("_end"))
        step = bins.groupBy(*key).agg(F.sum("_words").alias("_total")).join(over, key, "left")
        new = F.struct(F.col("_r").alias("r"), F.col("_at").alias("begin"), F.col("_end._pos").alias("end"))
        steps = F.when(F.col("_total").isNull(), F.col("_steps")).when(F.col("_steps").isNull(), F.array(new)).otherwise(F.array_append("_steps", new))
        rest = F.when(F.col("_total").isNull(), F.lit(0.0)).otherwise(F.col("_r") - F.coalesce("_end._sum", "_total"))
        old = state
        state = staged(state.join(step, key, "left").select(*key, "target", rest.alias("_r"), F.col("_end._pos").alias("_at"), steps.alias("_steps")), "state")
        discard(old, bins)
    return state.filter("_steps is not null").select(*key, "_steps")


def closing(rows: DataFrame, extra: DataFrame, plan: DataFrame, near: float) -> DataFrame:
    """_row of one document a source that brings its words nearer to the target than they are without it.

    rows has _null, _src, _size, _id and _row, extra the _row and _size that are taken already, plan _rest and target.
    Where more than near of the target is missing, the document whose size is nearest to what is missing is taken if
    that overshoots by less than is missing now; ties go to the random number of the id.
    """
    key = ["_null", "_src"]
    words = extra.groupBy(*key).agg(F.sum("_size").alias("_words"))
    open_ = plan.join(words, key, "left").withColumn("_r", F.col("_rest") - F.coalesce("_words", F.lit(0))).filter(F.col("_r") > near * F.col("target")).select(*key, "_r")
    can = rows.join(open_, key).filter("_size > 0 and _size < 2 * _r").join(extra.select("_row"), "_row", "left_anti")
    return can.groupBy(*key).agg(F.min_by("_row", F.struct(F.abs(F.col("_size") - F.col("_r")), F.xxhash64("_id"), "_row")).alias("_row")).select("_row")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), **options) -> DataFrame:
    """The mix of mix_rows() without its row numbers."""
    return mix_rows(docs, weights, **options).drop("_row")


def take_mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), *, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that mix_rows() takes a copy of or more, with size, source_size, target and taken added.

    Keeps the columns of docs; what is added replaces a column of the same name.
    """
    used = {text_col, options.get("id_col", "doc_id"), options.get("source_col", "source")}
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *[F.col(f"`{c}`") for c in sorted(used)])
    rows = staged(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    added = ["size", "source_size", "target", "taken"]
    taken = mix_rows(rows, weights, size=word_count(F.col(text_col)), row_col="_row", **options).filter("taken > 0").select("_row", *added)
    return rows.select("_row", "_doc").join(taken, "_row").select(*[F.col("_doc")[c].alias(c) for c in docs.columns if c not in added], *added)


def mix_rows(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    size: Column | None = None,
    cap: float = 3.0,
    seed: int = 2,
    near: float = 0.001,
    rounds: int = 8,
    row_col: str | None = None,
) -> DataFrame:
    """How many words of each document a mix with the given source weights takes.

    Every document of a source gets the whole copies that target / source size holds. The rest of the target is a
    Pareto order sample of the documents that are no longer than it. Inclusion probabilities are in proportion to
    size, lambda = c size, with c such that the sample's expected words are the rest; documents for which that is 1
    or more are taken with certainty, and c is found without them (see inclusion()). The others are ranked by the odds
    u / (1 - u) of a random number (a hash of id and seed) over their odds of inclusion lambda / (1 - lambda), and the
    first n = sum of lambda are the sample. As a sample of n documents seldom has just the words that are asked for,
    the end of the order settles it: if n documents have more than the rest the last ones are given back, and if they
    have fewer the order is followed further. Either way the first document that doesn't fit is passed over, and so
    are later ones that don't fit into what is missing then, until less than `near` of the target is missing, nothing
    fits or `rounds` documents that had fitted at a stretch's begin were passed over. Last, where more than `near` is
    missing, the one document whose size is nearest to what is missing is taken if the source then ends nearer to its
    target, from above if need be: a document longer than the rest can be that one. So a source misses its target by
    `near` of it, or by less than half of the smallest document left, unless the rounds ran out.

    No source is sorted in one task: words are summed in fine bins of the rank's logarithm, the bin where the rest is
    filled is found from these sums, and only the documents of that bin are put in order. Each document passed over
    costs one more round over sizes and ranks, and what is missing shrinks with every round.

    Returns one row per row of docs: _row (its number, or its row_col), id_col, source_col, size,
    source_size, target, taken. Null text or size counts
    0 words and takes 0; a null source is a source of its own, last in order; rows with the same id are separate
    documents with the same random number, ordered by size; an empty table gives no row; other columns are ignored.
    """
    n_words = F.coalesce((word_count(F.col("text")) if size is None else size).cast("long"), F.lit(0))
    source = F.col(source_col).cast("string")
    row = (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("_row")
    rows = staged(docs.select(F.col(id_col).alias("_id"), source.isNull().alias("_null"), F.coalesce(source, F.lit("")).alias("_src"), n_words.alias("_size"), row), "sizes")
    sums = rows.groupBy("_null", "_src").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_docs"))
    key = ["_null", "_src"]
    sources = staged(source_targets(sums, weights, cap).withColumn("_times", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "targets")
    sources = sources.withColumn("_whole", F.floor("_times").cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    chances = staged(inclusion(rows.join(sources.select(*key, "_rest"), key)), "chances")
    sources = staged(sources.join(chances, key, "left"), "plan")
    u = (F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    chance = F.col("_c") * F.col("_size")
    odds = F.log(u) - F.log1p(-u) - F.log(F.greatest(chance, F.lit(1e-300))) + F.log1p(-chance)
    order = rows.join(sources.select(*key, "_rest", "_c", "_top"), key).filter("_size > 0 and _size <= _rest")
    order = order.withColumn("_log", F.when(F.col("_c").isNull() | (F.col("_size") > F.col("_top")), F.lit(-1e6)).otherwise(odds))
    fine = 64.0 * max(1.0, (rows.count() / 5e7))
    order = staged(order.select(*key, "_row", "_size", F.floor(F.col("_log") * fine).cast("long").alias("_bin"), F.struct("_log", "_id", "_size", "_row").alias("_pos")), "order")
    steps = filled(order, sources.select(*key, "_rest", "target"), near, rounds)
    extra = F.exists("_steps", lambda s: (F.col("_size") <= s["r"]) & (s["begin"].isNull() | (F.col("_pos") >= s["begin"])) & (s["end"].isNull() | (F.col("_pos") < s["end"])))
    extra = staged(order.join(steps, key).filter(extra).select(*key, "_row", "_size"), "extra")
    extra = extra.select("_row").unionByName(closing(rows, extra, sources.select(*key, "_rest", "target"), near))
    out = rows.join(sources.select(*key, "source_size", "target", "_whole"), key).join(extra.withColumn("_more", F.lit(1)), "_row", "left").withColumn("_extra", F.coalesce("_more", F.lit(0)))
    return out.select(
        "_row",
        F.col("_id").alias(id_col),
        F.when(~F.col("_null"), F.col("_src")).alias(source_col),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        ((F.col("_whole") + F.col("_extra")) * F.col("_size")).alias("taken"),
    )
