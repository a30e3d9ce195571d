"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import pytest

from basketry.llm import chat, decontam, exact, jaccard, lines, mixing, ngram, pii, suffixes, toxicity

LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 1, "x", 1, "r", 5),
    (1, "one two three four five six seven eight nine ten", "en", "a", 1, "x", 1, "r", 5),
    (2, "", "en", None, 1, "x", 1, "r", 5),
    (3, None, None, "b", None, None, None, None, None),
    (None, "one two three four five six seven eight nine ten", None, "b", 1, "x", 1, "r", 5),
    (5, LONG, "en", "a", 1, "x", 1, "r", 5),
    (6, LONG, "en", "c", 1, "x", 1, "r", 5),
    (7, " \t\n", "en", "c", 1, "x", 1, "r", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _row long, row string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *cols):
    return sorted(((r["doc_id"], *(r[c] for c in cols)) for r in df.collect()), key=repr)


def test_exact(docs, empty):
    got = by_id(exact.exact_dedup(docs), "keep_id", "group_size", "kept")
    assert [g for g in got if g[0] in (1, None)] == [(1, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False)]
    assert (5, 5, 2, True) in got and (6, 5, 2, False) in got
    assert sorted(g[1:] for g in got if g[0] in (2, 3, 7)) == [(7, 3, False), (7, 3, False), (7, 3, True)]
    assert exact.exact_dedup(empty).count() == 0


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(ROWS)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert {r["taken"] for r in rows if r["size"] == 0} == {0}
    assert mixing.mix_sources(empty).count() == 0
    took = mixing.take_mix(docs)
    assert took.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"]


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = toxicity.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 7)}) == 1
    assert toxicity.score_documents(empty, labels).count() == 0
    assert toxicity.score_documents(docs, labels.limit(0)).count() == len(ROWS)


def test_lines(docs, empty):
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=repr)
    assert ids == [1, 2, 3, 5, 7]
    assert lines.dedup_lines(empty).count() == 0


def test_suffixes(docs, empty):
    got = by_id(suffixes.remove_repeats(docs), "n_bytes", "n_removed", "n_spans")
    n = len(LONG)
    assert (6, n, n, 1) in got and (2, 0, 0, 0) in got and (3, 0, 0, 0) in got
    assert (5, n, n - 27, 1) in got  # the first period of 27 bytes stays
    assert suffixes.remove_repeats(empty).count() == 0


def test_pii(docs, empty):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == len(ROWS) and {r["spans"] for r in rows} == {""}
    assert pii.find_pii(empty).count() == 0


def test_decontam(spark, docs, empty):
    items = spark.createDataFrame([(1, "three four five six seven"), (2, None), (None, "one two three four"), (4, "")], "item_id long, text string")
    for size in (1 << 20, 0):
        got = by_id(decontam.contaminated(docs, items, broadcast_bytes=size), "item_id")
        assert got == [(1, 1), (1, 1), (None, 1)]
        assert decontam.clean(docs, items, broadcast_bytes=size).count() == len(ROWS) - 3
        assert decontam.contaminated(empty, items, broadcast_bytes=size).count() == 0
        assert decontam.contaminated(docs, items.limit(0), broadcast_bytes=size).count() == 0


def test_jaccard(docs, empty):
    got = by_id(jaccard.jaccard_components(docs), "n_shingles", "component_id")
    assert got == sorted([(1, 6, 1), (1, 6, 1), (2, 0, 2), (3, 0, 3), (None, 6, 1), (5, 5, 5), (6, 5, 5), (7, 0, 7)], key=repr)
    kept = jaccard.dedup_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 5, 7]
    assert jaccard.jaccard_components(empty).count() == 0


def test_ngram(docs, empty):
    rows = ngram.score_texts(docs, toxicity.held_out("doc_id", 10)).collect()
    assert len(rows) == len(ROWS)
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3, 7)} == {1}
    assert ngram.score_texts(empty, toxicity.held_out("doc_id", 10)).count() == 0


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, c string, t long, row long"
    rows = [(None, None, None, None, "x", 1, 1), (1, None, "user", "> a", "x", 1, 1), (1, 0, "user", "a", "x", 1, 1), (1, 0, "user", "a", "x", 1, 1), (1, 1, None, "> a\nb", "x", 1, 1)]
    got = chat.link_quotes(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert [r["reply_to"] for r in got if r["turn"] == 1] == [0]
    assert chat.link_quotes(spark.createDataFrame([], schema)).count() == 0
