"""The pipeline's stages, each on its own input."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa

import corpus_pipeline
from basketry.llm import decontam, mixing, toxicity
from basketry.llm.jaccard import sets_of

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        given, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if k < 4:
            assert docs.columns == columns
        if name == "toxicity":
            model = toxicity.train(given, spark.read.parquet(f"{SMALL}/labels.parquet"))
            score = dict(zip(before, model.scores([t.encode() for t in before.values()]), strict=True))
            assert set(after) == {d for d, s in score.items() if s < 0.5} and after.items() <= before.items()
        if name == "line dedup":
            lines = [x.strip() for t in after.values() for x in t.split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
            assert {x.strip() for t in before.values() for x in t.split("\n") if 0 < len(x.strip()) < 32} == {x for x in lines if len(x) < 32}
        if name == "n-gram Jaccard join":
            sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, t in before.items() if (w := t.lower().split())}
            for d in set(before) - set(after):
                assert any(o != d and 5 * len(sets[d] & sets[o]) >= 4 * len(sets[d] | sets[o]) for o in sets)
            assert not any(a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) for a in after if a in sets for b in after if b in sets)
        if name == "benchmark decontamination":
            bad = {r["doc_id"] for r in decontam.contaminated(given, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
            assert set(before) - set(after) == bad
        if name == "mixing sources":
            want = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(given).collect()}
            assert {r["doc_id"]: r["taken"] for r in docs.collect()} == {d: n for d, n in want.items() if n > 0}
            assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in docs.collect())


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_edge_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing names, and empty tables go through every stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, _row long"
    clean = "the quick brown fox jumps over the lazy dog near the old river bank"
    rows = [(1, clean, "en", "a", 1, "x", 1), (1, clean, "en", "a", 1, "x", 1), (2, "", "en", None, 0, "x", 1), (3, None, None, "b", None, None, None), (None, "some other words that stand alone here", None, "b", 1, "x", 1), (5, "lorem ipsum dolor " * 5000, "en", "c", 1, "x", 1)]
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(1, 0, 0), (2, 1, 1), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark that nobody here has quoted at all"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {"line dedup": {2, 3, None, 1, 5}, "n-gram Jaccard join": {2, 3, None, 1, 5}, "benchmark decontamination": {2, 3, None, 1, 5}}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        ids = [r["doc_id"] for r in out.collect()]
        if name in kept:
            assert set(ids) == kept[name] and out.columns == docs.columns, name
            assert ids.count(1) == (2 if name == "benchmark decontamination" else 1)
        if name == "toxicity":
            assert len(ids) <= len(rows) and ids.count(1) in (0, 2) and out.columns == docs.columns
        if name == "mixing sources":
            assert set(ids) <= {1, None, 5} and [c for c in docs.columns if c != "size"] == out.columns[:-4]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name


def test_stage_batches(spark):
    """What Python workers get at once is bounded in rows and in bytes, whatever the partition holds; smaller settings stay."""
    keys = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in keys]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    stage = corpus_pipeline._stage(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long, size long"))
    try:
        short = spark.range(5000, numPartitions=1).selectExpr("id doc_id", "'a' text")
        found = [r["n"] for r in stage(spark, short, SMALL).collect()]
        assert sum(found) == 5000 and max(found) <= 1000
        long = spark.range(64, numPartitions=1).selectExpr("id doc_id", "repeat('abcdefgh', 1 << 16) text")  # 32 MB
        found = stage(spark, long, SMALL).collect()
        assert sum(r["n"] for r in found) == 64 and max(r["size"] for r in found) <= 10 << 20
        spark.conf.set(keys[0], 10)
        assert max(r["n"] for r in stage(spark, short, SMALL).collect()) <= 10
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_hashing_memory():
    """Hashing many texts holds the temporary arrays of a small part of them."""
    rng = np.random.default_rng(1)
    texts = [b" ".join(b"w%d" % x for x in rng.integers(0, 10**6, 300)) for _ in range(2000)]  # 4.5 MB
    tracemalloc.start()
    sizes = [len(s) for s in sets_of(texts, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sizes == [296] * 2000 and peak < 40e6
