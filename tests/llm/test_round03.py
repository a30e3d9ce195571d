"""What the findings of round 03 on text operators would have failed."""

import os
import random
import time

import xxhash
from pyspark.sql import functions as F

from basketry.llm import lines, suffixes, toxicity


def test_fits_run_in_tasks(spark, tmp_path, monkeypatch):
    """The driver fits nothing: the whole sample and each of the four folds are fitted by other processes."""
    fit = toxicity.fit_terms

    def noted(*args, **more):
        (tmp_path / f"{os.getpid()}-{time.monotonic_ns()}").touch()
        return fit(*args, **more)

    monkeypatch.setattr(toxicity, "fit_terms", noted)
    docs = spark.createDataFrame([(i, f"word{i % 7} {'bad' * (i % 2)}", i % 2) for i in range(400)], "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    pids = [f.name.partition("-")[0] for f in tmp_path.iterdir()]
    assert len(pids) == 5 and str(os.getpid()) not in pids
    bad, good = model.scores([b"word1 bad", b"word1"])
    assert bad > 0.5 > good


def test_keys_are_moved_packed(spark, monkeypatch):
    """Keys and hashes take 16 bytes each on the way and are dealt by range, whatever the number of lines; none is lost."""
    moved = []
    put = lines.staged
    monkeypatch.setattr(lines, "staged", lambda df, tag: (lambda out: moved.append(out.agg(F.count("*"), F.sum(F.length("rows"))).first()) or out)(put(df, tag)) if tag == "keys" else put(df, tag))
    texts = [f"line {i // 2} of a table of many rows, written {'once' if i % 2 else 'onze'} at {i // 2 * 7919}" for i in range(3000)]
    rows = spark.createDataFrame([("\n".join(texts[i::10]),) for i in range(10)], "_text string")
    found = {tuple(r) for r in lines.shared_keys(rows, 32, 2).collect()}
    by = {}
    for line in texts:
        h = lines._line_hash(xxhash.xxh3_128_digest(line.encode()))
        for own, keys in zip((True, False), lines.segment_keys(line, 2), strict=True):
            for k in keys:
                by.setdefault(lines._signed(k), set()).add((h, own))
    want = {(k, h, own) for k, held in by.items() if any(own for _, own in held) and len({h for h, _ in held}) > 1 for h, own in held}
    n = sum(len(held) for held in by.values())
    assert found == want
    assert moved[0][0] < n / 4 and 16 * n <= moved[0][1] < 17 * n


def test_only_members_that_share_enough_are_compared(monkeypatch):
    """An anchor with many unlike contexts takes no comparison of left contexts that could not make up the length."""
    rng = random.Random(7)
    contexts = sorted((b"q" * 28 + bytes(rng.choices(b"abcd", k=72)), bytes(rng.choices(b"abcd", k=72)), (i, 0)) for i in range(500))
    x, y = contexts[100][0], contexts[300][1]
    contexts = sorted([*contexts, (x, y, (600, 0)), (x[:60] + b"z" * 40, y[:50], (601, 0))])
    calls, plain = [], suffixes.common
    monkeypatch.setattr(suffixes, "common", lambda a, b: calls.append(1) or plain(a, b))
    got = {contexts[i][2][0]: c for i, c in suffixes.bucket_covers(contexts, 100).items()}
    assert len(calls) < 2 * len(contexts)
    want = {}
    for right, left, (i, _) in contexts:
        for r, q, (k, _) in contexts:
            a, b = len(os.path.commonprefix([left, q])), len(os.path.commonprefix([right, r]))
            if k < i and a + b >= 100:
                want[i] = (min(want.get(i, (0, 0))[0], -a), max(want.get(i, (0, 0))[1], b))
    assert got == want and 601 in got
