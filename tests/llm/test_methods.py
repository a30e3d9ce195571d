"""Each method against brute force, an exact round trip or held-out accuracy."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketry.llm import chat, decontam, exact, jaccard, lines, mixing, ngram, pii, suffixes, toxicity
from basketry.llm.eliasfano import EliasFano, Level, dequantise, open_level, pack, quantise, save, unpack

SMALL = "/root/testdata/sf0.001"


def documents(spark, folder=SMALL):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# --- 8: exact dedup ---


@given(st.binary(max_size=3000), st.sampled_from([64, 256]))
@settings(max_examples=50, deadline=None)
def test_chunks_round_trip(data, mean):
    assert b"".join(part for _, part in exact.chunks_of(data, mean, 0)) == data


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(0)
    body = rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    a = {k for k, _ in exact.chunks_of(body, 256, 0)}
    b = {k for k, _ in exact.chunks_of(b"some other beginning" + body, 256, 0)}
    assert len(a & b) > 0.9 * len(a)


def test_exact_dedup(spark):
    df = documents(spark)
    want = defaultdict(list)
    for d, t in texts(df).items():
        want[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d))
    for r in exact.exact_dedup(df, mean_chunk=64).collect():
        t = re.sub(r"[\x20\x09-\x0D]", "", texts_cache(df)[r["doc_id"]])
        group = sorted(want[t])
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (group[0][1], len(group), group[0][1] == r["doc_id"], hashlib.sha256(t.encode()).hexdigest())


_CACHE = {}


def texts_cache(df):
    if id(df) not in _CACHE:
        _CACHE[id(df)] = texts(df)
    return _CACHE[id(df)]


# --- 2: mixing ---


def test_mix_meets_targets(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), f"s{int(i % 7 > 2) + int(i % 7 > 5) * 2}" if i % 50 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_sources(df.repartition(3)).collect()))
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 3 * size[s] if s in full else level * weight[s] for s in order}
    took, largest = Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert math.isclose(r["target"], target[s]) and r["source_size"] == size[s]
        assert r["taken"] <= 3 * r["size"]
        took[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(target[s] - took[s]) <= max(0.001 * target[s], min(len(t.split()) for _, t, x in rows if x == s)) for s in order)


def pareto_by_hand(sizes, u, tie, rest, near, rounds=8):
    """The documents taken, by the definition: sizes, random numbers and hashes by document, the words to take, the least that may be missing."""
    can = {d for d, n in sizes.items() if 0 < n <= rest}
    certain = set()
    while can - certain:
        c = (rest - sum(sizes[d] for d in certain)) / sum(sizes[d] ** 2 for d in can - certain)
        more = {d for d in can - certain if c * sizes[d] >= 1}
        if not more:
            break
        certain |= more
    rank = {d: -1e6 if d in certain else math.log(u[d] / (1 - u[d])) - math.log(c * sizes[d] / (1 - c * sizes[d])) for d in can}
    taken, left, begin = set(), rest, rest
    for d in sorted(can, key=lambda d: (rank[d], d)):
        if left > near and rounds and sizes[d] <= left:
            taken.add(d)
            left -= sizes[d]
        elif rounds and sizes[d] <= begin:
            rounds, begin = rounds - 1, left
    if left > near and (more := [d for d in sizes if d not in taken and 0 < sizes[d] < 2 * left]):
        taken.add(min(more, key=lambda d: (abs(sizes[d] - left), tie[d])))
    return taken


def test_mix_comes_near_from_both_sides(spark):
    """A document a little longer than what is wanted is taken, and no document more would bring a source nearer to its target."""
    alone = spark.createDataFrame([(1, 18_000, "a"), (2, 17_972, "b")], "doc_id long, n long, source string")
    assert {r["source"]: r["taken"] for r in mixing.mix_rows(alone, (1, 1), size=F.col("n")).collect()} == {"a": 18_000, "b": 17_972}
    two = spark.createDataFrame([(1, 600, "a"), (2, 600, "a"), (3, 1080, "b")], "doc_id long, n long, source string")
    got = mixing.mix_rows(two, (1, 1), size=F.col("n")).groupBy("source").agg(F.sum("taken").alias("n"), F.first("target").alias("t")).collect()
    assert {r["source"]: (r["n"], r["t"]) for r in got} == {"a": (1200, 1140.0), "b": (1080, 1140.0)}
    rng = random.Random(11)
    rows = [(100 * j + k, rng.choice([rng.randint(1, 40), rng.randint(200, 3000)]), f"s{j:03d}") for j in range(120) for k in range(rng.randint(1, 12))]
    by = {}
    for r in mixing.mix_rows(spark.createDataFrame(rows, "doc_id long, n long, source string"), size=F.col("n")).collect():
        by.setdefault(r["source"], []).append(r)
    for its in by.values():
        target, taken = its[0]["target"], sum(r["taken"] for r in its)
        whole, miss = int(target // its[0]["source_size"]), abs(target - taken)
        left = [r["size"] for r in its if r["taken"] == whole * r["size"]]
        more = [r["size"] for r in its if r["taken"] > whole * r["size"]]
        assert all(r["taken"] <= 3 * r["size"] for r in its)
        if taken < target - 0.001 * target:
            assert all(abs(target - taken - n) >= miss for n in left)
        elif taken > target + 1e-6:
            assert any(target - taken + n > miss for n in more)


def test_mix_selection(spark):
    """The selection by hand, with a document of a third of its source's words; inclusion over 60 sources alike is in proportion to size, but for the few small documents that settle the end."""
    rng = random.Random(7)
    rows = [(i, int(rng.lognormvariate(3, 1)) + 1, "ab"[i % 2]) for i in range(400)] + [(400, 3000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, n long, source string")
    got = mixing.mix_rows(df, (1, 2), size=F.col("n"))
    tie = {r[0]: r[1] for r in df.select("doc_id", F.xxhash64("doc_id")).collect()}
    u = {r[0]: r[1] for r in df.select("doc_id", ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 11).cast("double") + 0.5) / float(1 << 53))).collect()}
    for s, found in ((s, [r for r in got.collect() if r["source"] == s]) for s in "ab"):
        sizes, target = {r["doc_id"]: r["size"] for r in found}, found[0]["target"]
        whole = int(target // sum(sizes.values()))
        taken = pareto_by_hand(sizes, u, tie, target - whole * sum(sizes.values()), 0.001 * target)
        assert {r["doc_id"]: r["taken"] for r in found} == {d: (whole + (d in taken)) * n for d, n in sizes.items()}
    sizes = [5 + k % 20 for k in range(600)] + [100]
    df = spark.createDataFrame([(60 * k + j, n, f"s{j:03d}") for j in range(60) for k, n in enumerate(sizes)], "doc_id long, n long, source string")
    got = mixing.mix_rows(df, (1, 1.5), size=F.col("n")).filter("target < source_size")
    share = got.groupBy("size").agg(F.avg(F.when(F.col("taken") > 0, 1.0).otherwise(0.0)).alias("p"), F.count("*").alias("n"), F.first("target").alias("t")).collect()
    c = next(c for c in (share[0]["t"] * x / 1e6 / sum(sizes) for x in range(1, 10**6)) if sum(n * min(1, c * n) for n in sizes) >= share[0]["t"])
    for r in share:
        p = min(1, c * r["size"])
        assert abs(r["p"] - p) < 4 * math.sqrt(p * (1 - p) / r["n"]) + 0.04


# --- 3: toxicity ---


def test_pairs_of_terms_are_learned():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (4000, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] + (1 - x[:, 0]) * (1 - x[:, 1])).astype(float)  # neither term tells anything alone
    b, w, v = toxicity.fit_machine(x, y, 4, 400, 1e-5, 0)
    xv = x @ v
    z = b + x @ w + 0.5 * ((xv**2).sum(1) - (x @ (v**2)).sum(1))
    assert ((z > 0) == (y > 0.5)).mean() > 0.95


def test_pairs_and_rare_terms_reach_training(spark):
    """A pair whose members tell nothing alone, and a term of three rows, among 5,000 other words."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(4000):
        words = [f"w{k}" for k in rng.integers(0, 5000, 10)]
        rows.append((i, " ".join(words + ["insult"] * (i % 2) + ["group"] * (i // 2 % 2)), int(i % 2 == i // 2 % 2)))
    rows += [(4000 + i, "rareterm insult", 1) for i in range(3)]  # alone, an insult without a group is clean
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    neither, insult, group, both, rare = model.scores([b"w", b"w insult", b"w group", b"w insult group", b"rareterm insult"])
    assert min(neither, both) > 0.7 and max(insult, group) < 0.3
    assert rare > insult + 0.01


def test_held_out_accuracy(spark):
    """Recall and precision on the rows that training never sees."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score_documents(documents(spark, folder), labels).filter("held_out").join(labels, "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    recall, precision = n[1, 1] / (n[1, 1] + n.get((1, 0), 0)), n[1, 1] / (n[1, 1] + n.get((0, 1), 0))
    assert recall > 0.75 and precision > 0.9, (recall, precision)


def test_scores_by_hand():
    """The machine's score from its definition, pair by pair."""
    rng = np.random.default_rng(2)
    texts = [b"a b c d", b"", b"b b b", b"zz c", b"a, b. C!", b"d " * 50]
    seen = np.unique(toxicity.term_buckets([b"a b c d"], 18)[0])
    model = toxicity.ToxicityModel(18, seen, -0.3, rng.normal(size=len(seen)), rng.normal(size=(len(seen), 3)))
    for text, got in zip(texts, model.scores(texts), strict=True):
        own = sorted({int(np.searchsorted(seen, x)) for x in toxicity.term_buckets([text], 18)[0] if x in seen})
        z = model.bias + sum(model.w[i] for i in own) + sum(float(model.v[i] @ model.v[k]) for i in own for k in own if i < k)
        assert math.isclose(got, 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_cut_is_the_best_allowed():
    rng = np.random.default_rng(6)
    for _ in range(50):
        z = np.round(rng.normal(size=30), 1)
        y = (rng.random(30) < 1 / (1 + np.exp(-2 * z))).astype(float)
        w = rng.choice([1.0, 3.0], 30)
        if not y.sum():
            continue
        found = toxicity.cut_at(z, y, w, 0.8)
        told = {}
        for c in np.unique(z):
            called = z >= c
            told[c] = ((w * y)[called].sum() / w[called].sum(), (w * (called != (y == 1))).sum())
        allowed = {c: e for c, (p, e) in told.items() if p >= 0.8} or {c: -p for c, (p, e) in told.items()}
        mine = min(c for c in told if c > found)
        assert mine in allowed and math.isclose(allowed[mine], min(allowed.values()))


def test_one_text_an_id(spark):
    """Repeated labels and repeated documents of an id make one row of the sample."""
    docs = spark.createDataFrame([(i % 3, f"word{i}") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 3, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    assert len(toxicity.train(docs, labels).features) == 3


# --- 1: lines ---


@given(st.text("abc", max_size=30), st.text("abcd", max_size=30), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_edit_distance(a, b, most):
    assert lines.edit_distance(a, b, most) == min(most + 1, lines.plain_distance(a, b, 10**6))


@given(st.text("ab", min_size=8, max_size=40), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 39), st.sampled_from("abc")), max_size=3))
@settings(max_examples=300, deadline=None)
def test_near_lines_share_a_key(a, edits):
    b = list(a)
    for kind, at, c in edits:
        at %= max(1, len(b))
        if kind == 0:
            b[at] = c
        elif kind == 1:
            b.insert(at, c)
        elif len(b) > 6:
            del b[at]
    b = "".join(b)
    k = len(edits)
    short, long = sorted((a, b), key=len)
    if a == b or not k or lines.plain_distance(a, b, 99) > k or len(short) <= k:
        return
    own, probes = lines.segment_keys(short, k)
    own_long, probes_long = lines.segment_keys(long, k)
    assert set(own) & (set(own_long) | set(probes_long)) or (len(a) == len(b) and set(own_long) & set(probes))


def test_line_decisions(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefg ") for _ in range(rng.randint(30, 60))).strip().ljust(34, "x") for _ in range(20)]
    docs = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 4)):
                line[rng.randrange(len(line))] = rng.choice("abc")
            out.append("".join(line) if rng.random() < 0.8 else "short")
        docs.append((i, "\n".join(out)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    seen: dict = {}
    gone = set()
    for _, t in docs:
        for line in t.split("\n"):
            s = line.strip()
            if len(s) >= 32 and s not in seen:
                if any(lines.plain_distance(s, x, 99) <= 2 for x in seen):
                    gone.add(s)
                seen[s] = None
    first, want = set(), {}
    for i, t in docs:
        want[i] = []
        for k, line in enumerate(t.split("\n")):
            if s := line.strip():
                if s in gone or s in first:
                    want[i].append(k)
                first.add(s)
    rows = df.select(F.col("doc_id").alias("_id"), F.col("doc_id").alias("_row"), F.col("text").alias("_text"))
    assert {r["_id"]: r["removed"] for r in lines.line_decisions(rows, hot=1).collect()} == want


@given(st.text("ab", min_size=12, max_size=30), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 29), st.sampled_from("abc")), min_size=1, max_size=2))
@settings(max_examples=200, deadline=None)
def test_narrowed_keys_keep_near_lines_together(a, edits):
    b = list(a)
    for kind, at, c in edits:
        at %= len(b)
        if kind == 0:
            b[at] = c
        elif kind == 1:
            b.insert(at, c)
        else:
            del b[at]
    short, long = sorted((a, "".join(b)), key=len)

    def keys(line, size, specs, own):
        return {(lines.spec_key(line, size, new), new) for old in specs for new in lines.split_spec(old, 4, own)}

    n = len(short)
    left, right = [(0, n, 2, 0)], [(0, n, 2, len(long) - n)]
    for _ in range(3):
        mine, probes = keys(short, n, left, True), keys(long, n, right, False)
        shared = {k for k, _ in mine} & {k for k, _ in probes}
        assert shared
        left, right = [spec for k, spec in mine if k in shared], [spec for k, spec in probes if k in shared]


def test_variants_of_one_line_are_not_paired(spark):
    """Lines that differ in one word, a number or two letters: decisions equal brute force, whatever the size of the group."""
    rng = random.Random(3)
    base = "the quick brown fox number 000000 jumps over the lazy dog again"
    found = []
    for i in range(500):
        line = base.replace("000000", f"{rng.randrange(10**6):06d}") if i % 3 else base.replace("lazy", "".join(rng.choice("abcdef") for _ in range(5)))
        at = rng.randrange(len(line))
        found.append(line[:at] + rng.choice(["", "x", "yz"]) + line[at + rng.randrange(2) :])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(found)], "_row long, _text string").withColumn("_id", F.col("_row"))
    got = {r["_id"]: r["removed"] for r in lines.line_decisions(df, hot=4).collect()}
    assert got == {i: [0] * any(lines.edit_distance(x, y, 2) <= 2 for y in found[:i]) for i, x in enumerate(found)}


# --- 4: suffixes ---


def brute_repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def repeat_corpus():
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(4)]
    docs = {}
    for i in range(80):
        parts = []
        for _ in range(rng.randint(1, 4)):
            a = rng.randint(0, 300)
            parts.append(rng.choice(base)[a : a + rng.randint(20, 300)])
            parts.append("".join(rng.choice("xyz") for _ in range(rng.randint(0, 9))))
        docs[i] = "".join(parts)
    return docs | {100: "a" * 400, 101: "ab" * 200, 102: "é" * 100, 103: ""}


def test_remove_repeats(spark):
    docs = repeat_corpus()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    want = brute_repeats(docs, 100)
    for hot in (suffixes.HOT, 3):
        got = {r["doc_id"]: tuple(r)[1:5] for r in suffixes.remove_repeats(df, hot=hot).collect()}
        assert got == want


def test_repeat_groups_hold_all_places(spark):
    passage = "".join(random.Random(7).choice("abcdefghij") for _ in range(150))
    docs = [(i, f"{chr(65 + i) * 30}{passage}{chr(75 + i) * 30}") for i in range(5)]
    got = suffixes.repeat_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    full = Counter(r["group"] for r in got if r["size"] == 150 and r["begin"] == 30)
    assert full and set(full.values()) == {5}


def brute_groups(docs, length):
    """The places of every maximal repeat: grow each window's places while all of them agree, to either side."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    at = {}
    for d, b in data.items():
        for i in range(len(b) - length + 1):
            at.setdefault(b[i : i + length], set()).add((d, i))
    found, todo = set(), [(w, frozenset(p)) for w, p in at.items() if len(p) > 1]
    seen = set()
    while todo:
        word, places = todo.pop()
        if word in seen:
            continue
        seen.add(word)
        n, sides = len(word), []
        for back in (1, 0):
            by = {}
            for d, i in places:
                j = i - 1 if back else i + n
                by.setdefault(data[d][j] if 0 <= j < len(data[d]) else (d, i), set()).add((d, i - back))
            sides.append(len(by) > 1)
            for c, some in by.items():
                if len(some) > 1:
                    todo.append((bytes([c]) + word if back else word + bytes([c]), frozenset(some)))
        if all(sides):
            found.add((n, places))
    return found


def test_repeat_groups_equal_brute_force(spark):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    left, right, core = word(60), word(60), word(40)
    docs = {
        1: word(20) + left + core + right + word(9),  # 1 and 2 share all, 3 the right part only
        2: word(30) + left + core + right + word(5),
        3: word(70) + core + right + word(8),
        4: word(200),
        5: left + core + right,
        6: left + core + right,  # a copy that also stands in others
        7: None,
    }
    docs |= {8: word(130), 10: word(50) + left + core + word(50) + left + core}
    docs[9] = docs[8]  # a copy that stands nowhere else
    got = {}
    for r in suffixes.repeat_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), length=64).collect():
        got.setdefault(r["group"], set()).add((r["doc_id"], r["begin"]))
    assert {(g["size"], frozenset(p)) for g, p in got.items()} == brute_groups(docs, 64)


# --- 5: personal data ---

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "email":
        return True
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    total = sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(digits)))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def test_base_spans(spark):
    rng = random.Random(3)
    toks = ["a", "b1", "@", ".", "com", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", " ", "(", ")", "x@y.z", "10.0.0.1", "+1 (555) 010-9999", "é", "𝄞", "_", "%", "@@", "1" * 30, "\n"]
    docs = {i: "".join(rng.choice(toks) for _ in range(rng.randint(0, 25))) for i in range(800)}
    for r in pii.find_pii(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect():
        spans, n = [], []
        for k, p in PLAIN.items():
            own = [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, docs[r["doc_id"]]) if counts(k, m[0])]
            spans += own
            n.append(len(own))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(n)
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",")) | {""}


def test_estimates_find_the_reliable_labelers():
    rng = random.Random(1)
    patterns = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.6
        votes = tuple((1 if truth else -1) * (1 if rng.random() < good else -1) for good in (0.95, 0.9, 0.85, 0.5, 0.5))
        patterns["card", votes] += 1
    belief = pii.estimate([(k, v, n) for (k, v), n in patterns.items()])
    assert belief["card", (1, 1, 1, -1, -1)] > 0.95 and belief["card", (-1, -1, -1, 1, 1)] < 0.05


# --- 6: decontamination ---


def test_tiles_find_moved_passages(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    item = [rng.choice(words) for _ in range(40)]
    noise = [rng.choice(words) + "z" for _ in range(300)]
    moved = noise[:100] + item[20:] + noise[100:200] + item[:20] + noise[200:]
    part = noise[:100] + item[:12] + noise[100:]
    docs = spark.createDataFrame([(1, " ".join(moved)), (2, " ".join(part)), (3, " ".join(noise))], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for size in (1 << 20, 0):
        got = {r["doc_id"]: (r["covered"], r["tiles"]) for r in decontam.tiled_pairs(docs, items, broadcast_bytes=size).collect()}
        assert got == {1: (40, 2), 2: (12, 1)}
        assert [r["doc_id"] for r in decontam.contaminated(docs, items, broadcast_bytes=size).collect()] == [1]


def test_seed_join_finds_what_the_broadcast_finds(spark):
    """Both ways over items of 1 to 40 words, one of them a frequent four-word run, and texts that quote them in pieces."""
    rng = random.Random(9)
    items = {i: [f"v{rng.randrange(50)}" for _ in range(rng.choice([1, 2, 3, 4, 6, 20, 40]))] for i in range(60)} | {99: "a common run here".split()}
    texts = []
    for _ in range(200):
        words = []
        for _ in range(3):
            w = items[rng.randrange(60)]
            at = rng.randrange(len(w))
            words += w[at : at + rng.randint(3, 30)] + [f"z{rng.randrange(999)}"] + items[99]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    a, b = (sorted(map(tuple, decontam.contaminated(docs, bench, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b and len(a) > 200
    want = set()
    for d, t in enumerate(texts):
        for k, w in items.items():
            if 2 * sum(x[2] for x in tiles_by_hand(t.split(), w, min(4, len(w)))) >= len(w):
                want.add((d, k))
    assert {(r[0], r[1]) for r in a} == want


@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), max_size=15), st.integers(2, 4))
@settings(max_examples=200, deadline=None)
def test_tiles_are_valid_and_longest_first(a, b, least):
    x, y = np.array(a, np.uint64), np.array(b, np.uint64)
    tiles = decontam.greedy_tiles(x, y, least)
    assert all(a[i : i + n] == b[j : j + n] and n >= least for i, j, n in tiles)
    assert len({k for i, _, n in tiles for k in range(i, i + n)}) == sum(t[2] for t in tiles) == len({k for _, j, n in tiles for k in range(j, j + n)})
    longest = max((n for i in range(len(a)) for j in range(len(b)) for n in range(1, 41) if a[i : i + n] == b[j : j + n] and i + n <= len(a) and j + n <= len(b)), default=0)
    assert (tiles[0][2] if tiles else 0) == (longest if longest >= least else 0)


def tiles_by_hand(a, b, least):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    for n in range(min(len(a), len(b)), least - 1, -1):
        for i in range(len(a) - n + 1):
            for j in range(len(b) - n + 1):
                if a[i : i + n] == b[j : j + n] and all(free_a[i : i + n]) and all(free_b[j : j + n]):
                    free_a[i : i + n] = free_b[j : j + n] = [False] * n
                    tiles.append((i, j, n))
    return tiles


@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=20), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_tiles_equal_those_by_hand(a, b, least):
    got = decontam.greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == tiles_by_hand(a, b, least)


def test_tiles_of_one_word_repeated():
    """20,000 equal words against 1,000: a pass a length, not all pairs of places."""
    words = np.full(20_000, 7, np.uint64)
    words[:100] = np.arange(100)
    begin = time.monotonic()
    tiles = decontam.greedy_tiles(words, np.concatenate((np.full(950, 7, np.uint64), np.arange(50, dtype=np.uint64))), 4)
    assert tiles == [(100, 0, 950), (8, 958, 42), (0, 950, 7)] or sum(t[2] for t in tiles) >= 999
    assert time.monotonic() - begin < 5


# --- 7: Jaccard ---


def brute_components(docs, n, percent):
    sets = {}
    for d, t in docs.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_components(spark):
    rng = random.Random(6)
    docs = {}
    for i in range(150):
        if docs and rng.random() < 0.7:
            words = docs[rng.choice(list(docs))].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 99)}"
        else:
            words = [f"v{rng.randint(0, 60)}" for _ in range(rng.randint(3, 60))]
        docs[i] = " ".join(words)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    for n, percent in ((4, 85), (3, 50)):
        got = {r[0]: (r[1], r[2]) for r in jaccard.jaccard_components(df, n=n, percent=percent).collect()}
        assert got == brute_components(docs, n, percent)


def test_full_rings_are_parted(spark):
    """Edits of one text that lie beyond the threshold from it: rings of more documents or shingles than a group may hold."""
    rng = random.Random(8)
    base, sets = list(range(40)), {}
    for i in range(120):
        kept = [x for x in base if rng.random() > 0.15]
        sets[i] = sorted({*kept, *rng.sample(range(40, 60), 3)})
    sets = {i: s for i, s in sets.items() if s not in [sets[j] for j in range(i)]}
    df = spark.createDataFrame([(i, len(s), s) for i, s in sets.items()], "row long, n long, set array<long>")
    linked = lambda a, b: 100 * len({*a} & {*b}) >= 75 * len({*a} | {*b})

    def parts(links):
        root = {i: i for i in sets}
        for a, b in links:
            x, y = root[a], root[b]
            root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
        return root

    want = parts([(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])])
    assert 2 < len(set(want.values())) < len(sets) - 10
    for block, load in ((2000, 8_000_000), (5, 8_000_000), (2000, 150)):
        links = [tuple(r) for r in jaccard.set_links(df, 75, block, load).collect()]
        assert all(linked(sets[a], sets[b]) for a, b in links) and parts(links) == want


# --- 9: n-grams ---


@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(0, 1 << 41), max_size=50))
@settings(max_examples=100, deadline=None)
def test_elias_fano(values, asked):
    v, q = np.sort(np.array(values, np.uint64)), np.array(asked, np.uint64)
    e = EliasFano(EliasFano.encode(v))
    assert (e.get(np.arange(len(v))) == v).all()
    assert (e.successor(q) == np.searchsorted(v, q)).all()
    assert (unpack(pack(v, True), np.uint64, True) == v).all()


def test_level_from_a_file(tmp_path):
    rng = np.random.default_rng(0)
    keys = np.unique((rng.integers(0, 200, 5000, dtype=np.uint64) << np.uint64(32)) | rng.integers(1, 300, 5000, dtype=np.uint64))
    counts = rng.integers(2, 10_000, len(keys))
    p, backs = counts / 10_000, rng.random(len(np.unique(keys >> np.uint64(32))))
    save(f"file://{tmp_path}/trie/level", Level.encode(keys, p, backs, counts))
    level = open_level(f"file://{tmp_path}/trie/level")
    assert not level.codes.flags.owndata
    asked = np.concatenate((keys, keys + np.uint64(1), keys + (np.uint64(1) << np.uint64(40))))
    want = np.array([int(np.searchsorted(keys, k)) if k in set(keys.tolist()) else -1 for k in asked])
    assert (level.find(asked) == want).all()
    assert np.abs(dequantise(quantise(p)) / p - 1).max() < 1e-3 and (level.codes == quantise(p)).all() and (level.counts == counts).all()
    context = np.unique(keys >> np.uint64(32))
    assert (level.back_codes(np.append(context, np.uint64(10**6))) == np.append(quantise(backs), 1)).all()


def test_scores(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ngram, "BLOCK", 50_000)
    monkeypatch.setattr(ngram, "SHARD", 500)
    df = documents(spark)
    tokens = {d: [*t.encode().lower().split(), None] for d, t in texts(df).items()}
    one, two, three = Counter(), Counter(), Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 10:
            x = [None, *w]
            one.update(w)
            two.update(zip(x, x[1:], strict=False))
            three.update(zip(x, x[1:], x[2:], strict=False))
    total, known = sum(one.values()), len(one)
    kept2, kept3 = Counter(), Counter()
    for (u, _), c in two.items():
        kept2[u] += c if c >= 2 else 0
    for (u, v, _), c in three.items():
        kept3[u, v] += c if c >= 2 else 0
    assert max(one.values()) > 2_000  # a context in parts
    got = ngram.score_texts(df, toxicity.held_out("doc_id", 10), trie=f"file://{tmp_path}/trie").collect()
    assert len(list((tmp_path / "trie" / "level-3").iterdir())) > 10
    assert len(got) == len(tokens)
    gain = 0.0
    for r in got:
        w, base, score = tokens[r["doc_id"]], 0.0, 0.0
        x = [None, *w]
        for i, t in enumerate(w):
            p = (one[t] + 0.1) / (total + 0.1 * (known + 1))
            base += math.log10(p)
            u = x[i]
            if one[u] >= 2:
                c = two[u, t] if two[u, t] >= 2 else 0
                p = (c + (one[u] - kept2[u] + 4) * p) / (one[u] + 4)
            if i and two[x[i - 1], u] >= 2:
                h, c = two[x[i - 1], u], three[x[i - 1], u, t]
                p = ((c if c >= 2 else 0) + (h - kept3[x[i - 1], u] + 4) * p) / (h + 4)
            score += math.log10(p)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[t] > 0 for t in w), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=3e-3)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


# --- 10: chat ---


def test_quotes_are_linked(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"),
        (1, 1, "assistant", "On Monday Ann wrote:\n> Hello there\n> how are  you?\n\nFine."),
        (1, 2, "user", "> > hello there\n> Fine.\nGood to hear"),
        (1, 3, "user", "> how are you?\nstill fine"),
        (1, 4, "assistant", ">Good to hear\nok"),
        (2, 0, "user", "> nobody said\n5 > 3"),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 2, (2, 0): None}
    assert got[1, 4]["path"] == [0, 1, 2, 4] and got[1, 4]["depth"] == 3
    assert got[1, 1]["body"] == "Fine." and got[1, 2]["body"] == "Good to hear" and got[2, 0]["body"] == "5 > 3"
    assert (got[1, 2]["n_quotes"], got[1, 2]["n_linked"]) == (2, 2)


def test_quotes_with_blank_lines_other_breaks_and_greetings(spark):
    rows = [
        (1, 0, "a", "Hi all,\nthe meeting is on Monday."),
        (1, 1, "b", "Hi all,\nthe build is broken. Who can\nlook at it today?"),
        (1, 2, "c", "Bob wrote:\n\n\n\n>\n> Hi all,\n>\n> the build is broken. Who can\n> look at it today?\n>\nI can."),
        (1, 3, "d", "> who can look\n> at it today?\nNot me\n> I can.\nThanks"),
        (1, 4, "e", "> Hi all,\n> nobody wrote this\nWhat?"),
        (1, 5, "f", "She said:\nnothing is quoted\n>\n>\nok"),
        (None, 6, "g", "> I can.\nlost"),
    ]
    got = {r["turn"]: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {k: r["reply_to"] for k, r in got.items()} == {0: None, 1: None, 2: 1, 3: 2, 4: None, 5: None, 6: None}
    assert got[2]["body"] == "I can." and (got[3]["n_quotes"], got[3]["n_linked"]) == (2, 2)
    assert got[4]["body"] == "What?" and got[5]["body"].startswith("She said:\nnothing is quoted")


def test_triples_counted_twice_count(spark):
    """A phrase that training holds three times, whose pairs also stand elsewhere, is scored from its triple."""
    rows = [(i, "one two three") for i in range(3)] + [(10 + i, "one two four") for i in range(9)] + [(30 + i, "six two three") for i in range(9)]
    rows += [(99, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda **how: {r["doc_id"]: r["score"] for r in ngram.score_texts(df, F.col("doc_id") == 99, **how).collect()}[99]
    assert math.isclose(score(), score(least=(1, 2, 2)), rel_tol=1e-9)
    assert not math.isclose(score(), score(least=(1, 2, 8)), rel_tol=1e-3)


def test_keys_that_meet_across_batches():
    rng = random.Random(3)
    rows = {(rng.randint(0, 60), rng.randint(0, 3) * 2 + rng.randint(0, 1)) for _ in range(150)}
    rows = sorted(rows, key=lambda r: (r[0], -(r[1] & 1), r[1]))
    by = {}
    for k, h in rows:
        by.setdefault(k, []).append(h)
    want = {(k, h & -2, bool(h & 1)) for k, hs in by.items() for h in hs if any(x & 1 for x in hs) and len({x & -2 for x in hs}) > 1}
    for size in (1, 2, 3, 7, 1000):
        parts = [rows[i : i + size] for i in range(0, len(rows), size)]
        batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in p], pa.int64()), pa.array([h for _, h in p], pa.int64())], schema=lines.KEY) for p in parts]
        got = {tuple(r.values()) for b in lines._meeting(iter(batches)) for r in b.to_pylist()}
        assert got == want
