"""Source divergence, spelling variants and url verdicts: against SQL and brute force, and their edge cases."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from basketry.llm import divergence, queries, spelling, urls

SMALL = "/root/testdata/sf0.001"
NEW = ["op11_audit_sources", "op12_group_spellings", "op13_judge_urls"]


def rows_of(df, columns):
    return sorted(repr([r[c] for c in columns]) for r in df.collect())


@pytest.mark.parametrize("name", NEW)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SMALL}/{file}'")
    df = queries.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert rows_of(df, columns) == sorted(repr(list(r)) for r in want)


# --- 11: source divergence ---

TEXTS = ["Red red fish", "blue FISH; fish", "Öl ÖL öl", "", "12 34", "a_b-c", "red" * 5 + " fish", "fish\x00red\tfish"]


def brute_audit(rows, least, top):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        kept = [t for t, n in Counter(t for r in own for t in set(r[2])).items() if n >= least]
        sources = {r[1] for r in own}
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if t in kept) for s in sources}
        counts[None] = sum((Counter(c) for c in counts.values()), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept} for s, c in counts.items()}
        for s in sources:
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s}))
            terms = sorted((p[None][t] - p[s][t], t.encode()) for t in kept if counts[s][t] and p[s][t] > p[None][t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("least", [1, 3, 1000])
def test_audit_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(divergence, "TERMS", 4)  # several parts of the vocabulary
    rng = random.Random(least)
    rows = [(rng.choice(TEXTS + [None]), rng.choice(["en", "de", None, ""]), rng.choice([None, "a", "b", "c", "é", "z"])) for _ in range(60)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, source string, n long, item string")
    got = divergence.audit_sources(df, least=least, top=2)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, least, 2)


def test_audit_many_sources(spark):
    """More sources than a block of pairs holds."""
    rng = random.Random(5)
    rows = [(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=3)), "en", f"s{i % 530}") for i in range(700)]
    got = divergence.audit_sources(spark.createDataFrame(rows, "text string, lang string, source string"), least=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, 5, 50)


def test_audit_empty(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_sums_are_sent_when_full(monkeypatch):
    """Tasks that send their sums in parts give the same totals."""
    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de", "en"] * 4, "key": ["1", "2", "3"] * 4, "text": ["one two three", "two two", "three fours"] * 4})
    for module, run, names in ((divergence, divergence.document_counts, ("lang", "term")), (spelling, spelling.counted_words(3, 97), ("word",))):
        totals = []
        for most in (10**6, 2):
            monkeypatch.setattr(module, "ENTRIES", most)
            parts, sums = 0, Counter()
            for b in run(iter([batch, batch])):
                parts += 1
                for r in b.to_pylist():
                    sums[tuple(r[n] for n in names)] += r["n"]
            totals.append((parts, sums))
        assert totals[0][1] == totals[1][1] and totals[1][0] > totals[0][0]


def test_pieces(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 7)
    text = b"One two--threefourfivesix, 7 eight " * 5
    found = list(divergence.pieces(text))
    assert len(found) > 5 and all(p[:1] == p[-1:] == b" " for p in found)
    assert b" ".join(p.strip() for p in found).split() == re.findall(rb"[a-z]+", text.lower())
    assert list(divergence.pieces(b"")) == [b"  "]


# --- 12: spelling variants ---


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@pytest.mark.parametrize("hot", [1000, 4, 1])
def test_near_words(spark, hot):
    rng = random.Random(hot)
    words = {"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(400)} | {"aaaaa", "aaaaaa"}
    df = spark.createDataFrame([(w, 1 + len(w), len(w)) for w in words], "word string, n long, size int")
    found = [tuple(sorted((r["a"], r["b"]))) for r in spelling.near_words(df, least_length=1, hot=hot).collect()]
    want = {(a, b) for a in words for b in words if a < b and one_edit(a, b)}
    assert len(found) == len(set(found)) and set(found) == want


def brute_spellings(rows, least, every):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= least}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {w: min(its, key=lambda x: (-n[x], x)) for w, its in near.items() if its}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in n)


@pytest.mark.parametrize("every", [97, 3])
def test_spellings_brute_force(spark, every):
    rng = random.Random(every)
    base = ["kitchen", "kitchens", "kittens", "kitten", "mitten", "Straße", "garçon", "garcon", "ÉCOLE", "école"]
    rows = [(rng.choice([None, *range(5)]), " ".join(rng.choices(base, weights=range(1, 11), k=20))) for _ in range(40)] + [(1, None), (2, ""), (3, " \n"), (3, "x" * 50_000)]
    rows += [(k, "aaaaaab " * 2**k) for k in range(3)] + [(k, "aaaaaac " * 3**k) for k in range(4)] + [(7, "aaaaaacc " * 90)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = spelling.group_spellings(df, every=every)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], r["form_n"] or 0) for r in got.collect()) == brute_spellings(rows, 3, every)


def test_spellings_empty(spark):
    assert spelling.group_spellings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- 13: url filters ---

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("EXAMPLE.org", "/en/1", "block"), ("example.org", "/en/1", "allow"), ("net", None, "block"), ("b.c", "/xy", "allow"), ("a.b.c", "/", "block"), (None, "/", "block"), ("", "/", "block"), ("com", "/", None)]
URLS = ["http://Example.ORG/es/1?q", "https://www.example.org/en/12", "x://myexample.org/es/", "http://org/", "http://org", "http://a.net#f", "ftp://.net/", "http://a.b.c/xy", "http://b.c/xyz", "http://b.c/x", "http://a.com/", "no scheme", "", None, "http://", "http:///p", "a://b.net://c.org/", "http://example.org:80/es/", "http://x.org/" + "p" * 100_000, "http://" + "a." * 3000 + "org/é", "HTTP://É.org/Z"]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for h, p, v in RULES:
        h, p = (h or "").lower(), p or ""
        if h and v and (host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), v, h + p))
    return (host, path, *((max(fits)[3], max(fits)[2]) if fits else (None, "allow")))


def test_urls_brute_force(spark):
    docs = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(URLS * 2)], "page_id long, url string, host string, `a.b` int")
    got = urls.judge_urls(docs, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    assert got.columns == ["page_id", "url", "a.b", "host", "path", "rule", "verdict"]
    for r in got.collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"])


def test_urls_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    docs = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert [(r["rule"], r["verdict"]) for r in urls.judge_urls(docs, none, default="block").collect()] == [(None, "block")]
    assert urls.judge_urls(docs.limit(0), spark.createDataFrame(RULES, none.schema)).count() == 0


def test_digest_list(spark, monkeypatch):
    """Many shards; every key is found, others are not."""
    monkeypatch.setattr(urls, "SHARD", 100)
    keys = [f"host{i}.example/{'é' * (i % 5)}" for i in range(2000)]
    found = urls.digest_list(spark.createDataFrame([(k, k[::-1]) for k in keys], "key string, value string"), "key", "value")
    assert len(found.files) > 15 and list(found.least) == sorted(found.least)
    asked = keys[::-1] + [f"other{i}" for i in range(500)]
    assert found.find(asked) == [k[::-1] for k in keys[::-1]] + [None] * 500


def test_digest_collision():
    """Keys with one digest are told apart by the stored strings."""
    digest = np.array([5, 5, -3, 5], np.int64)
    array = urls.DigestArray(urls.DigestArray.encode(digest, ["a", "b", "c", "ñ"], ["1", "2", "3", "4"]))
    assert array.find(np.array([5, 5, 5, -3, 5, 7]), ["b", "ñ", "a", "c", "zz", "a"]) == ["2", "4", "1", "3", None, None]
