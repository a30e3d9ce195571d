"""Verdicts on urls by lists of host and path rules, kept as sorted digest arrays in mapped files."""

from __future__ import annotations

import functools
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.eliasfano import save
from basketry.llm.store import shared_dir

SEED = 42  # of Spark's own xxhash64, which deals keys to shards
#: Keys of one shard: with their strings some 50 MB of file.
SHARD = 1_000_000
ADDED = ("host", "path", "rule", "verdict")


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digests(keys: list[str]) -> np.ndarray:
    """Signed 64-bit xxhash of each key, as Spark's xxhash64 gives it."""
    return np.array([xxhash.xxh64_intdigest(k.encode(), SEED) for k in keys], np.uint64).view(np.int64)


class DigestArray:
    """A file of ascending digests with the strings that they stand for and a value of each.

    Layout: number of keys; digests; ends of the keys and of the values; all keys; all values. A lookup is one
    vectorised binary search, then the stored key is compared: an equal digest of another string is passed over.
    """

    def __init__(self, buffer):
        (self.n,) = struct.unpack_from("<q", buffer, 0)
        self.digest = np.frombuffer(buffer, np.int64, self.n, 8)
        self.ends = np.frombuffer(buffer, np.int64, 2 * self.n, 8 + 8 * self.n).reshape(2, self.n)
        self.bytes = memoryview(buffer)[8 + 24 * self.n :]

    @staticmethod
    def encode(digest: np.ndarray, keys: list[str], values: list[str]) -> bytes:
        order = np.argsort(digest, kind="stable")
        raw = [[x[i].encode() for i in order] for x in (keys, values)]
        ends = np.cumsum([len(x) for part in raw for x in part], dtype=np.int64)
        return struct.pack("<q", len(keys)) + digest[order].tobytes() + ends.tobytes() + b"".join(raw[0]) + b"".join(raw[1])

    def _text(self, which: int, at: int) -> bytes:
        flat = which * self.n + at
        begin = int(self.ends.flat[flat - 1]) if flat else 0
        return bytes(self.bytes[begin : int(self.ends.flat[flat])])

    def find(self, digest: np.ndarray, keys: list[str]) -> list[str | None]:
        """The value of each key, None where the array lacks it."""
        out: list[str | None] = [None] * len(keys)
        place = np.searchsorted(self.digest, digest)
        hit = np.flatnonzero(place < self.n)
        for i in hit[self.digest[place[hit]] == digest[hit]]:
            at, want = int(place[i]), keys[i].encode()
            while at < self.n and self.digest[at] == digest[i]:
                if self._text(0, at) == want:
                    out[i] = self._text(1, at).decode()
                    break
                at += 1
        return out


@functools.lru_cache(maxsize=16)
def open_array(uri: str) -> DigestArray:
    """An array in a file: mapped into memory where the file system is mounted, else read (a shard at a time)."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return DigestArray(np.memmap(path, np.uint8, "r"))
    with store.open_input_file(path) as file:
        return DigestArray(file.read())


@dataclass
class DigestList:
    """Digest arrays over ranges of digests: least[k] is the least digest of files[k]."""

    least: np.ndarray
    files: list[str]

    def find(self, keys: list[str]) -> list[str | None]:
        out: list[str | None] = [None] * len(keys)
        if not self.files or not keys:
            return out
        digest = digests(keys)
        shard = np.searchsorted(self.least, digest, side="right") - 1
        for k in np.unique(shard[shard >= 0]):
            at = np.flatnonzero(shard == k)
            for i, v in zip(at, open_array(self.files[k]).find(digest[at], [keys[i] for i in at]), strict=True):
                out[i] = v
        return out


def digest_list(entries: DataFrame, key: str, value: str) -> DigestList:
    """Write entries (distinct keys) as sorted digest arrays to the shared folder, a file for each range of digests.

    Tasks write the files; the driver gets one row for each (its name and least digest), one for SHARD keys.
    """
    spark = entries.sparkSession
    folder = f"{shared_dir(spark)}/urls-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if parts:
            part = pa.Table.from_batches(parts)
            digest = part.column("digest").to_numpy()
            uri = f"{folder}/{uuid.uuid4().hex}"
            save(uri, DigestArray.encode(digest, part.column("key").to_pylist(), part.column("value").to_pylist()))
            yield pa.RecordBatch.from_pydict({"least": [int(digest.min())], "file": [uri]})

    rows = entries.select(F.xxhash64(F.col(key)).alias("digest"), F.col(key).alias("key"), F.col(value).alias("value"))
    shards = rows.count() // SHARD + 1
    told = sorted(rows.repartitionByRange(shards, "digest").mapInArrow(write, "least long, file string").collect())
    return DigestList(np.array([r["least"] for r in told], np.int64), [r["file"] for r in told])


def url_index(rules: DataFrame) -> tuple[DigestList, DigestList]:
    """The arrays of rules (host, path, verdict): host -> lengths of its rules' paths, and host and path -> verdict.

    Hosts are lower-cased (A-Z); a null path is empty; rules with a null or empty host or without a verdict are left
    out; of equal rules with several verdicts the greatest (block before allow) holds.
    """
    host = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    r = rules.select(host.alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> '' and verdict is not null")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    hosts = r.groupBy("host").agg(F.array_join(F.sort_array(F.collect_set(F.length("path"))).cast("array<string>"), ",").alias("lengths"))
    return digest_list(hosts, "host", "lengths"), digest_list(r.select(F.concat("host", "path").alias("key"), "verdict"), "key", "verdict")


def best_rules(hosts: list[str], paths: list[str], index: tuple[DigestList, DigestList]) -> tuple[list[str | None], list[str | None]]:
    """Of each url the longest rule that fits its host and path, and that rule's verdict; None without one."""
    by_host, by_rule = index
    known = sorted({h for h in hosts if h})
    suffixes = [(k, h[at:]) for k, h in enumerate(known) for at in [0, *(i + 1 for i, c in enumerate(h) if c == ".")]]
    lengths: dict[str, list[tuple[str, list[int]]]] = {}
    for (k, s), found in zip(suffixes, by_host.find([s for _, s in suffixes]), strict=True):
        if found is not None:
            lengths.setdefault(known[k], []).append((s, [int(x) for x in found.split(",")]))
    asked = [(i, s, s + p[:n]) for i, (h, p) in enumerate(zip(hosts, paths, strict=True)) for s, its in lengths.get(h, ()) for n in its if n <= len(p)]
    distinct = sorted({key for _, _, key in asked})
    verdicts = dict(zip(distinct, by_rule.find(distinct), strict=True))
    best: dict[int, tuple[int, int, str]] = {}
    for i, s, key in asked:
        if verdicts[key] is not None:
            best[i] = max(best.get(i, (-1, -1, "")), (len(key), len(s), key))
    rule = [best[i][2] if i in best else None for i in range(len(hosts))]
    return rule, [None if k is None else verdicts[k] for k in rule]


def judge_urls(docs: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of docs with host, path, rule and verdict of their urls.

    rules has host, path and verdict. A rule fits its host and all subdomains where the url's path starts with the
    rule's; the longest (host and path in code points; of equal ones that with the longer host) wins. rule is host and
    path in one string. Urls that no rule fits are in no list: rule null, verdict `default`.

    The rules are sorted arrays of 64-bit xxhash digests in files of the shared folder, a file for each range of
    digests, which tasks map into memory: no task holds the whole list, and urls are not shuffled. A url asks for each
    suffix of its host at a dot, then, for hosts that the list has, for its path cut to the lengths of that host's rules.

    Null, empty and malformed urls have empty host and path, and no rule fits those; long urls are read whole;
    repeated rows are judged alike; an empty table gives no row, empty rules the default for all; columns named host,
    path, rule or verdict are replaced, all others kept.
    """
    index = url_index(rules)
    kept = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)], url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", rule string, verdict string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict = best_rules(b.column("host").to_pylist(), b.column("path").to_pylist(), index)
            names = [*b.schema.names, "rule", "verdict"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array([v or default for v in verdict], pa.string())], names=names)

    return rows.mapInArrow(judge, schema).toDF(*kept, *ADDED)
