"""Words and their hashes over many texts at once, for use inside Arrow tasks.

A word is a run of bytes other than space and \\x09-\\x0D; only A-Z are lower-cased. Hashes are 64-bit
tabulation hashes: one random number for each (place in the word, byte), summed, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG = 64  # bytes; longer words are hashed one by one
TABLE = np.random.default_rng(20240229).integers(0, 2**64, (LONG, 256), dtype=np.uint64)
TABLE[:, SPACE] = 0
TABLE = TABLE.ravel()
CHUNK = 1 << 19  # bytes of text hashed at once: bounds the temporary arrays


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in turn, and where each text's words begin (one more at the end)."""
    buf = b"\n".join(texts).lower() + b"\n"
    arr = np.frombuffer(buf, np.uint8)
    space = SPACE[arr]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    ends = ends[: len(starts)]
    lengths = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    offsets = np.searchsorted(starts, begins)
    if not len(starts):
        return np.zeros(0, np.uint64), offsets
    size = ends - starts
    place = np.arange(len(arr), dtype=np.int32)
    first = np.zeros(len(arr), np.int32)
    first[starts[1:]] = np.diff(starts)
    place[: starts[0]] = 0
    place[starts[0] :] -= starts[0] + np.cumsum(first[starts[0] :], dtype=np.int32)
    np.minimum(place, LONG - 1, out=place)
    h = np.add.reduceat(TABLE[(place << 8) | arr], starts)
    h = mix(h + size.astype(np.uint64))
    for k in np.flatnonzero(size > LONG):
        h[k] = xxhash.xxh3_64_intdigest(buf[starts[k] : ends[k]], seed=7)
    return h, offsets


def in_chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch, most: int = 512) -> Iterator:
    """A record batch a few rows at a time, so that long texts are not all held twice."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n-word windows of one run of word hashes; fewer words make one shingle, none make none."""
    if not len(h):
        return h
    k = min(n, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    return acc
