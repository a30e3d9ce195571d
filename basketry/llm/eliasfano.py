"""Elias-Fano sequences, the trie levels built of them, and packed arrays for shuffles."""

from __future__ import annotations

import struct
import uuid

import numpy as np
import zstandard
from pyarrow import fs

STEPS = 1800  # quantisation steps for each factor of 10 in a probability


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as 16-bit codes on a log scale; 0 is 0. The relative error is under 0.07 %, the least 1e-36."""
    logs = np.minimum(np.rint(-np.log10(np.maximum(p, 1e-40)) * STEPS), 65_000) + 1
    return np.where(p > 0, np.maximum(logs, 1), 0).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1 - codes.astype(float)) / STEPS), 0.0)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """An unsigned array as bytes: differences if ascending, byte planes, compressed."""
    if ascending and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=dtype) if ascending else values


class EliasFano:
    """An ascending sequence of numbers: about 2 + log2(largest / n) bits for each.

    A number's low bits stand in one bit array; its high part is written in unary in another. The object reads both
    straight from a buffer, which may be a memory-mapped file.
    """

    def __init__(self, buffer, at: int = 0):
        self.n, self.low_bits, lows, highs = struct.unpack_from("<QQQQ", buffer, at)
        self.low = np.frombuffer(buffer, np.uint8, lows, at + 32)
        self.high = np.frombuffer(buffer, np.uint8, highs, at + 32 + lows)
        self.end = at + 32 + lows + highs
        self._starts: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        v = values.astype(np.uint64)
        low = b""
        if bits and n:
            one_by_one = np.arange(bits, dtype=np.uint64)
            parts = (((v[a : a + 16384, None] >> one_by_one) & np.uint64(1)).astype(np.uint8).ravel() for a in range(0, n, 16384))
            low = b"".join(np.packbits(part, bitorder="little").tobytes() for part in parts)
        low += b"\0" * 8
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(place[-1]) + 2 if n else 1, np.uint8)
        ones[place] = 1
        high = np.packbits(ones, bitorder="little").tobytes()
        return struct.pack("<QQQQ", n, bits, len(low), len(high)) + low + high

    def _lows(self, index: np.ndarray) -> np.ndarray:
        """The low bits of the numbers at index, read as a word at each bit place."""
        bits = int(self.low_bits)
        if not bits:
            return np.zeros(len(index), np.uint64)
        at = index.astype(np.int64) * bits
        word = np.zeros(len(index), np.uint64)
        first = at >> 3
        for k in range(8):
            word |= self.low[first + k].astype(np.uint64) << np.uint64(8 * k)
        return (word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)

    def starts(self) -> np.ndarray:
        """For each high part, the index of the first number that has it or a larger one."""
        if self._starts is None:
            ones = np.unpackbits(self.high, bitorder="little")
            zeros = np.flatnonzero(ones == 0)
            self._starts = np.concatenate(([0], zeros - np.arange(len(zeros))))
        return self._starts

    def get(self, index: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.starts(), index, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(index)

    def successor(self, values: np.ndarray) -> np.ndarray:
        """For each value the index of the first number that is equal or larger; n if there is none."""
        starts = self.starts()
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        inside = high < len(starts) - 1
        high = np.where(inside, high, 0)
        lo = np.where(inside, np.minimum(starts[high], self.n), self.n)
        hi = np.where(inside, np.minimum(starts[np.minimum(high + 1, len(starts) - 1)], self.n), self.n)
        want = values & np.uint64((1 << int(self.low_bits)) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)


class Level:
    """One level of an n-gram trie: for ascending (context, word) pairs their quantised smoothed probabilities.

    Contexts are one Elias-Fano sequence, the pointers to their first successors another, and the successors of all
    contexts a third, made ascending over the whole level by adding the context's rank times `words`. A pair is
    found by searching its context's successor in that sequence, relative to the context. Each context has the
    quantised weight of the shorter context besides, and each pair its count where a next level is built on it.
    """

    def __init__(self, buffer):
        self.words, self.n, counted = struct.unpack_from("<QQQ", buffer, 0)
        self.contexts = EliasFano(buffer, 24)
        self.pointers = EliasFano(buffer, self.contexts.end)
        self.successors = EliasFano(buffer, self.pointers.end)
        at = self.successors.end
        self.codes = np.frombuffer(buffer, np.uint16, self.n, at)
        self.backs = np.frombuffer(buffer, np.uint16, self.contexts.n, at + 2 * self.n)
        self.counts = np.frombuffer(buffer, np.float32, counted, at + 2 * (self.n + self.contexts.n))

    @staticmethod
    def encode(keys: np.ndarray, p: np.ndarray, backs: np.ndarray, counts: np.ndarray) -> bytes:
        """keys: ascending context << 32 | word; backs: one for each distinct context; counts may be empty."""
        context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        words = int(word.max()) + 1 if len(word) else 1
        distinct, first, rank = np.unique(context, return_index=True, return_inverse=True)
        pointers = np.concatenate((first, [len(keys)])).astype(np.uint64)
        ascending = rank.astype(np.uint64) * np.uint64(words) + word
        body = EliasFano.encode(distinct) + EliasFano.encode(pointers) + EliasFano.encode(ascending)
        return struct.pack("<QQQ", words, len(keys), len(counts)) + body + quantise(p).tobytes() + quantise(backs).tobytes() + counts.astype(np.float32).tobytes()

    def _rank(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of contexts among the level's, and which of them it has."""
        rank = self.contexts.successor(context)
        there = rank < self.contexts.n
        rank = np.where(there, rank, 0)
        return rank, there & (self.contexts.get(rank) == context) if self.contexts.n else there

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys in the level, -1 for those that it lacks."""
        if not self.n or not len(keys):
            return np.full(len(keys), -1, np.int64)
        word = keys & np.uint64(0xFFFFFFFF)
        rank, there = self._rank(keys >> np.uint64(32))
        there &= word < np.uint64(self.words)
        target = rank.astype(np.uint64) * np.uint64(self.words) + np.where(there, word, 0).astype(np.uint64)
        place = self.successors.successor(target)
        there &= place < self.n
        place = np.where(there, place, 0)
        there &= self.successors.get(place) == target
        return np.where(there, place, -1)

    def back_codes(self, contexts: np.ndarray) -> np.ndarray:
        """The codes of the contexts' weights of the shorter context; 1, the code of 1, where the level has none."""
        rank, there = self._rank(contexts)
        return np.where(there, self.backs[rank], 1).astype(np.uint16) if self.contexts.n else np.ones(len(contexts), np.uint16)


def save(uri: str, data: bytes) -> None:
    """Write a file of the shared folder under another name and move it: a task that runs twice leaves a whole file."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    made = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(made) as out:
        out.write(data)
    store.move(made, path)


def open_level(uri: str) -> Level:
    """A level in a file: mapped into memory where the file system is mounted, else read."""
    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return Level(np.memmap(path, np.uint8, "r"))
    with store.open_input_file(path) as file:
        return Level(file.read())
