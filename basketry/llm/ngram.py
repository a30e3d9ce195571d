"""Language-model scores from an Elias-Fano n-gram trie."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.eliasfano import Level, dequantise, open_level, pack, save, unpack
from basketry.llm.store import bucketed, discard, remove, shared_dir, staged
from basketry.llm.words import as_bytes, hashed_words, in_chunks, mix, slices

END = np.uint64(0x454E44)  # the hash of the token that ends a text
BLOCK = 6 << 20  # bytes of text that are counted and scored together
SHARD = 1_500_000  # tokens of the contexts of each shard of a level
MASK = np.uint64(0xFFFFFFFF)


def corpus_blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """Texts as blocks of tokens: block, ids, held, n (tokens of each text), tokens (places in vocab), vocab (hashes)."""

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        for batch in (part for b in batches for part in slices(b, 2048)):
            texts = as_bytes(batch.column(2))
            begin, hashes, sizes, size = 0, [], [], 0
            for a, b in in_chunks(texts):
                h, offsets = hashed_words(texts[a:b])
                hashes.append(np.insert(h, offsets[1:], END))
                sizes.append(np.diff(offsets) + 1)
                size += sum(map(len, texts[a:b]))
                if size >= BLOCK or b == len(texts):
                    vocab, tokens = np.unique(np.concatenate(hashes), return_inverse=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([(part << 32) | made], pa.int64()),
                            pa.ListArray.from_arrays(pa.array([0, b - begin], pa.int32()), batch.column(0).slice(begin, b - begin)),
                            pa.ListArray.from_arrays(pa.array([0, b - begin], pa.int32()), batch.column(1).slice(begin, b - begin)),
                            pa.array([np.concatenate(sizes)], pa.list_(pa.int32())),
                            pa.array([pack(tokens.astype(np.uint32))], pa.binary()),
                            pa.array([pack(vocab, True)], pa.binary()),
                            pa.array([len(vocab)], pa.int64()),
                        ],
                        ["block", "ids", "held", "n", "tokens", "vocab", "words"],
                    )
                    begin, hashes, sizes, size = b, [], [], 0
                    made += 1

    source = docs.select(F.col(id_col), held, F.col(text_col).cast("string"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, n array<int>, tokens binary, vocab binary, words long")


@dataclass
class Runs:
    """How a level's shards share its contexts: runs of the numbers of the level below.

    A run is one shard; but a context with more than SHARD tokens is a run of its own, in `parts` shards by word.
    """

    first: np.ndarray  # the least number of each run
    source: np.ndarray  # the shard of the level below that gave the run's numbers
    parts: np.ndarray
    base: np.ndarray  # the run's first shard

    def run_of(self, context: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, context, side="right") - 1

    def homes(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        run = self.run_of(context)
        return self.base[run] + (mix(word) % self.parts[run].astype(np.uint64)).astype(np.int64)


@dataclass
class Shape:
    """What all tasks know of the model: sums over shards, and where each shard's numbers begin."""

    order: int
    folder: str
    words: int  # shards of the first level
    prior: float
    least: tuple[int, ...]  # the counts from which a level keeps an n-gram; the last holds for further levels
    total: int = 0
    known: int = 0
    starts: list[np.ndarray] = field(default_factory=list)  # of each level from the first
    runs: list[Runs] = field(default_factory=list)  # of each level from the second
    #: Of each level from the second the contexts in several shards, and their weights of the shorter context.
    hot: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def kept(self, m: int) -> int:
        return max(2, self.least[min(m, len(self.least)) - 1])

    def file(self, m: int, shard: int) -> str:
        return f"{self.folder}/level-{m}/{shard}"


class Asked:
    """A block's questions to level m: its distinct (context, word) pairs and contexts, by shard."""

    def __init__(self, context: np.ndarray, word: np.ndarray, can: np.ndarray, runs: Runs):
        self.contexts = np.unique(context[context > 0])
        rank = np.searchsorted(self.contexts, context[can]).astype(np.uint64)
        pairs, where = np.unique((rank << np.uint64(32)) | word[can], return_inverse=True)
        self.where = np.full(len(context), -1, np.int64)  # each token's pair
        self.where[can] = where
        self.rank, self.word = (pairs >> np.uint64(32)).astype(np.int64), pairs & MASK
        run = runs.run_of(self.contexts)
        self.run, self.split = run, runs.parts[run] > 1
        home = runs.homes(self.contexts[self.rank], self.word) if len(pairs) else np.zeros(0, np.int64)
        keys = ((self.contexts - runs.first[run])[self.rank] << np.uint64(32)) | self.word if len(pairs) else pairs
        its = np.where(self.split, -1, runs.base[run])  # contexts in several shards have their weight from the driver
        by_pair, by_context = np.argsort(home, kind="stable"), np.argsort(its, kind="stable")
        shards = np.unique(np.concatenate((home, its[its >= 0])))
        pair_at, pair_end = np.searchsorted(home[by_pair], shards), np.searchsorted(home[by_pair], shards, side="right")
        its_at, its_end = np.searchsorted(its[by_context], shards), np.searchsorted(its[by_context], shards, side="right")
        #: (shard, places of its pairs, their keys, places of its contexts)
        self.shards = [(s, by_pair[a:b], keys[by_pair[a:b]], by_context[c:d]) for s, a, b, c, d in zip(shards.tolist(), pair_at, pair_end, its_at, its_end, strict=True)]


class Block:
    """A block's tokens with what the levels so far answered: each token's probability, n-gram and context."""

    def __init__(self, row: dict, shape: Shape, levels: int):
        self.ids, self.held, self.sizes = row["ids"], np.array(row["held"], bool), np.array(row["n"], np.int64)
        self.tokens = unpack(row["tokens"], np.uint32).astype(np.int64)
        first = np.zeros(len(self.tokens), bool)
        first[np.cumsum(self.sizes)[:-1]] = True
        first[:1] = True
        self.train = np.repeat(~self.held, self.sizes)
        answers = sorted(row["answers_1"], key=lambda x: x["shard"])
        counts = np.concatenate([unpack(x["a"], np.uint64) for x in answers]).astype(np.int64)
        words = np.zeros(len(counts), np.uint64)  # numbers from 1 of words counted twice, else 0
        words[counts >= shape.kept(1)] = np.concatenate([unpack(x["b"], np.uint32, True).astype(np.uint64) + shape.starts[0][x["shard"]] for x in answers])
        self.counts, self.word = counts[self.tokens], words[self.tokens]
        self.base = (self.counts + 0.1) / (shape.total + 0.1 * (shape.known + 1))
        self.p = self.base
        end = self.tokens[np.cumsum(self.sizes) - 1][0]
        #: The number of the n-gram that ends at each token in the last level, and of its context in the next.
        self.gram, self.context = self.word, words[np.where(first, end, np.roll(self.tokens, 1))]  # a text begins after an end
        for m in range(2, levels + 1):
            found = {x["shard"]: x for x in row[f"answers_{m}"] or ()}
            asked = self.ask(m, shape)
            number, code = np.zeros(len(asked.rank), np.uint64), np.zeros(len(asked.rank), np.uint16)
            back = np.ones(len(asked.contexts))
            for s, mine, _, its in asked.shards:
                code[mine] = unpack(found[s]["a"], np.uint16)
                if m < shape.order:
                    number[mine[code[mine] > 0]] = unpack(found[s]["b"], np.uint32, True).astype(np.uint64) + shape.starts[m - 1][s]
                back[its] = dequantise(unpack(found[s]["c"], np.uint16))
            hot, weight = shape.hot[m - 2]
            if asked.split.any():
                back[asked.split] = weight[np.searchsorted(hot, asked.contexts[asked.split])]
            known = self.context > 0
            self.p = self.p.copy()
            self.p[known] *= back[np.searchsorted(asked.contexts, self.context[known])]
            there = asked.where >= 0
            self.p[there] += dequantise(code)[asked.where[there]]
            self.gram = np.zeros(len(self.tokens), np.uint64)
            self.gram[there] = number[asked.where[there]]
            self.context = np.where(first, 0, np.roll(self.gram, 1)).astype(np.uint64)

    def ask(self, m: int, shape: Shape) -> Asked:
        """What level m is asked: it can only have those n-grams of which the level below has both parts."""
        return Asked(self.context, self.word, (self.context > 0) & (self.gram > 0), shape.runs[m - 2])


def _rows(batches):
    for batch in batches:
        for at in range(batch.num_rows):  # a block at a time
            yield batch.slice(at, 1).to_pylist()[0]


def _ask_words(shards: int):
    def run(batches):
        for row in _rows(batches):
            vocab, tokens = unpack(row["vocab"], np.uint64, True), unpack(row["tokens"], np.uint32)
            counts = np.bincount(tokens, np.repeat(~np.array(row["held"], bool), row["n"]), len(vocab)).astype(np.uint32)
            home = ((vocab >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
            some, cut = np.unique(home, return_index=True)
            for s, a, b in zip(some.tolist(), cut, [*cut[1:], len(vocab)], strict=True):
                yield pa.RecordBatch.from_pylist([{"shard": s, "block": row["block"], "keys": pack(vocab[a:b], True), "counts": pack(counts[a:b]), "contexts": None}], ASKED)

    return run


def _ask_level(shape: Shape, m: int):
    def run(batches):
        for row in _rows(batches):
            block = Block(row, shape, m - 1)
            asked = block.ask(m, shape)
            there = asked.where >= 0
            counts = np.bincount(asked.where[there], block.train[there], len(asked.rank)).astype(np.uint32)
            first = shape.runs[m - 2].first
            for s, mine, keys, its in asked.shards:
                others = np.setdiff1d(asked.contexts[its] - first[asked.run[its]], keys >> np.uint64(32))  # the rest stands in the keys
                yield pa.RecordBatch.from_pylist([{"shard": s, "block": row["block"], "keys": pack(keys, True), "counts": pack(counts[mine]), "contexts": pack(others, True)}], ASKED)

    return run


ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("contexts", pa.binary())])
ASKED_SQL = "shard long, block long, keys binary, counts binary, contexts binary"
ANSWER = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("size", pa.int64()), ("known", pa.int64()), ("total", pa.int64()), ("mass", pa.float64())])
ANSWER_SQL = "shard long, block long, a binary, b binary, c binary, size long, known long, total long, mass double"


def cut_runs(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first entry, parts) of runs of entries with about `most` tokens each; an entry with more is alone, in parts."""
    if not len(counts):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    hot, piece = counts > most, np.cumsum(counts) // most
    begins = np.ones(len(counts), bool)
    begins[1:] = (piece[1:] != piece[:-1]) | hot[1:] | hot[:-1]
    at = np.flatnonzero(begins)
    return at.astype(np.uint32), np.where(hot[at], -(-counts[at] // most), 1).astype(np.uint32)


def _merge(m: int, shape: Shape):
    """A shard's function: sum the blocks' counts, write the level's shard, map it into memory and answer every block.

    The row of block -1 tells of the shard itself: size (numbered entries), known and total counts, the runs of the
    next level (a, b), and, for a shard of a context in parts, its probability mass.
    """

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        blocks = table.column("block").to_pylist()
        keys = [unpack(x.as_py(), np.uint64, True) for x in table.column("keys")]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([unpack(x.as_py(), np.uint32) for x in table.column("counts")]), len(every)).astype(np.int64)
        kept = total >= shape.kept(m)
        at, parts = cut_runs(total[kept], SHARD) if m < shape.order else (np.zeros(0, np.uint32),) * 2
        own = {"shard": shard, "block": -1, "size": int(kept.sum()), "known": int((total > 0).sum()), "total": int(total.sum()), "a": pack(at, True), "b": pack(parts)}
        if m == 1:
            save(shape.file(1, shard), Level.encode(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), total[kept]))
            place, code, level = np.where(kept, np.cumsum(kept), 0).astype(np.uint32), total.astype(np.uint64), None
        else:
            runs = shape.runs[m - 2]
            mine = int(np.searchsorted(runs.base, shard, side="right")) - 1
            source = int(runs.source[mine])
            below = open_level(shape.file(m - 1, source)).counts
            context, pick = np.unique((every >> np.uint64(32))[kept], return_inverse=True)
            weight = below[context.astype(np.int64) + int(runs.first[mine]) - int(shape.starts[m - 2][source]) - 1].astype(float) + shape.prior
            p = total[kept] / weight[pick]
            mass = np.bincount(pick, p, len(context))
            save(shape.file(m, shard), Level.encode(every[kept], p, np.maximum(1 - mass, shape.prior / weight), total[kept] if m < shape.order else total[:0]))
            own["mass"] = float(mass.sum())  # of one context if this is a part
            own["total"] = int(weight[0] - shape.prior) if len(weight) else 0
            level = open_level(shape.file(m, shard))
            found = level.find(every)
            place = (found + 1).astype(np.uint32)
            code = np.where(found >= 0, level.codes[found], 0).astype(np.uint16) if level.n else np.zeros(len(every), np.uint16)
        out = [own]
        for i, its in enumerate(np.split(inverse, np.cumsum([len(k) for k in keys])[:-1])):
            # Numbers go only with what the next level can use.
            numbers = place[its][place[its] > 0] if m == 1 or m < shape.order else place[:0]
            answer = {"shard": shard, "block": blocks[i], "a": pack(code[its]), "b": pack(numbers, True)}
            if level is not None and runs.parts[mine] == 1:
                answer["c"] = pack(level.back_codes(np.union1d(keys[i] >> np.uint64(32), unpack(table.column("contexts")[i].as_py(), np.uint64, True))))
            elif level is not None:
                answer["c"] = pack(np.zeros(0, np.uint16))
            out.append(answer)
        return pa.Table.from_pylist(out, ANSWER)

    return run


def _score(shape: Shape, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches):
        for row in _rows(batches):
            block = Block(row, shape, shape.order)
            begins = np.cumsum(block.sizes) - block.sizes
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(block.ids, id_type),
                    pa.array(block.held),
                    pa.array(block.sizes),
                    pa.array(np.add.reduceat((block.counts > 0).astype(np.int64), begins)),
                    pa.array(np.full(len(begins), shape.total)),
                    pa.array(np.add.reduceat(np.log10(block.base), begins)),
                    pa.array(np.add.reduceat(np.log10(block.p), begins)),
                ],
                schema=schema,
            )

    return run


def score_texts(docs: DataFrame, held: Column, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3, prior: float = 4.0, least: tuple[int, ...] = (1, 2, 2), trie: str | None = None) -> DataFrame:
    """log10 probabilities of all texts under an n-gram model of those that are not held out.

    Tokens are words (runs of bytes other than white space, A-Z lower-cased) and one end for each text; the first word
    follows an end. The smoothed share of a word, (c + 0.1) / (N + 0.1 (V + 1)) from exact counts, is the first level.
    Level m has the n-grams of m tokens that were counted least[m - 1] times or more; one is asked for only if both its
    parts of m - 1 tokens are numbered, which takes a count of 2. A level stores c / (c(context) + prior) for an n-gram
    and what that leaves of 1 for its context, as 16-bit codes on a log scale: the probability of a word after a
    context is its stored share plus the context's weight times the probability after the shorter context.

    Levels are cut in shards by runs of contexts of about SHARD tokens, which lie in one shard of the level below, so
    that its counts are at hand; a context with more tokens is cut by word, and its weight is summed on the driver.
    Each shard is a file of the shared folder (eliasfano.Level): tasks that build a shard map it into memory and
    answer the blocks' questions by successor search. trie names a folder where these files stay; else they are
    deleted with the other half-way tables once the scores are written.

    Texts are packed in blocks of some megabytes, which count their own n-grams. What is shuffled are a block's
    distinct n-grams, once for each level, and the answers to them, once as well; a block and a shard exchange one row
    if they have an n-gram in common. The driver gets a few numbers a shard.

    Returns one row per row of docs: id_col, held_out, n_tokens, n_known (tokens counted in training), train_tokens,
    base_score, score, written to the shared folder. Null, empty and blank texts are an end alone; repeated rows are
    scored alike; null held counts as held out; an empty table gives no row; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    folder = trie or f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/trie"
    blocks = bucketed(corpus_blocks(docs, id_col, text_col, F.coalesce(held, F.lit(True))), "block", move=False)
    words = blocks.agg(F.sum("words")).first()[0] or 0
    shape = Shape(order, folder if "://" in folder else f"file://{folder.removeprefix('file:')}", int(words // SHARD) + 1, prior, least)
    source, answers = blocks.select("block", "ids", "held", "n", "tokens"), []
    for m in range(1, order + 1):
        if m == 1:
            asked = blocks.select("block", "held", "n", "tokens", "vocab").mapInArrow(_ask_words(shape.words), ASKED_SQL)
        else:
            asked = source.mapInArrow(_ask_level(shape, m), ASKED_SQL)
        found = staged(asked.groupBy("shard").applyInArrow(_merge(m, shape), ANSWER_SQL), f"level-{m}")
        told = sorted(found.filter("block = -1").select("shard", "size", "known", "total", "mass", "a", "b").collect(), key=lambda r: r["shard"])
        if m == 1:
            shape.total, shape.known = sum(r["total"] for r in told), sum(r["known"] for r in told)
        else:
            shape.hot.append(_hot_weights(shape, m, told))
        shards = (shape.words if m == 1 else int(shape.runs[-1].base[-1] + shape.runs[-1].parts[-1])) if m == 1 or len(shape.runs[-1].base) else 0
        sizes = np.zeros(shards + 1, np.int64)
        sizes[[r["shard"] + 1 for r in told]] = [r["size"] for r in told]
        shape.starts.append(np.cumsum(sizes)[:-1].astype(np.uint64))
        if m < order:
            shape.runs.append(_runs(told, shape.starts[-1]))
        own = found.filter("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "a", "b", "c")).alias(f"answers_{m}"))
        answers.append(bucketed(own, "block"))
        source = source.join(answers[-1].hint("merge"), "block", "left")
        discard(found)
    kind = docs.schema[id_col].dataType
    out = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = staged(source.mapInArrow(_score(shape, to_arrow_type(kind)), out).withColumnRenamed("id", id_col), "scores")
    discard(blocks, *answers)
    if not trie:
        remove(spark, [folder])
    return scores


def _runs(told: list, starts: np.ndarray) -> Runs:
    """The runs of the level above the shards that told of theirs; numbers begin at 1."""
    first, source, parts = [], [], []
    for r in told:
        at = unpack(r["a"], np.uint32, True)
        first.append(at.astype(np.uint64) + starts[r["shard"]] + np.uint64(1))
        source.append(np.full(len(at), r["shard"]))
        parts.append(unpack(r["b"], np.uint32).astype(np.int64))
    first, source, parts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, source, parts))
    return Runs(first.astype(np.uint64), source, parts, np.cumsum(parts) - parts)


def _hot_weights(shape: Shape, m: int, told: list) -> tuple[np.ndarray, np.ndarray]:
    """The contexts that level m has in parts, ascending, and what their n-grams in all parts leave of 1."""
    runs = shape.runs[m - 2]
    mass, total = np.zeros(len(runs.first)), np.zeros(len(runs.first))
    for r in told:
        run = int(np.searchsorted(runs.base, r["shard"], side="right")) - 1
        mass[run] += r["mass"] or 0.0
        total[run] = max(total[run], r["total"])
    hot = np.flatnonzero(runs.parts > 1)
    return runs.first[hot], np.maximum(1 - mass[hot], shape.prior / (total[hot] + shape.prior))
