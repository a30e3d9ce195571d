"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.store import discard, staged
from basketry.llm.words import as_bytes, hashed_words, in_chunks

#: ASCII punctuation counts as a space, so that a word at a sentence's end is the same term.
PLAIN = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def term_buckets(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash buckets of all words of all texts in turn, and where each text's begin."""
    h, offsets = hashed_words([t.translate(PLAIN) for t in texts])
    return (h >> np.uint64(64 - bits)).astype(np.int64), offsets


@dataclass
class ToxicityModel:
    """score = sigmoid(bias + sum of w over the document's features + sum of <v_i, v_j> over its pairs of features)."""

    bits: int
    features: np.ndarray  # hash buckets that count as features, sorted
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slot = np.full(1 << self.bits, -1, np.int32)
        slot[self.features] = np.arange(len(self.features))
        out = np.full(len(texts), self.bias)
        for a, b in in_chunks(texts):
            bucket, offsets = term_buckets(texts[a:b], self.bits)
            feature = slot[bucket]
            at = np.flatnonzero(feature >= 0)
            doc = np.searchsorted(offsets, at, side="right") - 1
            pair = np.unique(doc.astype(np.int64) * len(self.features) + feature[at])
            doc, feature = pair // max(1, len(self.features)), pair % max(1, len(self.features))
            z = np.bincount(doc, self.w[feature], b - a).astype(float)
            for k in range(self.v.shape[1]):
                f = self.v[feature, k]
                z += 0.5 * (np.bincount(doc, f, b - a) ** 2 - np.bincount(doc, f * f, b - a))
            out[a:b] += z
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def _begins(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def fit_terms(row: np.ndarray, col: np.ndarray, n: int, k: int, y: np.ndarray, rank: int, rounds: int, l2: float, seed: int, l1: float = 0.25, l2_pairs: float = 0.02) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, linear weights and factors of a factorization machine, from the places (row, col) of the ones, sorted by row.

    Proximal gradient steps with momentum on the mean log loss plus l2 / 2 |w|^2 + l2_pairs / 2 |v|^2 + l1 / n |w|:
    the evidence for a weight has to exceed l1 rows. A term's step is set by the number of its rows. Where a step
    makes the sum worse it is undone and halved. First the weights move and then factors as well, each for rounds / 2
    steps at most, or until ten steps gain under a thousandth (factors begin near 0, where they gain
    little at first, so they get sixty steps).
    """
    y = np.asarray(y, float)
    row, col = row.astype(np.int32), col.astype(np.int32)
    by = np.argsort(col, kind="stable")
    row_by_col = row[by]
    col_at = _begins(col[by])
    cols = col[by[col_at]]
    del by
    row_at = _begins(row)
    rows = row[row_at]

    def over(values: np.ndarray, place: np.ndarray, at: np.ndarray, which: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(values), size), np.float32)
        for one, into in zip(values, out, strict=True):  # one at a time bounds the temporary array
            into[which] = np.add.reduceat(one[place], at) if len(at) else 0
        return out

    share = float(y.mean())
    spread = np.bincount(col, minlength=k) * share * (1 - share)
    pace = np.vstack([n / (spread + 5)] + [n / (spread + 50)] * rank).astype(np.float32)
    ridge = np.array([l2] + [l2_pairs] * rank, np.float32)[:, None]
    p = np.zeros((1 + rank, k), np.float32)
    p[1:] = np.random.default_rng(seed).normal(0, 0.005, (rank, k))
    b, lr, past = float(np.log(share / (1 - share))), 0.1, []
    move, best = np.zeros_like(p), None
    pairs = t = 0
    while pairs < 2:
        q = over(p, col, row_at, rows, n)
        own = over((p[1:] ** 2).sum(0)[None], col, row_at, rows, n)[0]
        z = np.clip(b + q[0] + 0.5 * ((q[1:] ** 2).sum(0) - own), -40, 40).astype(float)
        goal = float(np.mean(np.logaddexp(0, z) - y * z) + l1 / n * np.abs(p[0]).sum() + 0.5 * (ridge * p**2).sum())
        if best is not None and not goal <= best[0] + 1e-6:
            goal, p, b, q, z = best
            lr, move = lr / 2, np.zeros_like(p)
        else:
            best, lr = (goal, p, b, q, z), lr * 1.1
        past.append(goal)
        t += 1
        if t >= max(1, rounds // 2) or (len(past) > 20 + 40 * pairs and past[-11] - goal < 1e-3 * goal and lr > 1e-3):
            pairs, t, past, move, lr = pairs + 1, 0, [], np.zeros_like(p), 0.1
        s = 1 / (1 + np.exp(-z))
        g = ((s - y) / n).astype(np.float32)
        d = over(np.vstack([g[None], q[1:] * g]), row_by_col, col_at, cols, k)
        d[1:] = d[1:] - d[0] * p[1:] if pairs else 0
        d[: 1 + rank * pairs] += (ridge * p)[: 1 + rank * pairs]
        new = p - lr * pace * d + 0.8 * move
        new[0] = np.sign(new[0]) * np.maximum(np.abs(new[0]) - lr * pace[0] * (l1 / n), 0)
        move, p = new - p, new
        b -= float(0.5 * (s - y).sum() / max((s * (1 - s)).sum(), 1e-3 * n))
    _, p, b, _, _ = best
    return b, p[0], np.ascontiguousarray(p[1:].T)


def fit_machine(x: np.ndarray, y: np.ndarray, rank: int, rounds: int, l2: float, seed: int) -> tuple[float, np.ndarray, np.ndarray]:
    """fit_terms for a table of 0/1 features."""
    row, col = np.nonzero(x)
    return fit_terms(row, col, *x.shape, y, rank, rounds, l2, seed)


def raw_scores(bias: float, w: np.ndarray, v: np.ndarray, row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
    """The machine's log odds of n rows from the places (row, col) of their ones."""
    z = bias + np.bincount(row, w[col], n)
    for k in range(v.shape[1]):
        f = v[col, k]
        z += 0.5 * (np.bincount(row, f, n) ** 2 - np.bincount(row, f * f, n))
    return z


def fold_odds(row: np.ndarray, col: np.ndarray, n: int, k: int, y: np.ndarray, mine: np.ndarray, fit) -> np.ndarray:
    """Log odds of the rows that are mine by a machine that fit() has made of the others."""
    number, at = np.cumsum(~mine, dtype=np.int32) - 1, np.cumsum(mine, dtype=np.int32) - 1
    there = ~mine[row]
    bias, w, v = fit(number[row[there]], col[there], int((~mine).sum()), y[~mine])
    seen = np.bincount(col[there], minlength=k) > 0
    return raw_scores(bias, w * seen, v * seen[:, None], at[row[~there]], col[~there], int(mine.sum()))


def cut_at(z: np.ndarray, y: np.ndarray, weight: np.ndarray, precision: float) -> float:
    """The log odds from which rows are called 1: of the cuts with that weighted precision the one with the fewest errors.

    Where no cut is that precise it is the most precise one.
    """
    order = np.argsort(-z, kind="stable")
    hit, called = np.cumsum((weight * y)[order]), np.cumsum(weight[order])
    last = np.append(np.diff(z[order]) < 0, True)  # equal scores fall on one side
    good = np.flatnonzero(last & (hit >= precision * called))
    at = good[np.argmin((called - 2 * hit)[good])] if len(good) else np.flatnonzero(last)[np.argmax((hit / called)[last])]
    below = z[order][at + 1] if at + 1 < len(z) else z[order][at] - 1
    return float((z[order][at] + below) / 2)


FITTED = pa.schema([("part", pa.int32()), ("bias", pa.float64()), ("y", pa.binary()), ("features", pa.binary()), ("w", pa.binary()), ("v", pa.binary()), ("z", pa.binary())])
FITTED_SQL = "part int, bias double, y binary, features binary, w binary, v binary, z binary"


def _fits(bits: int, folds: int, fit):
    """For each part of rows (part, y, terms, u), sorted by part, u, y and terms: the fit of all rows (part -1), or its fold's log odds."""

    def one(part: int, y: list[int], terms: list[bytes]) -> tuple:
        y, n = np.array(y, float), len(y)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(t) // 4 for t in terms])
        flat = np.frombuffer(b"".join(terms), np.uint32)
        terms.clear()
        there = np.zeros(1 << bits, bool)
        there[flat] = True
        features, col = np.flatnonzero(there), (np.cumsum(there, dtype=np.int32) - 1)[flat]
        del flat
        machine = lambda row, col, n, y: fit(row, col, n, len(features), y)
        if part >= 0:
            z = fold_odds(row, col, n, len(features), y, np.arange(n) % folds == part, machine)  # rows stand in the order of a hash
            return part, None, None, None, None, None, z.tobytes()
        bias, w, v = machine(row, col, n, y)
        return part, bias, y.tobytes(), features.astype(np.int64).tobytes(), w.tobytes(), v.tobytes(), None

    def run(batches):
        now, y, terms = None, [], []
        for batch in batches:
            for part, label, its in zip(*(batch.column(c).to_pylist() for c in ("part", "y", "terms")), strict=True):
                if part != now and terms:
                    yield pa.RecordBatch.from_pylist([dict(zip(FITTED.names, one(now, y, terms), strict=True))], schema=FITTED)
                    y, terms = [], []
                now = part
                y.append(label)
                terms.append(its)
        if terms:
            yield pa.RecordBatch.from_pylist([dict(zip(FITTED.names, one(now, y, terms), strict=True))], schema=FITTED)

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = 12_000,
    bits: int = 18,
    rank: int = 4,
    rounds: int = 200,
    l2: float = 1e-4,
    seed: int = 3,
    folds: int = 4,
    precision: float = 0.95,
) -> ToxicityModel:
    """Fit the machine to labelled documents: max_rows of them at most, half of either class, drawn by a hash of the id.

    Their terms are hashed in Spark tasks, and the machine is fitted in tasks too, one for the whole sample and one for
    each fold; the driver gets weights and log odds only. Features are all buckets of the sample, 2^bits at most. Where a score becomes 0.5 is settled inside the sample: each of its `folds`
    parts is scored by a machine fitted to the others, and the bias is set so that 0.5 is the cut with the fewest
    errors in these scores among those with the precision asked for, classes weighing what they do among all labelled
    rows. With fewer than 50 rows of a class the bias is set to the share of label 1 among all labelled rows instead.
    Null labels and ids are left out; an id counts once, with its greatest label and one of its texts that depends on
    them alone; with labels of one class or none the model is a constant.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.max("_y").alias("_y"))
    share = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    none = ToxicityModel(bits, np.zeros(0, np.int64), float(np.log((n1 + 0.5) / (n0 + 0.5))), np.zeros(0), np.zeros((0, rank)))
    if not n0 or not n1:
        return none
    u = F.shiftrightunsigned(F.xxhash64("_id", F.lit(seed)), 11).cast("double") / float(1 << 53)
    part = F.when(F.col("_y") == 1, F.lit(max_rows / 2 / n1)).otherwise(max_rows / 2 / n0)
    sample = known.filter(u < part).withColumn("_u", u).orderBy("_u", "_id").limit(max_rows)

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column(1))
            out = []
            for a, b in in_chunks(texts):
                bucket, offsets = term_buckets(texts[a:b], bits)
                out += [np.unique(bucket[offsets[i] : offsets[i + 1]]).astype(np.uint32).tobytes() for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["y", "terms", "u"])

    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = sample.join(texts, "_id").groupBy("_id", "_y", "_u").agg(F.min_by("_text", F.struct(F.xxhash64("_text"), "_text")).alias("_text"))
    rows = staged(found.select("_y", "_text", "_u").mapInArrow(run, "y int, terms binary, u double"), "sample")
    count = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        discard(rows)
        return none

    def fit(row, col, n, k, y):
        return fit_terms(row, col, n, k, y, rank, rounds, l2, seed)

    parts = [-1, *range(folds if min(count.values()) >= 50 else 0)]
    dealt = rows.withColumn("part", F.explode(F.array(*map(F.lit, parts)))).repartitionByRange(len(parts), "part").sortWithinPartitions("part", "u", "y", "terms")
    fits = {r["part"]: r for r in dealt.mapInArrow(_fits(bits, folds, fit), FITTED_SQL).collect()}
    discard(rows)
    whole = fits[-1]
    y, features, w = (np.frombuffer(whole[c], t) for c, t in (("y", float), ("features", np.int64), ("w", np.float32)))
    v, bias = np.frombuffer(whole["v"], np.float32).reshape(len(features), rank), whole["bias"]
    if len(parts) == 1:
        bias += np.log(n1 / n0) - np.log(y.mean() / (1 - y.mean()))
    else:
        z = np.zeros(len(y))
        for f in range(folds):
            z[f::folds] = np.frombuffer(fits[f]["z"])
        bias -= cut_at(z, y, np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum())), precision)
    return ToxicityModel(bits, features, float(bias), w, v)


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """The score of a text, 0 to 1; null and empty texts get the score of no feature."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.scores(as_bytes(column)), pa.float64())

    return score(text.cast("string"))


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by folds; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def score_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, **options) -> DataFrame:
    """Train on the labelled rows outside the held-out fold and score every document.

    Returns one row per row of docs: id_col, held_out, score, predicted (1 from 0.5). Only the text is an input of
    the score. Null and empty texts get the score of no feature, repeated rows get equal scores, an empty table
    gives no row, other columns are ignored. options go to train().
    """
    model = train(docs, labels.filter(~held_out(id_col, folds)), id_col=id_col, text_col=text_col, label_col=label_col, **options)
    out = docs.select(F.col(id_col), held_out(id_col, folds).alias("held_out"), toxicity(model, F.col(text_col)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
