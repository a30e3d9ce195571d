"""Hedonic regressions from sums of products: Spark adds them up, the driver solves one system of the design's width."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.sources.staging import placed, staged


@dataclass
class Fit:
    """names, coefficients, robust (HC1) standard errors, n, r2 and the mean squared error."""

    names: list[str]
    beta: np.ndarray
    errors: np.ndarray
    n: int
    r2: float
    mse: float

    def index(self, base: str, base_value: float = 100.0) -> dict[str, float]:
        """The time-dummy index by period, the base period included."""
        out = {base: base_value}
        return out | {n.removeprefix("t:"): float(base_value * np.exp(b)) for n, b in zip(self.names, self.beta, strict=True) if n.startswith("t:")}


def design(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = "period", log: bool = True, order: Sequence[str] = ()) -> tuple[DataFrame, list[str], str | None]:
    """Rows (y, x array) of complete cases: constant, (logged) characteristics, drop-first dummies, period dummies.

    Levels of the categorical columns are collected; they are few by nature. The complete cases are written once, as
    levels, periods and sums all read them, and with an order again, with their number in it (at). Returns the rows,
    the names, the base period.
    """
    need = ["price", *continuous, *categorical, *([time] if time else [])]
    d = df.dropna(subset=need).filter("price > 0")
    for c in continuous if log else ():
        d = d.filter(F.col(c) > 0)
    d = staged(d, "design")
    if order:
        d = placed(d, list(order), "at")
    cols: list[tuple[str, Column]] = [("const", F.lit(1.0))]
    cols += [(c, F.ln(c) if log else F.col(c).cast("double")) for c in continuous]
    for c in categorical:
        levels = sorted(r[0] for r in d.select(c).distinct().collect())
        cols += [(f"{c}={v}", (F.col(c) == v).cast("double")) for v in levels[1:]]
    base = None
    if time:
        periods = sorted(r[0] for r in d.select(time).distinct().collect())
        base = str(periods[0]) if periods else None
        cols += [(f"t:{p}", (F.col(time) == F.lit(p)).cast("double")) for p in periods[1:]]
    rows = d.select(F.ln("price").alias("y"), F.array(*[c for _, c in cols]).alias("x"), *d.columns)
    return rows, [n for n, _ in cols], base


def moments(rows: DataFrame, k: int, by: str | None = None, scale: Column | None = None) -> dict:
    """x'x, x'y, y'y, sum y and n, whole or by a key, in one pass: tasks add up the products of their rows, Spark those of the tasks.

    x'x and x'y are weighed by scale.
    """
    key = F.lit(0) if by is None else F.col(by)
    r = rows.select(key.alias("key"), F.col("y").cast("double").alias("y"), (F.lit(1.0) if scale is None else scale).alias("w"), "x")
    kind = r.schema["key"].dataType.simpleString()

    def run(batches):
        sums: dict = {}
        key_type = None
        for batch in batches:
            code = batch.column(0).dictionary_encode(null_encoding="encode")
            key_type = code.dictionary.type
            at = code.indices.to_numpy(zero_copy_only=False)
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
            for i, name in enumerate(code.dictionary.to_pylist()):
                mine = at == i
                held = sums.setdefault(name, np.zeros(k * k + k + 3))
                z, v, u = x[mine], y[mine], w[mine]
                held[: k * k] += (z.T @ (z * u[:, None])).ravel()
                held[k * k : k * k + k] += z.T @ (u * v)
                held[k * k + k :] += len(v), v.sum(), (v * v).sum()
        for name, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), key_type), pa.array(at.astype(np.int32)), pa.array(held[at])], ["key", "at", "v"])

    out: dict = {}
    for e in r.mapInArrow(run, f"key {kind}, at int, v double").groupBy("key", "at").agg(F.sum("v").alias("v")).collect():
        out.setdefault(e["key"], np.zeros(k * k + k + 3))[e["at"]] = e["v"]
    return {key: {"xx": s[: k * k].reshape(k, k), "xy": s[k * k : k * k + k], "n": int(s[-3]), "y": float(s[-2]), "yy": float(s[-1])} for key, s in out.items()}


def fit(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = "period", log: bool = True) -> tuple[Fit, str | None]:
    """Least squares of the log price with robust errors; refuses designs with no more rows than columns."""
    rows, names, base = design(df, continuous, categorical, time, log)
    rows = rows.select("y", "x")
    m = moments(rows, len(names))[0]
    if m["n"] <= len(names):
        raise ValueError(f"{m['n']} complete rows for {len(names)} columns")
    inverse = np.linalg.pinv(m["xx"])
    beta = inverse @ m["xy"]
    rss = float(m["yy"] - beta @ m["xy"])
    b = F.array(*[F.lit(float(x)) for x in beta])
    residual = F.col("y") - F.aggregate(F.zip_with("x", b, lambda x, c: x * c), F.lit(0.0), lambda a, x: a + x)
    meat = moments(rows, len(names), scale=residual**2)[0]["xx"]
    n, k = m["n"], len(names)
    errors = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse) * n / (n - k), 0))
    tss = m["yy"] - m["y"] ** 2 / n
    return Fit(names, beta, errors, n, 1 - rss / tss if tss > 0 else float("nan"), rss / (n - k)), base


def hedonic_index(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = ()) -> DataFrame:
    """period, index of the time-dummy regression, first period = 100."""
    found, base = fit(df, continuous, categorical)
    rows = sorted(found.index(base).items())
    return df.sparkSession.createDataFrame([(p, v) for p, v in rows], "period string, index double").select(F.to_date("period").alias("period"), "index")


def shortest_solution(xx: np.ndarray, xy: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """The coefficients of least norm: what is collinear is found with columns of length 1, so rare dummies are not taken for it."""
    scale = np.sqrt(np.diag(xx))
    values, vectors = np.linalg.eigh(xx / np.outer(scale, scale))
    live = values > tolerance * values[-1]
    beta = (vectors[:, live] / values[live]) @ (vectors[:, live].T @ (xy / scale)) / scale
    free = vectors[:, ~live] / scale[:, None]
    return beta - free @ np.linalg.lstsq(free, beta, rcond=None)[0] if free.size else beta


def prediction_errors(rows: DataFrame, betas: dict[int, np.ndarray]) -> dict:
    """n, sum of squared errors of log prices and sum of absolute errors in per cent of prices by fold, in one pass.

    rows has fold, y, price and x; a fold's rows are predicted by its coefficients, those of other folds left out.
    """
    r = rows.select(F.col("fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y"), F.col("price").cast("double").alias("price"), "x")

    k = len(next(iter(betas.values())))

    def run(batches):
        sums: dict = {}
        for batch in batches:
            fold, y, price = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(y), k)
            for f in set(fold.tolist()) & set(betas):
                mine = fold == f
                predicted = x[mine] @ betas[f]
                held = sums.setdefault(f, np.zeros(3))
                held += mine.sum(), ((predicted - y[mine]) ** 2).sum(), (np.abs(np.exp(predicted) - price[mine]) / price[mine] * 100).sum()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), *[pa.array([s[i] for s in sums.values()]) for i in range(3)]], ["fold", "n", "squares", "percent"])

    found = r.mapInArrow(run, "fold int, n double, squares double, percent double").groupBy("fold").agg(*[F.sum(c).alias(c) for c in ("n", "squares", "percent")])
    return {e["fold"]: np.array([e["n"], e["squares"], e["percent"]]) for e in found.collect()}


def cross_validate(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), folds: int = 5, key: Column | None = None) -> DataFrame:
    """fold, n, rmse (of log prices) and mape (per cent of prices) out of sample; rmse_transformed, mape_pct, folds of all together.

    Folds, no more than rows, are dealt in turn over the complete cases in order of period and property, or by the key.
    A fold's model is that of the sums of all other folds, so data are summed once; a second pass predicts. Columns that
    are zero in all other folds are left out of the model. A fold whose other folds have no more rows than the design
    has columns is not predicted and counts in no error: its own are null, as are those of all if no fold is predicted.
    Raises where a price or characteristic is infinite.
    """
    order = ["period", "property_id", "price", *continuous, *categorical] if key is None else []
    rows, names, _ = design(df, continuous, categorical, order=order)
    if key is None:
        folds = max(min(folds, rows.count()), 1)
    rows = rows.withColumn("fold", F.pmod(F.col("at") if key is None else key, F.lit(folds)))
    parts = moments(rows.select("y", "x", "fold"), len(names), by="fold")
    if not all(np.isfinite(p["yy"]) and np.isfinite(p["xx"]).all() for p in parts.values()):
        raise ValueError("prices and characteristics must be finite")
    betas = {}
    for f in parts:
        rest = [p for g, p in parts.items() if g != f]
        if sum(p["n"] for p in rest) <= len(names):
            continue
        xx, xy = sum(p["xx"] for p in rest), sum(p["xy"] for p in rest)
        some = np.flatnonzero(np.diag(xx))
        betas[int(f)] = np.zeros(len(names))
        betas[int(f)][some] = shortest_solution(xx[np.ix_(some, some)], xy[some])
    errors = prediction_errors(rows, betas) if betas else {}

    def means(e):
        return (float(np.sqrt(e[1] / e[0])), float(e[2] / e[0])) if e is not None else (None, None)

    whole = (*means(sum(errors.values()) if errors else None), len(parts))
    out = [(int(f), int(m["n"]), *means(errors.get(int(f))), *whole) for f, m in sorted(parts.items())]
    return df.sparkSession.createDataFrame(out, "fold int, n long, rmse double, mape double, rmse_transformed double, mape_pct double, folds int")


# --- replacements ---


def quality_ratio(method: str, old: Column, new: Column, **given: Column) -> Column:
    """The quality ratio of a replacement: new over old quality, by which the new price is divided.

    overlap: new over old price where both are sold; link: new over old, so no change shows; targeted: what the
    peers' mean change leaves; direct: 1; quantity: new over old size; option: old price with the option's value.
    """
    if method in ("overlap", "link"):
        return new / old
    if method == "targeted":
        return (new / old) / given["peer_relative"]
    if method == "direct":
        return F.lit(1.0)
    if method == "quantity":
        return given["new_quantity"] / given["old_quantity"]
    if method == "option":
        return (old + given["option_value"] * given.get("share", F.lit(1.0))) / old
    raise ValueError(f"unknown method {method}")


def apply_ledger(panel: DataFrame, ledger: DataFrame, price: str = "price") -> DataFrame:
    """panel with replacements carried out: ledger has old_item, new_item, period, quality_ratio.

    From its period on a new item's rows continue the old item at price / ratio; older rows of the new and newer rows
    of the old item go. Chains of replacements are resolved first, by following old items to the first of the chain;
    the ledger is one row for each replacement, so this is a few joins of small tables.
    """
    step = ledger.select(F.col("new_item").alias("item_id"), F.col("old_item").alias("root"), F.col("period").alias("since"), F.col("quality_ratio").alias("ratio"))
    for _ in range(16):
        up = step.select(F.col("item_id").alias("root"), F.col("root").alias("root2"), F.col("ratio").alias("ratio2"))
        joined = step.join(up, "root", "left")
        if joined.filter("root2 is not null").isEmpty():
            break
        step = joined.select("item_id", F.coalesce("root2", "root").alias("root"), "since", (F.col("ratio") * F.coalesce("ratio2", F.lit(1.0))).alias("ratio"))
    ends = ledger.groupBy(F.col("old_item").alias("item_id")).agg(F.min("period").alias("until"))
    p = panel.join(step, "item_id", "left").join(ends, "item_id", "left")
    p = p.filter((F.col("since").isNull() | (F.col("period") >= F.col("since"))) & (F.col("until").isNull() | (F.col("period") < F.col("until"))))
    out = p.withColumn("replaced_item_id", F.when(F.col("root").isNotNull(), F.col("item_id")))
    out = out.withColumn(price, F.col(price) / F.coalesce("ratio", F.lit(1.0))).withColumn("item_id", F.coalesce("root", "item_id"))
    return out.drop("root", "since", "ratio", "until")

