"""Small dense systems from aggregates: the heavy sums are made in tasks, the matrix has one row for each period or region."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers in a task's table of items x times.
DENSE = 1 << 21


def _over_items(cells: DataFrame, values: Sequence[str], part: Callable) -> tuple[list, np.ndarray, np.ndarray]:
    """The times in order, and what part() gives for items, summed over all of them: times x times numbers and times numbers.

    An item's cells (t, i and values) are gathered in one row, no longer than the times are many. Tasks add up the
    products of the items that they hold and pass on one matrix each; no pair of cells becomes a row.
    part(item, t, values, items, times) gets arrays of the cells of some items, these and the times numbered from 0.
    """
    kind = cells.schema["t"].dataType.simpleString()
    lists = cells.filter("i is not null").groupBy("i").agg(F.collect_list(F.struct("t", *values)).alias("c")).select("c")

    def run(batches):
        at: dict = {}
        xx, x, time_type = np.zeros((0, 0)), np.zeros(0), None
        for batch in batches:
            lengths = pc.list_value_length(batch.column(0)).to_numpy(zero_copy_only=False)
            rows = batch.column(0).flatten()
            code = rows.field("t").dictionary_encode()
            time_type = code.dictionary.type
            here = np.array([at.setdefault(k, len(at)) for k in code.dictionary.to_pylist()], np.int64)
            t, item = here[code.indices.to_numpy(zero_copy_only=False)], np.repeat(np.arange(len(lengths)), lengths)
            v = [rows.field(c).to_numpy(zero_copy_only=False) for c in values]
            if len(at) > len(x):
                grown = np.zeros((len(at), len(at)))
                grown[: len(x), : len(x)] = xx
                xx, x = grown, np.concatenate([x, np.zeros(len(at) - len(x))])
            step = max(1, DENSE // len(at)) if at else 1
            for first in range(0, len(lengths), step):  # bounds the table of items x times
                a, b = np.searchsorted(item, [first, first + step])
                more, side = part(item[a:b] - first, t[a:b], [c[a:b] for c in v], min(step, len(lengths) - first), len(at))
                xx += more
                x += side
        if at:
            keys, n = list(at), len(at)
            s = pa.array([k for k in keys for _ in keys] + keys, time_type)
            other = pa.array(keys * n + [None] * n, time_type)
            yield pa.RecordBatch.from_arrays([s, other, pa.array(np.concatenate([xx.ravel(), x]))], ["t", "s", "x"])

    found = lists.mapInArrow(run, f"t {kind}, s {kind}, x double").groupBy("t", "s").agg(F.sum("x").alias("x")).collect()
    times = sorted({r["t"] for r in found})
    at = {t: k for k, t in enumerate(times)}
    xx, x = np.zeros((len(times), len(times))), np.zeros(len(times))
    for r in found:
        if r["s"] is None:
            x[at[r["t"]]] = r["x"]
        else:
            xx[at[r["t"]], at[r["s"]]] = r["x"]
    return times, xx, x


def _table(item: np.ndarray, t: np.ndarray, v: np.ndarray, items: int, times: int) -> np.ndarray:
    return np.bincount(item * times + t, v, items * times).reshape(items, times)


def _dummy_part(item: np.ndarray, t: np.ndarray, values: list, items: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    y, w = values
    whole = np.bincount(item, w, items)
    mean = np.bincount(item, w * y, items) / whole
    share = _table(item, t, w, items, times)
    return np.diag(np.bincount(t, w, times)) - share.T @ (share / whole[:, None]), np.bincount(t, w * (y - mean[item]), times)


def _level_part(item: np.ndarray, t: np.ndarray, values: list, items: int, times: int) -> tuple[np.ndarray, np.ndarray]:
    p, q = values
    g = _table(item, t, q, items, times).T @ (_table(item, t, p * q, items, times) / np.bincount(item, q, items)[:, None])
    return g, np.bincount(t, p * q, times)


def two_way_dummies(cells: DataFrame, time: str = "t", item: str = "i", value: str = "y", weight: str = "w") -> tuple[list, np.ndarray]:
    """Least-squares time effects of value on time and item dummies, the first time as base, items partialled out.

    With item means removed the normal equations are A d = r, A[t,s] = [t=s] sum w - sum_i w_it w_is / w_i: one shuffle
    by item, and only times x times numbers reach the driver.
    """
    c = cells.select(F.col(time).alias("t"), F.col(item).alias("i"), F.col(value).cast("double").alias("y"), F.col(weight).cast("double").alias("w"))
    times, a, b = _over_items(c, ["y", "w"], _dummy_part)
    effects = np.zeros(len(times))
    if len(times) > 1:
        effects[1:] = np.linalg.lstsq(a[1:, 1:], b[1:], rcond=None)[0]
    return times, effects


def fixed_point_levels(cells: DataFrame, time: str = "t", item: str = "i", tolerance: float = 1e-12, most: int = 10_000) -> tuple[list, np.ndarray]:
    """Geary-Khamis levels, the first time as 1, from price p and quantity q.

    With x = 1 / level, V_t x_t = sum_s G[t,s] x_s, G[t,s] = sum_i q_it p_is q_is / Q_i: one shuffle by item, the
    iteration is over times only.
    """
    c = cells.select(F.col(time).alias("t"), F.col(item).alias("i"), F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q"))
    times, g, v = _over_items(c, ["p", "q"], _level_part)
    x = np.ones(len(times))
    for _ in range(most):
        new = g @ x / v
        new /= new[0]
        if np.max(np.abs(new - x)) < tolerance:
            x = new
            break
        x = new
    return times, x[0] / x


def ordinary(moments: dict[tuple[str, str], float], names: list[str], target: str) -> np.ndarray:
    """Coefficients from sums of products."""
    xx = np.array([[moments[a, b] for b in names] for a in names])
    return np.linalg.pinv(xx) @ np.array([moments[a, target] for a in names])


def dummy_residuals(cells: DataFrame, effects: DataFrame) -> DataFrame:
    """t, n, residual: what is left of the normal equations of time effects (t, effect) in cells (t, i, y, w), items partialled out.

    0 everywhere where the effects are least squares.
    """
    c = cells.filter("i is not null").join(F.broadcast(effects), "t").withColumn("r", F.col("y") - F.col("effect"))  # one row a time
    own = Window.partitionBy("i")  # a row a time at most
    return c.withColumn("m", F.sum(F.col("w") * F.col("r")).over(own) / F.sum("w").over(own)).groupBy("t").agg(F.count("*").alias("n"), F.abs(F.sum(F.col("w") * (F.col("r") - F.col("m")))).alias("residual"))


def fixed_point_residuals(cells: DataFrame, levels: DataFrame) -> DataFrame:
    """t, n, residual: how far levels (t, level) are from value over quantities at average prices, in cells (t, i, p, q); 0 at the fixed point."""
    c = cells.filter("i is not null").join(F.broadcast(levels), "t")  # one row a time
    own = Window.partitionBy("i")  # a row a time at most
    return c.withColumn("b", F.sum(F.col("p") * F.col("q") / F.col("level")).over(own) / F.sum("q").over(own)).groupBy("t").agg(F.count("*").alias("n"), F.abs(F.max("level") * F.sum(F.col("b") * F.col("q")) / F.sum(F.col("p") * F.col("q")) - 1).alias("residual"))
