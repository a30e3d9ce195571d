"""What a hedonic regression rests on: the price's transformation, collinearity, leverage, stability, and factors of many levels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.operators.hedonic import design, moments
from basketry.sources.staging import staged


class HedonicError(ValueError):
    """The data carry no such regression."""


# --- Box-Cox ---


def box_cox(price: Column, power: float) -> Column:
    """(price^power - 1) / power, the logarithm at 0."""
    return F.ln(price) if abs(power) < 1e-12 else (F.pow(price, F.lit(power)) - 1) / power


def _likelihoods(rows: DataFrame, xx: np.ndarray, n: int, logs: float, powers: Sequence[float]) -> np.ndarray:
    """Concentrated log likelihoods of the powers, from one pass: x'y and y'y of every transformed price at once."""
    y = [box_cox(F.exp("y"), p) for p in powers]
    whole = rows.agg(*[F.sum(v**2).alias(f"s{j}") for j, v in enumerate(y)]).first()
    nz = rows.select("y", F.posexplode("x").alias("i", "v")).filter("v <> 0")
    xy = np.zeros((xx.shape[0], len(powers)))
    for r in nz.groupBy("i").agg(*[F.sum(F.col("v") * v).alias(f"s{j}") for j, v in enumerate(y)]).collect():
        xy[r["i"]] = [r[f"s{j}"] for j in range(len(powers))]
    rss = np.array([whole[f"s{j}"] for j in range(len(powers))]) - (xy * (np.linalg.pinv(xx) @ xy)).sum(0)
    return -n / 2 * np.log(np.maximum(rss, 1e-300) / n) + (np.array(powers) - 1) * logs


def box_cox_power(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = None, log: bool = False, low: float = -2.0, high: float = 2.0, passes: int = 5) -> float:
    """The power of the price that makes the regression likeliest, between low and high.

    Each pass sums the moments of 21 powers at once and goes on between the neighbours of the best one, so a pass is
    ten times as fine: the first steps by a twentieth of the range. The likelihood is taken to have one peak.
    """
    rows, names, _ = design(df, continuous, categorical, time, log)
    rows = staged(rows.select("y", "x"), "design")
    m = moments(rows, len(names))
    if not m or m[0]["n"] <= len(names):
        raise HedonicError("no more complete rows than columns")
    m = m[0]
    step, a, b = (high - low) / 20, low, high
    for _ in range(passes):
        grid = [a + k * step for k in range(int(round((b - a) / step)) + 1)]
        best = grid[int(np.argmax(_likelihoods(rows, m["xx"], m["n"], m["y"], grid)))]
        a, b, step = max(low, best - step), min(high, best + step), step / 10
    return float(best)


# --- collinearity and leverage ---


def inflation(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = "period", log: bool = True) -> DataFrame:
    """name, vif of every regressor but the constant: the diagonal of the inverse of their correlations.

    Regressors that do not vary have none; one that others determine exactly has infinity. The correlations are made
    of the sums of products, so no regression of one regressor on the others is run.
    """
    rows, names, _ = design(df, continuous, categorical, time, log)
    m = moments(rows.select("y", "x"), len(names))[0]
    mean = m["xx"][0, 1:] / m["n"]
    cov = m["xx"][1:, 1:] - m["n"] * np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    varies = sd > 1e-9 * np.sqrt(np.maximum(np.diag(m["xx"])[1:], 1e-300))
    out = np.full(len(names) - 1, np.nan)
    if varies.sum() > 1:
        r = cov[np.ix_(varies, varies)] / np.outer(sd[varies], sd[varies])
        if np.linalg.cond(r) > 1e12:
            value = np.diag(np.linalg.pinv(r)).copy()
            value[np.abs(np.linalg.svd(r)[2][-1]) > 1e-6] = np.inf
        else:
            value = np.diag(np.linalg.inv(r))
        out[varies] = value
    return df.sparkSession.createDataFrame([(n, None if np.isnan(v) else float(v)) for n, v in zip(names[1:], out, strict=True)], "name string, vif double")


def condition_number(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = "period", log: bool = True) -> float:
    """Largest over smallest singular value of the design, its columns scaled by their largest absolute values."""
    rows, names, _ = design(df, continuous, categorical, time, log)
    rows = rows.select("y", "x")
    m = moments(rows, len(names))[0]
    most = {r["i"]: r["m"] for r in rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.max(F.abs("v")).alias("m")).collect()}
    d = np.array([max(most[i], 1e-12) for i in range(len(names))])
    values = np.linalg.eigvalsh(m["xx"] / np.outer(d, d))
    return float(np.sqrt(values[-1] / max(values[0], 1e-300)))


def leverage(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), time: str | None = "period", log: bool = True) -> DataFrame:
    """The complete rows of df with leverage, x' (X'X)^-1 x: a second pass with the inverse of the sums of products.

    Leverages add up to the number of columns that are no combination of others.
    """
    rows, names, _ = design(df, continuous, categorical, time, log)
    inverse = np.linalg.pinv(moments(rows.select("y", "x"), len(names))[0]["xx"])
    matrix = F.array(*[F.array(*[F.lit(float(v)) for v in line]) for line in inverse])
    terms = F.filter(F.transform("x", lambda v, i: F.struct(i.alias("i"), v.alias("v"))), lambda e: e["v"] != 0)

    def add(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)

    h = add(F.transform("_nz", lambda a: a["v"] * add(F.transform("_nz", lambda b: b["v"] * F.get(F.get(matrix, a["i"]), b["i"])))))
    return rows.withColumn("_nz", terms).withColumn("leverage", h).drop("y", "x", "_nz")


# --- stability ---


def stability(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str] = (), window: int = 4, time: str = "period", log: bool = True) -> DataFrame:
    """first, last, name, coefficient: the characteristics' coefficients in each run of `window` consecutive periods, with period dummies.

    Sums of products are made once by period; a window adds up those of its periods, and leaves out what is zero in it.
    Windows without more rows than columns are left out.
    """
    rows, names, _ = design(df, continuous, categorical, time, log)
    parts = moments(rows.select("y", "x", time), len(names), by=time)
    periods, out = sorted(parts), []
    own = [k for k, n in enumerate(names) if not n.startswith("t:")]
    at = {n: k for k, n in enumerate(names)}
    for a in range(len(periods) - window + 1):
        chunk = periods[a : a + window]
        xx, xy = sum(parts[p]["xx"] for p in chunk), sum(parts[p]["xy"] for p in chunk)
        use = [k for k in own if xx[k, k] > 0] + [at[f"t:{p}"] for p in chunk[1:]]
        if sum(parts[p]["n"] for p in chunk) <= len(use):
            continue
        beta = np.linalg.pinv(xx[np.ix_(use, use)]) @ xy[use]
        out += [(chunk[0], chunk[-1], names[k], float(b)) for k, b in zip(use, beta, strict=True) if k in own and k]
    return df.sparkSession.createDataFrame(out, "first date, last date, name string, coefficient double")


def stability_range(table: DataFrame) -> DataFrame:
    """name, least, most, range of the coefficients over windows."""
    return table.groupBy("name").agg(F.min("coefficient").alias("least"), F.max("coefficient").alias("most")).withColumn("range", F.col("most") - F.col("least"))


# --- factors of many levels ---


def absorbed_index(df: DataFrame, continuous: Sequence[str], factor: str, time: str = "period", log: bool = True, base_value: float = 100.0) -> tuple[DataFrame, dict[str, float]]:
    """period, index and the characteristics' coefficients of the time-dummy regression with a dummy for every level of a factor.

    The factor never becomes columns: its levels are partialled out. One pass over the rows sums them by (level,
    period); all products that the normal equations need are sums over these cells and, for pairs of periods, a
    self-join of the cells on the level. The driver solves a system of periods and characteristics.
    Complete rows with positive prices (and characteristics, where logged) count. Raises if there are too few.
    """
    d = df.dropna(subset=["price", factor, time, *continuous]).filter("price > 0")
    for c in continuous if log else ():
        d = d.filter(F.col(c) > 0)
    x = [F.ln(c) if log else F.col(c).cast("double") for c in continuous]
    y, k = F.ln("price"), len(continuous)
    sums = [F.count("*").alias("n"), F.sum(y).alias("y")] + [F.sum(v).alias(f"x{i}") for i, v in enumerate(x)]
    sums += [F.sum(v * y).alias(f"xy{i}") for i, v in enumerate(x)] + [F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i in range(k) for j in range(i, k)]
    cells = staged(d.groupBy(F.col(factor).alias("f"), F.col(time).alias("t")).agg(*sums), "cells")
    names = ["n", "y", *[f"x{i}" for i in range(k)]]
    level = staged(cells.groupBy("f").agg(*[F.sum(c).alias(f"f_{c}") for c in names]), "levels")
    j = cells.join(level, "f")
    by_time = j.groupBy("t").agg(F.sum("n").alias("d"), *[F.sum(F.col(c) - F.col("n") * F.col(f"f_{c}") / F.col("f_n")).alias(c) for c in names[1:]]).collect()
    cross = j.join(cells.select("f", F.col("t").alias("s"), F.col("n").alias("m")), "f").groupBy("t", "s").agg(F.sum(F.col("n") * F.col("m") / F.col("f_n")).alias("v")).collect()
    whole = cells.agg(F.sum("n").alias("n"), *[F.sum(f"xy{i}").alias(f"xy{i}") for i in range(k)], *[F.sum(f"xx{i}_{h}").alias(f"xx{i}_{h}") for i in range(k) for h in range(i, k)]).first()
    less = level.agg(F.count("*").alias("levels"), *[F.sum(F.col(f"f_x{i}") * F.col("f_y") / F.col("f_n")).alias(f"xy{i}") for i in range(k)], *[F.sum(F.col(f"f_x{i}") * F.col(f"f_x{h}") / F.col("f_n")).alias(f"xx{i}_{h}") for i in range(k) for h in range(i, k)]).first()
    times = sorted(r["t"] for r in by_time)
    p = len(times)
    if not whole["n"] or whole["n"] <= p - 1 + k + less["levels"]:
        raise HedonicError("no more complete rows than columns")
    at = {t: i for i, t in enumerate(times)}
    a, b = np.zeros((p + k, p + k)), np.zeros(p + k)
    for r in by_time:
        i = at[r["t"]]
        a[i, i] += r["d"]
        b[i] = r["y"]
        a[i, p:] = a[p:, i] = [r[f"x{h}"] for h in range(k)]
    for r in cross:
        a[at[r["t"]], at[r["s"]]] -= r["v"]
    for i in range(k):
        b[p + i] = whole[f"xy{i}"] - less[f"xy{i}"]
        for h in range(i, k):
            a[p + i, p + h] = a[p + h, p + i] = whole[f"xx{i}_{h}"] - less[f"xx{i}_{h}"]
    beta = np.zeros(p + k)
    beta[1:] = np.linalg.lstsq(a[1:, 1:], b[1:], rcond=None)[0]
    index = df.sparkSession.createDataFrame([(t, float(base_value * np.exp(v))) for t, v in zip(times, beta[:p], strict=True)], "period date, index double")
    return index, dict(zip(continuous, map(float, beta[p:]), strict=True))


def absorbed_residuals(df: DataFrame, index: DataFrame, coefficients: dict[str, float], factor: str, log: bool = True) -> DataFrame:
    """period, n, residual: what is left of the normal equations of absorbed_index(), 0 where it is least squares."""
    d = df.dropna(subset=["price", factor, "period", *coefficients]).filter("price > 0")
    fitted = sum((v * (F.ln(c) if log else F.col(c)) for c, v in coefficients.items()), F.lit(0.0))
    e = d.join(index, "period").select("period", F.col(factor).alias("f"), (F.ln("price") - F.ln("index") - fitted).alias("e"))
    mean = e.groupBy("f").agg(F.avg("e").alias("m"))
    return e.join(mean, "f").groupBy("period").agg(F.count("*").alias("n"), F.abs(F.sum(F.col("e") - F.col("m"))).alias("residual"))
