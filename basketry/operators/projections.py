"""Exponential smoothing as a fold over each series, its errors at every origin, and tests of them."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.governance import student_tail

GRID = "id int, alpha double, beta double, phi double, gamma double, size int"
STATE = "struct<l:double,b:double,s:array<double>,sse:double,out:array<struct<k:int,l:double,b:double,s:array<double>,sse:double,e:double>>>"


class ForecastError(ValueError):
    """The series carry no backtest."""


def smoothing_grid(spark: SparkSession, alphas=(0.1, 0.3, 0.5, 0.7, 0.9), betas=(0.01, 0.1), damping: float = 0.9, gammas=(0.05, 0.3)) -> DataFrame:
    """GRID: smoothing parameters of no, an additive or a damped trend, without (gamma -1) and with an additive season.

    size counts what a form chooses: its parameters and the variance. Starting states come from years before the
    errors that are compared, so they are not counted.
    """
    trends = [(0.0, 0.0, 0)] + [(b, 1.0, 1) for b in betas] + [(b, damping, 2) for b in betas]
    rows = []
    for a, (b, phi, more), g in itertools.product(alphas, trends, (-1.0, *gammas)):
        rows.append((len(rows), a, b, phi, g, 2 + more + (g >= 0)))
    return spark.createDataFrame(rows, GRID)


def smoothed(series: DataFrame, grid: DataFrame, season: int = 12) -> DataFrame:
    """series, id, k, l, b, s, sse, e for every parameter set and place k from the second year on.

    series has series, period and index (positive, without gaps); logs are smoothed. States begin with the first year:
    its mean moved to its end by the trend, a twelfth of the change of means to the second year, and its deviations
    from its mean. After place k the level is l, the trend b, the season s and the sum of squared one-step errors sse.
    The recursion is one fold over each series' sorted values for each parameter set, so every origin comes from one
    pass. Series of less than two years are left out.
    """
    y = F.transform(F.array_sort(F.collect_list(F.struct("period", F.ln("index").alias("y")))), lambda x: x["y"])
    g = series.filter("index > 0").groupBy("series").agg(y.alias("y")).filter(F.size("y") >= 2 * season)
    j = g.join(F.broadcast(grid))  # some dozens of parameter sets

    def mean(a: int) -> Column:
        return F.aggregate(F.slice("y", a, season), F.lit(0.0), lambda t, x: t + x) / season

    j = j.withColumn("m1", mean(1)).withColumn("b0", F.when(F.col("phi") > 0, (mean(season + 1) - mean(1)) / season).otherwise(0.0))
    first = F.transform(F.slice("y", 1, season), lambda x: F.when(F.col("gamma") >= 0, x - F.col("m1")).otherwise(0.0))
    start = F.struct((F.col("m1") + (season - 1) / 2 * F.col("b0")).alias("l"), F.col("b0").alias("b"), first.alias("s"), F.lit(0.0).alias("sse"), F.array().alias("out")).cast(STATE)
    steps = F.filter(F.transform("y", lambda v, i: F.struct(v.alias("y"), i.alias("i"))), lambda x: x["i"] >= season)

    def step(state: Column, x: Column) -> Column:
        place = x["i"] % season
        ahead = state["l"] + F.col("phi") * state["b"]

        def moved(e: Column) -> Column:
            s = F.transform(state["s"], lambda v, k: F.when(k == place, v + F.greatest("gamma", F.lit(0.0)) * e).otherwise(v))
            new = [(ahead + F.col("alpha") * e).alias("l"), (F.col("phi") * state["b"] + F.col("beta") * e).alias("b"), s.alias("s"), (state["sse"] + e * e).alias("sse")]
            told = F.struct((x["i"] + 1).alias("k"), *new, e.alias("e"))
            return F.struct(*new, F.array_append(state["out"], told).alias("out"))

        return F.get(F.transform(F.array(x["y"] - ahead - F.get(state["s"], place)), moved), F.lit(0))  # the error is worked out once

    out = F.aggregate(steps, start, lambda a, x: step(a, x).cast(STATE), lambda a: a["out"])
    return j.select("series", "id", "phi", "size", F.explode(out).alias("x")).select("series", "id", "phi", "size", "x.*")


def chosen(states: DataFrame, season: int = 12, first: int = 36) -> DataFrame:
    """The states of the parameter set with the least AICc of one-step errors so far, at every place from `first` on; ties to the smaller id."""
    n = (F.col("k") - season).cast("double")
    k = F.col("size")
    score = n * F.ln(F.greatest(F.col("sse"), F.lit(1e-300)) / n) + 2 * k + F.when(n - k - 1 > 0, 2 * k * (k + 1) / (n - k - 1)).otherwise(1e12)
    best = states.filter(F.col("k") >= first).withColumn("score", score)
    rank = F.row_number().over(Window.partitionBy("series", "k").orderBy(F.round("score", 9), "id"))
    return best.withColumn("r", rank).filter("r = 1").drop("r", "score")


def backtest(series: DataFrame, grid: DataFrame | None = None, horizons: int = 12, season: int = 12, first: int = 36) -> DataFrame:
    """series, k (origin), horizon, error, benchmark (log errors): smoothing and the seasonal naive on the same origins.

    At each origin the parameters are chosen on what was known then, and the forecast is
    level + (phi + ... + phi^h) trend + season. Raises if no series has first + 1 places.
    """
    grid = grid if grid is not None else smoothing_grid(series.sparkSession)
    at = chosen(smoothed(series, grid, season), season, first)
    y = series.filter("index > 0").select("series", F.ln("index").alias("y"), F.row_number().over(Window.partitionBy("series").orderBy("period")).alias("target"))
    steps = at.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons)))).withColumn("target", F.col("k") + F.col("horizon"))
    phi, h = F.col("phi"), F.col("horizon")
    run = F.when(phi == 0, 0.0).when(phi == 1, h.cast("double")).otherwise(phi * (1 - F.pow(phi, h)) / (1 - phi))
    path = F.col("l") + run * F.col("b") + F.get("s", (F.col("target") - 1) % season)
    back = F.col("target") - season * F.ceil(h / season)
    e = steps.withColumn("path", path).withColumn("back", back).join(y, ["series", "target"])
    naive = y.select("series", F.col("target").alias("back"), F.col("y").alias("naive"))
    out = e.join(naive, ["series", "back"]).select("series", "k", "horizon", (F.col("y") - F.col("path")).alias("error"), (F.col("y") - F.col("naive")).alias("benchmark"))
    return out


def accuracy(errors: DataFrame) -> DataFrame:
    """series, horizon, rmse, benchmark_rmse (percent), n, over origins."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) ** 2)) * 100
    return errors.groupBy("series", "horizon").agg(rms("error").alias("rmse"), rms("benchmark").alias("benchmark_rmse"), F.count("*").alias("n"))


def diebold_mariano(errors: DataFrame) -> DataFrame:
    """series, horizon, n, statistic: whether squared errors are smaller than the benchmark's, positive if they are.

    The variance of the mean difference takes horizon - 1 autocovariances with falling weights, as errors of origins
    less than a horizon apart overlap; small samples are corrected. Null with less than three origins or no variance.
    """
    w = Window.partitionBy("series", "horizon")
    d = errors.withColumn("d", F.col("benchmark") ** 2 - F.col("error") ** 2).withColumn("n", F.count("*").over(w)).withColumn("c", F.col("d") - F.avg("d").over(w))
    d = d.withColumn("lags", F.greatest(F.lit(0), F.least(F.col("horizon") - 1, F.col("n") - 2)))
    order = w.orderBy("k")
    past = F.collect_list("c").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lagged = F.transform(F.when(F.col("lags") > 0, F.sequence(F.lit(1), F.col("lags").cast("int"))).otherwise(F.array().cast("array<int>")), lambda i: F.when(F.size("past") >= i, 2 * (1 - i / (F.col("lags") + 1)) * F.col("c") * F.get("past", F.size("past") - i)).otherwise(0.0))
    d = d.withColumn("past", past).withColumn("v", F.col("c") ** 2 + F.aggregate(lagged, F.lit(0.0), lambda a, x: a + x))
    t = d.groupBy("series", "horizon").agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.avg("v").alias("v"))
    n, h = F.col("n"), F.col("horizon")
    inside = (n + 1 - 2 * h + h * (h - 1) / n) / n
    correction = F.when(n + 1 - 2 * h > 0, F.sqrt(inside)).otherwise(1.0)
    return t.select("series", "horizon", "n", F.when((n >= 3) & (F.col("v") > 0), F.col("mean") / F.sqrt(F.col("v") / n) * correction).alias("statistic"))


def diebold_mariano_p(statistic: float, n: int) -> float:
    """The one-sided p-value of a statistic, by Student's distribution with n - 1 degrees of freedom."""
    tail = student_tail(abs(statistic), n - 1)
    return tail if statistic >= 0 else 1 - tail


def chi_square_tail(x: float, df: int) -> float:
    """P(X > x) of a chi-square variable: closed for even df, by recurrence from the normal tail for odd ones."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for k in range(1, df // 2):
            term *= x / 2 / k
            total += term
        return total
    total, term = math.erfc(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, df // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


def residual_tests(residuals: DataFrame, lags: int = 12) -> DataFrame:
    """series, n, ljung_box, jarque_bera of one-step errors (series, k, e): autocorrelation up to lags, and normality."""
    w = Window.partitionBy("series")
    c = residuals.withColumn("c", F.col("e") - F.avg("e").over(w)).withColumn("n", F.count("*").over(w))
    order = w.orderBy("k")
    c = c.select("*", *[F.lag("c", i).over(order).alias(f"c{i}") for i in range(1, lags + 1)])
    s = c.groupBy("series").agg(F.first("n").alias("n"), F.sum(F.col("c") ** 2).alias("s2"), F.avg(F.col("c") ** 2).alias("m2"), F.avg(F.col("c") ** 3).alias("m3"), F.avg(F.col("c") ** 4).alias("m4"), *[F.sum(F.col("c") * F.col(f"c{i}")).alias(f"g{i}") for i in range(1, lags + 1)])
    n = F.col("n")
    q = sum((F.coalesce((F.col(f"g{i}") / F.col("s2")) ** 2 / F.when(n > i, n - i), F.lit(0.0)) for i in range(1, lags + 1)), F.lit(0.0))
    skew, tails = F.col("m3") / F.pow("m2", F.lit(1.5)), F.col("m4") / F.col("m2") ** 2 - 3
    return s.select("series", "n", (n * (n + 2) * q).alias("ljung_box"), (n / 6 * (skew**2 + tails**2 / 4)).alias("jarque_bera"))
