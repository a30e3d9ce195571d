"""Repeat-sales indices as they would have been published at the end of each period, and how they were revised."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.domain import repeat_pairs


class PropertyError(ValueError):
    """The sales carry no index."""


def pair_sums(sales: DataFrame) -> DataFrame:
    """first, second, months, n, s: counts and sums of log ratios of consecutive sales of a property, by their periods."""
    return repeat_pairs(sales).groupBy("first", "second", "months").agg(F.count("*").alias("n"), F.sum("log_ratio").alias("s"))


def repeat_sales_vintages(sales: DataFrame, first_end=None) -> DataFrame:
    """vintage, vintage_end, period, index, pairs: the index re-estimated on the sales known by each period's end.

    A pair is known once its second sale is, and later sales change no pair of earlier ones. So one pass over the
    pairs gives counts and sums by (first, second); a vintage adds to the normal equations what its period brings
    (running sums by cut date), and the driver solves one system of periods for each. Vintages begin at first_end, by
    default the third period; one without pairs is left out, and a period that no chain of pairs links with the first
    one takes the least-norm level. The first period sold in is 100.
    Raises if there are no pairs at all.
    """
    cells = pair_sums(sales).collect()  # periods x periods rows at most
    if not cells:
        raise PropertyError("no property was sold twice")
    sold = sorted(r["period"] for r in sales.filter("price > 0").select("period").distinct().collect())
    start = first_end or (sold[2] if len(sold) > 2 else sold[-1])
    periods = sorted({r["first"] for r in cells} | {r["second"] for r in cells})
    at = {p: k for k, p in enumerate(periods)}
    by_second: dict = {}
    for r in cells:
        by_second.setdefault(r["second"], []).append(r)
    a, b, n, rows, number = np.zeros((len(periods), len(periods))), np.zeros(len(periods)), 0, [], 0
    for end in sold:
        for r in by_second.get(end, ()):
            i, j = at[r["first"]], at[r["second"]]
            a[i, i] += r["n"]
            a[j, j] += r["n"]
            a[i, j] -= r["n"]
            a[j, i] -= r["n"]
            b[i] -= r["s"]
            b[j] += r["s"]
            n += r["n"]
        if end >= start and n:
            number += 1
            met = [k for k in range(len(periods)) if a[k, k] > 0]
            beta = np.zeros(len(met))
            beta[1:] = np.linalg.lstsq(a[np.ix_(met[1:], met[1:])], b[met[1:]], rcond=None)[0]
            rows += [(number, end, periods[k], float(100 * np.exp(x)), n) for k, x in zip(met, beta, strict=True)]
    return sales.sparkSession.createDataFrame(rows, "vintage int, vintage_end date, period date, index double, pairs long")


def vintage_residuals(sales: DataFrame, vintages: DataFrame) -> DataFrame:
    """vintage, period, pairs, residual: what is left of each vintage's normal equations, 0 where it is least squares.

    The residual of a period is the sum of what its pairs' log ratios have beyond the index, of those that end there
    less those that begin there; the base period's follows from the others.
    """
    sums = pair_sums(sales)
    ends = vintages.select("vintage", "vintage_end").distinct()
    level = vintages.select("vintage", "period", F.ln("index").alias("l"))
    known = ends.join(sums, F.col("second") <= F.col("vintage_end"))  # vintages x pairs of periods
    j = known.join(level.select("vintage", F.col("period").alias("first"), F.col("l").alias("a")), ["vintage", "first"]).join(level.select("vintage", F.col("period").alias("second"), F.col("l").alias("b")), ["vintage", "second"])
    e = j.withColumn("e", F.col("s") - F.col("n") * (F.col("b") - F.col("a")))
    both = e.select("vintage", F.explode(F.array(F.struct(F.col("second").alias("period"), "e"), F.struct(F.col("first").alias("period"), (-F.col("e")).alias("e")))).alias("x"))
    return both.groupBy("vintage", "x.period").agg(F.sum("x.e").alias("residual"))


def as_vintages(vintages: DataFrame) -> DataFrame:
    """period, vintage, value: the shape of revision triangles and their statistics."""
    return vintages.select("period", "vintage", F.col("index").alias("value"))
