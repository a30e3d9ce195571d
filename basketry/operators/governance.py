"""Runs, vintages, revisions and the audit log as append-only tables."""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RUNS = "run_id string, label string, data_hash string, config string, supersedes string, reason string, created_at timestamp"


def frame_hash(df: DataFrame) -> str:
    """SHA-256 of a table's content, whatever the order of its rows: from the count and two sums of row hashes."""
    cols = sorted(df.columns)
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in cols]
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(1), *cells).cast("decimal(38,0)")).alias("b")).first()
    return hashlib.sha256(f"{cols}|{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def _runs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUNS).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RUNS)


def register_run(df: DataFrame, config: dict, label: str, path: str, supersedes: str | None = None, reason: str | None = None) -> str:
    """Append a run to the registry and return its id; the same data and config give the same run, registered once."""
    spark = df.sparkSession
    text = json.dumps(config, sort_keys=True)
    data = frame_hash(df)
    run = hashlib.sha256(f"{data}|{text}|{supersedes or ''}".encode()).hexdigest()
    if supersedes and not reason:
        raise ValueError("a correction needs a reason")
    if _runs(spark, path).filter(F.col("run_id") == run).isEmpty():
        row = spark.createDataFrame([(run, label, data, text, supersedes, reason)], "run_id string, label string, data_hash string, config string, supersedes string, reason string")
        row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)
    return run


def vintage_chain(spark: SparkSession, path: str, run: str) -> list[str]:
    """The runs of a chain of corrections, oldest first. The registry has a row for each run, one chain's are few."""
    link = {r["run_id"]: r["supersedes"] for r in _runs(spark, path).select("run_id", "supersedes").collect()}
    later = {v: k for k, v in link.items() if v}
    while link.get(run):
        run = link[run]
    out = [run]
    while out[-1] in later:
        out.append(later[out[-1]])
    return out


def published_and_current(vintages: DataFrame) -> DataFrame:
    """period, published (first known value), current (last known), revision."""
    v = vintages.filter("value is not null").groupBy("period").agg(F.min_by("value", "vintage").alias("published"), F.max_by("value", "vintage").alias("current"))
    return v.withColumn("revision", F.col("current") - F.col("published"))


def revision_bias(vintages: DataFrame) -> DataFrame:
    """n, mean, mean_absolute, t, p_value of the last against the first values: a two-sided t-test of a mean of 0."""
    r = published_and_current(vintages).agg(F.count("revision").alias("n"), F.avg("revision").alias("mean"), F.avg(F.abs("revision")).alias("mean_absolute"), F.stddev_samp("revision").alias("sd")).first()
    t = r["mean"] / (r["sd"] / math.sqrt(r["n"])) if r["n"] > 1 and r["sd"] else None
    p = 2 * student_tail(abs(t), r["n"] - 1) if t is not None else None
    return vintages.sparkSession.createDataFrame([(r["n"], r["mean"], r["mean_absolute"], t, p)], "n long, mean double, mean_absolute double, t double, p_value double")


def student_tail(t: float, df: int, steps: int = 4000) -> float:
    """P(T > t) by Simpson's rule on the density after x = t + u / (1 - u)."""
    norm = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def f(u: float) -> float:
        if u >= 1:
            return 0.0
        x = t + u / (1 - u)
        return norm * (1 + x * x / df) ** (-(df + 1) / 2) / (1 - u) ** 2

    h = 1 / steps
    return h / 3 * sum((1 if i in (0, steps) else 4 if i % 2 else 2) * f(i * h) for i in range(steps + 1))


def sticky(frequency: DataFrame, months: float = 4.3) -> DataFrame:
    """Components whose implied duration between price changes is over `months`."""
    return frequency.filter(F.col("duration").isNull() | (F.col("duration") > months))


def annual_contributions(components: DataFrame, weights: DataFrame, aggregate: DataFrame) -> DataFrame:
    """component, period, since_link, before_link, contribution to the annual rate of a December-chained index.

    components: component, period, index; weights: component, year, weight (shares of a year's link); aggregate: period,
    index. The part since the last December moves with this year's weights, the part before with last year's; the
    parts add up to the aggregate's annual rate.
    """
    c = components.select("component", "period", "index", F.year("period").alias("y"))
    dec = c.filter(F.month("period") == 12).select("component", F.col("y").alias("dy"), F.col("index").alias("link"))
    share = weights.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("year"))).select("component", F.col("year").alias("wy"), "share")

    def at(df: DataFrame, years: int, name: str) -> DataFrame:
        return df.withColumn("dy", F.col("y") - years).join(dec.withColumnRenamed("link", name), ["component", "dy"]).drop("dy")

    year_ago = c.select("component", F.add_months("period", 12).alias("period"), F.col("index").alias("i12"))
    j = at(at(c, 1, "l1"), 2, "l0").join(year_ago, ["component", "period"])
    j = j.join(share.select("component", F.col("wy").alias("y"), F.col("share").alias("w1")), ["component", "y"])
    j = j.join(share.select("component", (F.col("wy") + 1).alias("y"), F.col("share").alias("w0")), ["component", "y"])
    a = aggregate.select("period", F.col("index").alias("a"))
    links = aggregate.filter(F.month("period") == 12).select(F.year("period").alias("ay"), F.col("index").alias("al"))

    def level(df: DataFrame, years: int, name: str) -> DataFrame:
        return df.withColumn("ay", F.col("y") - years).join(links.withColumnRenamed("al", name), "ay").drop("ay")

    j = level(level(j, 1, "a1"), 2, "a0").join(a.select(F.add_months("period", 12).alias("period"), F.col("a").alias("a12")), "period")
    since = 100 * F.col("a1") / F.col("a12") * F.col("w1") * (F.col("index") - F.col("l1")) / F.col("l1")
    before = 100 * F.col("a0") / F.col("a12") * F.col("w0") * (F.col("l1") - F.col("i12")) / F.col("l0")
    return j.select("component", "period", since.alias("since_link"), before.alias("before_link"), (since + before).alias("contribution"))


def findings(index: DataFrame, faults: DataFrame, gaps: DataFrame) -> DataFrame:
    """topic, subject, importance, text: ranked remarks on a run, most important first.

    index: series, period, index, yoy; faults: flag, n; gaps: category, systemic, kind.
    """
    last = index.filter("yoy is not null").groupBy("series").agg(F.max_by("yoy", "period").alias("yoy"))
    fall = last.filter("yoy < 0").select(F.lit("trend").alias("topic"), F.col("series").alias("subject"), F.abs("yoy").alias("importance"), F.format_string("%s fell by %.1f %% on the year", "series", F.abs("yoy")).alias("text"))
    unit = faults.filter("flag in ('x100', 'div100')").select(F.lit("quality").alias("topic"), F.col("flag").alias("subject"), (10 + F.log10("n")).alias("importance"), F.format_string("%d quotes look %s", F.col("n"), F.when(F.col("flag") == "x100", "a hundred times too high").otherwise("a hundred times too low")).alias("text"))
    gap = gaps.filter("kind <> 'sporadic'").select(F.lit("quality").alias("topic"), F.col("category").alias("subject"), (5 + F.col("systemic")).cast("double").alias("importance"), F.format_string("%s lacks prices in %d periods (%s)", "category", "systemic", "kind").alias("text"))
    return fall.unionByName(unit).unionByName(gap).orderBy(F.desc("importance"), "subject")


def audit_hash(content: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(before, F.lit("")), content), 256)
