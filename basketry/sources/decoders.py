"""Official-source payloads as DataFrames: a payload is one JSON text in a column, decoded by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """source (the file), payload (its whole text)."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("payload"))


def period_start(code: Column) -> Column:
    """The first day of a year, quarter or month code such as 2020, 2020-Q3, 2020-01, 2020M01; else null."""
    year = F.regexp_extract(code, "^([0-9]{4})", 1).cast("int")
    month = (
        F.when(code.rlike("^[0-9]{4}$"), 1)
        .when(code.rlike("^[0-9]{4}-?Q[1-4]$"), F.regexp_extract(code, "Q([1-4])$", 1).try_cast("int") * 3 - 2)
        .when(code.rlike("^[0-9]{4}[-M](0[1-9]|1[0-2])$"), F.regexp_extract(code, "([0-9]{2})$", 1).try_cast("int"))
    )
    return F.when(month.isNotNull(), F.make_date(year, month, F.lit(1)))


def json_stat(df: DataFrame) -> DataFrame:
    """source, codes (map of dimension to code), value of a JSON-stat payload.

    A value's flat place is split into its dimensions' places by strides, and the places looked up in the category
    indexes: all of it on exploded rows, so a payload of any size is spread over tasks after its decoding.
    """
    schema = "id array<string>, size array<int>, dimension map<string, struct<category: struct<index: map<string, int>>>>, value map<string, double>"
    j = df.select("source", F.from_json("payload", schema).alias("j")).select("source", "j.*")
    cells = j.select("source", F.explode("value").alias("flat", "value")).withColumn("flat", F.col("flat").cast("long")).filter("value is not null")
    dims = j.select("source", F.posexplode("id").alias("d", "dim"), "size", "dimension")
    after = F.aggregate(F.slice("size", F.col("d") + 2, F.greatest(F.size("size") - F.col("d") - 1, F.lit(0))), F.lit(1).cast("long"), lambda a, x: a * x)
    dims = dims.select("source", "dim", F.get("size", F.col("d")).alias("n"), after.alias("stride"), F.col("dimension")[F.col("dim")]["category"]["index"].alias("index"))
    codes = dims.select("source", "dim", "n", "stride", F.explode("index").alias("code", "at"))
    placed = cells.join(dims.select("source", "dim", "n", "stride"), "source").withColumn("at", (F.floor(F.col("flat") / F.col("stride")) % F.col("n")).cast("int"))
    named = placed.join(codes.select("source", "dim", "code", "at"), ["source", "dim", "at"])
    return named.groupBy("source", "flat", "value").agg(F.map_from_entries(F.collect_list(F.struct("dim", "code"))).alias("codes")).select("source", "codes", "value")


def ons(df: DataFrame) -> DataFrame:
    """source, period, value of the finest of years, quarters and months that a payload has."""
    row = "array<struct<date: string, value: string, year: string, month: string, quarter: string>>"
    j = df.select("source", F.from_json("payload", f"years {row}, quarters {row}, months {row}").alias("j"))
    finest = F.when(F.size("j.months") > 0, F.col("j.months")).when(F.size("j.quarters") > 0, F.col("j.quarters")).otherwise(F.col("j.years"))
    kind = F.when(F.size("j.months") > 0, "m").when(F.size("j.quarters") > 0, "q").otherwise("y")
    r = j.select("source", kind.alias("kind"), F.explode(finest).alias("x"))
    month = F.try_to_timestamp(F.concat("x.year", F.lit(" "), F.initcap("x.month")), F.lit("yyyy MMMM")).cast("date")
    quarter = period_start(F.concat("x.year", F.lit("-"), F.col("x.quarter")))
    period = F.when(F.col("kind") == "m", month).when(F.col("kind") == "q", quarter).otherwise(period_start(F.coalesce("x.year", "x.date")))
    return r.select("source", period.alias("period"), F.col("x.value").try_cast("double").alias("value")).filter("period is not null and value is not null")


def bls(df: DataFrame) -> DataFrame:
    """source, series, period, value; only the months M01 to M12."""
    schema = "Results struct<series: array<struct<seriesID: string, data: array<struct<year: string, period: string, value: string>>>>>"
    s = df.select("source", F.explode(F.from_json("payload", schema)["Results"]["series"]).alias("s")).select("source", F.col("s.seriesID").alias("series"), F.explode("s.data").alias("x"))
    s = s.filter(F.col("x.period").rlike("^M(0[1-9]|1[0-2])$"))
    return s.select("source", "series", period_start(F.concat("x.year", "x.period")).alias("period"), F.col("x.value").try_cast("double").alias("value")).filter("value is not null")


def imf(df: DataFrame) -> DataFrame:
    """source, indicator, country, period, value."""
    j = df.select("source", F.explode(F.from_json("payload", "values map<string, map<string, map<string, double>>>")["values"]).alias("indicator", "c"))
    j = j.select("source", "indicator", F.explode("c").alias("country", "y")).select("source", "indicator", "country", F.explode("y").alias("year", "value"))
    return j.select("source", "indicator", "country", period_start(F.col("year")).alias("period"), "value").filter("period is not null and value is not null")


def world_bank(df: DataFrame) -> DataFrame:
    """source, indicator, country, period, value: the second element of the payload's array."""
    row = "array<struct<indicator: struct<id: string>, country: struct<id: string>, date: string, value: double>>"
    second = F.regexp_extract("payload", r"(?s)^\s*\[\s*\{.*?\}\s*,\s*(\[.*\])\s*\]\s*$", 1)
    j = df.select("source", F.explode(F.from_json(second, row)).alias("x")).filter("x.value is not null")
    return j.select("source", F.col("x.indicator.id").alias("indicator"), F.col("x.country.id").alias("country"), period_start(F.col("x.date")).alias("period"), F.col("x.value").alias("value"))


def oecd(df: DataFrame) -> DataFrame:
    """source, series (key), period, value of SDMX-JSON: observations joined to the values of TIME_PERIOD."""
    schema = """data struct<dataSets: array<struct<series: map<string, struct<observations: map<string, array<double>>>>>>,
      structure: struct<dimensions: struct<observation: array<struct<id: string, values: array<struct<id: string>>>>>>>"""
    j = df.select("source", F.from_json("payload", schema)["data"].alias("d"))
    obs = j.select("source", F.explode(F.get("d.dataSets", F.lit(0))["series"]).alias("series", "s")).select("source", "series", F.explode("s.observations").alias("at", "v"))
    times = j.select("source", F.explode("d.structure.dimensions.observation").alias("dim")).filter("dim.id = 'TIME_PERIOD'").select("source", F.posexplode("dim.values").alias("at", "t"))
    joined = obs.withColumn("at", F.col("at").cast("int")).join(times, ["source", "at"])
    return joined.select("source", "series", period_start(F.col("t.id")).alias("period"), F.get("v", F.lit(0)).alias("value")).filter("value is not null")


def hicp_parent(code: Column) -> Column:
    """The parent of an ECOICOP code by its prefix; null for the root."""
    return F.when(code == "CP00", None).when(F.length(code) == 4, "CP00").otherwise(F.substring(code, 1, F.length(code) - 1))


def leaf_codes(df: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code is no proper prefix of another one: codes exploded to their prefixes, then an anti-join."""
    prefixes = df.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(code) - 1, F.lit(1))), lambda n: F.substring(F.col(code), F.lit(1), n))).alias(code), F.col(code).alias("_of"))
    return df.join(prefixes.filter(F.col(code) != F.col("_of")).select(code).distinct(), code, "left_anti")


def audit_chain(events: DataFrame) -> DataFrame:
    """seq, broken: whether an event's hash is not that of its content and its predecessor's hash.

    events has seq, content, prev_hash, hash.
    """
    w = Window.orderBy("seq")
    right = F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), "content"), 256)
    return events.select("seq", ((F.col("hash") != right) | ~F.col("prev_hash").eqNullSafe(F.lag("hash").over(w))).alias("broken"))
