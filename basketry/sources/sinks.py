"""What leaves the engine: publication tables with disclosure control, as wide tables, stamped CSV and SDMX-ML messages."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.domain import sanitised, suppress

TOTAL = "All items"
SUPPRESSED = "suppressed"
#: The namespaces of SDMX-ML 2.1 generic messages.
NAMESPACES = {
    "message": "http://www.sdmx.org/resources/sdmxml/schemas/v2_1/message",
    "common": "http://www.sdmx.org/resources/sdmxml/schemas/v2_1/common",
    "generic": "http://www.sdmx.org/resources/sdmxml/schemas/v2_1/data/generic",
}


class ExportError(ValueError):
    """A table or a message is not what may leave."""


def publication_table(index: DataFrame, least: int = 3, extra: DataFrame | None = None) -> DataFrame:
    """period, series, index (null where suppressed), matched_items, basis, suppressed, suppression_rule, published.

    index has series, period, index and matched. A category's level built from fewer than `least` matched quotes is
    suppressed; where it is the only one of its period, so is the smallest other category, from which it could be
    worked out. All items is protected through its parts and never suppressed on a count; a level without a count,
    as in the first period, is not either. published is the text to print: the level to six places, `suppressed`, or
    nothing for a missing level. extra (series, period, index, basis) has further series, say multilateral or adjusted
    ones, whose basis says how they were made.
    """
    parts = index.filter(F.col("series") != TOTAL).withColumn("_count", F.coalesce("matched", F.lit(least)))
    held = suppress(parts, "period", "index", "_count", least)
    rule = F.when(F.col("suppressed") == "primary", F.lit(f"primary: built from fewer than {least} matched quotes")).when(F.col("suppressed") == "secondary", F.lit("secondary: smallest remaining cell of a period with one suppressed cell")).otherwise("")
    held = held.select("period", "series", F.col("index").alias("level"), F.col("matched").cast("double").alias("matched_items"), F.lit("").alias("basis"), F.col("suppressed").isNotNull().alias("suppressed"), rule.alias("suppression_rule"))
    free = index.filter(F.col("series") == TOTAL).select("period", "series", F.col("index").alias("level"), F.col("matched").cast("double").alias("matched_items"), F.lit("").alias("basis"))
    if extra is not None:
        more = extra.filter("index is not null and not isnan(index)")
        free = free.unionByName(more.select("period", "series", F.col("index").alias("level"), F.lit(None).cast("double").alias("matched_items"), F.coalesce("basis", F.lit("")).alias("basis")))
    out = held.unionByName(free.withColumn("suppressed", F.lit(False)).withColumn("suppression_rule", F.lit("")))
    text = F.when(F.col("suppressed"), SUPPRESSED).otherwise(F.coalesce(F.format_string("%.6f", "level"), F.lit("")))
    text = F.when(F.col("level").isNull() & ~F.col("suppressed"), "").otherwise(text)
    return out.select("period", "series", F.when(~F.col("suppressed"), F.col("level")).alias("index"), "matched_items", "basis", "suppressed", "suppression_rule", text.alias("published"))


def wide_publication(table: DataFrame, series: list[str] | None = None) -> DataFrame:
    """One row a period, a column of published texts for each series in order of name, All items last.

    The names are those given, else the table's, which are one for each category and few by nature.
    """
    names = series if series is not None else sorted(r[0] for r in table.select("series").distinct().collect())
    ordered = [n for n in names if n != TOTAL] + [n for n in names if n == TOTAL]
    wide = table.groupBy(F.date_format("period", "yyyy-MM-dd").alias("period")).pivot("series", ordered).agg(F.first("published"))
    return wide.select("period", *[F.col(f"`{n}`") for n in ordered])


def stamp(run: str, data_hash: str, settings: dict, **more) -> str:
    """What a release says of itself, as JSON in the order of names: the run, the content it was made from and the settings."""
    return json.dumps({"run_id": run, "data_vintage": data_hash, "settings": settings, **more}, sort_keys=True)


def _text(df: DataFrame, path: str) -> None:
    """Write lines (at, line) in their order as one file: publications have one row for each series and period."""
    df.repartition(1).sortWithinPartitions("at").select("line").write.mode("error").text(path)


def write_csv(df: DataFrame, path: str, provenance: str, notice: str = "", order: list[str] | None = None) -> None:
    """A CSV whose first lines are comments with the provenance and a notice; cells that a spreadsheet would run are made text."""
    spark = df.sparkSession
    head = [f"# provenance {provenance}"] + ([f"# {notice}"] if notice else []) + [",".join(df.columns)]
    lines = spark.createDataFrame([([str(k)], 0, h) for k, h in enumerate(head)], "key array<string>, part int, line string")
    dates = [F.date_format(c, "yyyy-MM-dd").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes]
    rows = sanitised(df.select(*dates))
    key = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in order or df.columns])
    body = rows.select(key.alias("key"), F.lit(1).alias("part"), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("line"))
    _text(lines.unionByName(body).select(F.struct("part", "key").alias("at"), "line"), path)


def read_csv(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, dict]:
    """A table that write_csv() wrote, and its provenance."""
    head = spark.read.text(path).filter(F.col("value").startswith("# provenance ")).first()
    if head is None:
        raise ExportError("the file has no provenance line")
    return spark.read.csv(path, schema=schema, header=True, comment="#"), json.loads(head[0].removeprefix("# provenance "))


def _value(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("_id"), value.alias("_value"))


def sdmx_series(table: DataFrame, base_period: str) -> DataFrame:
    """series and its generic SDMX-ML element, one row for each series of a publication table; a series' observations are one per period.

    A suppressed observation has status C and the rule as comment, a missing one status M, others a value.
    """
    t = sanitised(table)
    status = F.when(F.col("suppressed"), F.array(_value("OBS_STATUS", F.lit("C")), _value("OBS_COMMENT", F.col("suppression_rule")))).when(F.col("index").isNull(), F.array(_value("OBS_STATUS", F.lit("M"))))
    value = F.when(~F.col("suppressed") & F.col("index").isNotNull(), F.struct(F.format_string("%.6f", "index").alias("_value")))
    observation = F.struct(
        F.struct(F.date_format("period", "yyyy-MM").alias("_value")).alias("ObsDimension"), value.alias("ObsValue"), F.when(status.isNotNull(), F.struct(status.alias("Value"))).alias("Attributes")
    )
    s = t.groupBy("series").agg(F.max("basis").alias("basis"), F.array_sort(F.collect_list(F.struct("period", observation.alias("o")))).alias("all"))
    basis = F.when(F.col("basis") != "", F.array(_value("BASIS", F.col("basis")))).otherwise(F.array().cast("array<struct<_id:string,_value:string>>"))
    attributes = F.concat(F.array(_value("UNIT_MEASURE", F.lit("INDEX"))), basis, F.array(_value("BASE_PER", F.lit(base_period))))
    element = F.struct(
        F.struct(_value("SERIES", F.col("series")).alias("Value")).alias("SeriesKey"), F.struct(attributes.alias("Value")).alias("Attributes"), F.transform("all", lambda x: x["o"]).alias("Obs")
    )
    return s.select("series", F.to_xml(element, {"rowTag": "Series"}).alias("xml"))


def write_sdmx(table: DataFrame, path: str, provenance: str, *, message: str, prepared: str, sender: str, base_period: str) -> None:
    """An SDMX-ML 2.1 generic data message of a publication table: header, provenance as an annotation, a series for each series."""
    spaces = " ".join(f'xmlns:{k}="{v}"' for k, v in NAMESPACES.items())
    head = f"""<?xml version="1.0" encoding="UTF-8"?>
<message:GenericData {spaces}>
<message:Header><message:ID>{escape(message)}</message:ID><message:Test>false</message:Test><message:Prepared>{escape(prepared)}</message:Prepared><message:Sender id={quoteattr(sender)}/>
<message:Structure structureID="INDEX" dimensionAtObservation="TIME_PERIOD"><common:Structure><Ref agencyID={quoteattr(sender)} id="INDEX" version="1.0"/></common:Structure></message:Structure></message:Header>
<message:DataSet xmlns="{NAMESPACES["generic"]}" structureRef="INDEX" action="Information"><common:Annotations><common:Annotation><common:AnnotationTitle>provenance</common:AnnotationTitle><common:AnnotationText xml:lang="en">{escape(provenance)}</common:AnnotationText></common:Annotation></common:Annotations>"""
    ends = table.sparkSession.createDataFrame([(0, "", head), (2, "", "</message:DataSet>\n</message:GenericData>")], "part int, series string, line string")
    body = sdmx_series(table, base_period).select(F.lit(1).alias("part"), "series", F.col("xml").alias("line"))
    _text(ends.unionByName(body).select(F.struct("part", "series").alias("at"), "line"), path)


_VALUES = "array<struct<_id:string,_value:string>>"
SERIES = f"`SeriesKey` struct<`Value`:{_VALUES}>, `Attributes` struct<`Value`:{_VALUES}>, `Obs` array<struct<`ObsDimension`:struct<_value:string>,`ObsValue`:struct<_value:string>,`Attributes`:struct<`Value`:{_VALUES}>>>"


def read_sdmx(spark: SparkSession, path: str) -> DataFrame:
    """series, period (yyyy-MM), value, status, comment of the observations of a message, by Spark's XML source."""
    rows = spark.read.format("xml").option("rowTag", "Series").schema(SERIES).load(path)
    of = lambda values, name: F.get(F.filter(values, lambda v: v["_id"] == name), F.lit(0))["_value"]
    o = rows.select(of(F.col("`SeriesKey`")["Value"], "SERIES").alias("series"), F.explode("`Obs`").alias("o"))
    more = F.col("o")["Attributes"]["Value"]
    return o.select("series", F.col("o")["ObsDimension"]["_value"].alias("period"), F.col("o")["ObsValue"]["_value"].cast("double").alias("value"), of(more, "OBS_STATUS").alias("status"), of(more, "OBS_COMMENT").alias("comment"))


def sdmx_problems(spark: SparkSession, path: str) -> DataFrame:
    """series, period, problem: observations without a series or a month, twice in a series, without value and status or with both, and a header that is missing."""
    o = read_sdmx(spark, path)
    w = F.count("*").over(Window.partitionBy("series", "period"))
    problem = (
        F.when(F.col("series").isNull(), "no series")
        .when(~F.coalesce(F.col("period").rlike(r"^\d{4}-\d{2}$"), F.lit(False)), "no month")
        .when(F.col("n") > 1, "twice")
        .when(F.col("value").isNull() & F.col("status").isNull(), "neither value nor status")
        .when(F.col("value").isNotNull() & F.col("status").isNotNull(), "value and status")
    )
    found = o.withColumn("n", w).withColumn("problem", problem).filter("problem is not null").select("series", "period", "problem")
    head = spark.read.text(path).agg(F.count_if(F.col("value").contains("<message:ID>")).alias("n")).filter("n <> 1").select(F.lit(None).cast("string").alias("series"), F.lit(None).cast("string").alias("period"), F.lit("no header").alias("problem"))
    return found.unionByName(head)
