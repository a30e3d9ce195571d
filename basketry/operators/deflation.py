"""Deflation of many series in one plan, and conversion at purchasing power parities.

A series is all rows with one name in `series`: (series, period, value). Nothing is resampled or extrapolated silently.
What cannot be done is told in a table (series, reason) beside each function, and left out of its result; `require`
turns such a table into an error. Rows whose value is null or NaN do not exist for any of these functions; a period that
a series has twice makes it irregular; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTHS = {"M": 1, "Q": 3, "A": 12}
WORDS = {"M": "monthly", "Q": "quarterly", "A": "annual"}


class DeflationError(ValueError):
    """A series that cannot be deflated or converted as asked."""


def require(refusals: DataFrame, shown: int = 5) -> None:
    """Raises DeflationError with the first reasons, if there are any."""
    rows = refusals.orderBy("series").limit(shown).collect()
    if rows:
        raise DeflationError("; ".join(f"{r['series']}: {r['reason']}" for r in rows))


def _known(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def _table(words: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in words.items() for x in kv])[key]


def frequencies(series: DataFrame, name: str = "series", value: str = "value") -> DataFrame:
    """name, periods, shortest, longest (steps in months), frequency: M, Q, A by equal steps of 1, 3, 12; else null.

    Read off the periods, not off what a series says of itself.
    """
    month = F.year("period") * 12 + F.month("period")
    steps = _known(series, value).select(name, (month - F.lag(month).over(Window.partitionBy(name).orderBy("period"))).alias("step"))
    out = steps.groupBy(name).agg(F.count("*").alias("periods"), F.min("step").alias("shortest"), F.max("step").alias("longest"))
    code = F.coalesce(*[F.when((F.col("shortest") == n) & (F.col("longest") == n), F.lit(c)) for c, n in MONTHS.items()])
    return out.withColumn("frequency", code)


def _shape_reason(what: str) -> Column:
    """Why a series of `frequencies` has no frequency; null if it has one."""
    few = F.when(F.col("periods") < 2, F.lit(f"{what} has fewer than two periods"))
    odd = F.when(F.col("frequency").isNull(), F.concat(F.lit(f"{what} has steps of "), F.col("shortest").cast("string"), F.lit(" to "), F.col("longest").cast("string"), F.lit(" months")))
    return F.coalesce(few, odd)


def conversion_refusals(series: DataFrame, target: str) -> DataFrame:
    """series, reason: irregular series, and those already less frequent than the target."""
    finer = F.when(_table(MONTHS, F.col("frequency")) > MONTHS[target], F.concat(F.lit("the series is "), _table(WORDS, F.col("frequency")), F.lit(f", {WORDS[target]} periods would be invented")))
    return frequencies(series).select("series", F.coalesce(_shape_reason("the series"), finer).alias("reason")).filter("reason is not null")


def to_frequency(series: DataFrame, target: str, how: str = "mean") -> DataFrame:
    """series, period, value at a lower frequency (M, Q, A): the mean, last or sum of whole spans; others are left out."""
    span = MONTHS[target]
    take = {"mean": F.avg("value"), "last": F.max_by("value", "period"), "sum": F.sum("value")}[how]
    per = frequencies(series).select("series", (F.lit(span) / _table(MONTHS, F.col("frequency"))).alias("per")).filter("per >= 1")
    start = F.make_date(F.year("period"), (F.floor((F.month("period") - 1) / span) * span + 1).cast("int"), F.lit(1))
    spans = _known(series).groupBy("series", start.alias("_start")).agg(take.alias("value"), F.count("*").alias("_n"))
    return spans.join(per, "series").filter("_n = per").select("series", F.col("_start").alias("period"), "value")


# --- deflation ---


def _referred(reference: str) -> Column:
    """Whether a period belongs to the reference: a year ('1997') or one period ('1997-06-01')."""
    return F.year("period") == int(reference) if reference.isdigit() else F.col("period") == F.to_date(F.lit(reference))


def reference_levels(deflators: DataFrame, reference: str) -> DataFrame:
    """deflator, level, found, expected: the mean in the reference year, or the value of the reference period.

    The level is null where the year is not whole or the period not observed.
    """
    f = frequencies(deflators, "deflator", "index").select("deflator", "frequency")
    hit = _known(deflators, "index").groupBy("deflator").agg(F.avg(F.when(_referred(reference), F.col("index"))).alias("mean"), F.count(F.when(_referred(reference), 1)).alias("found"))
    wanted = (F.lit(12) / _table(MONTHS, F.col("frequency"))).cast("long") if reference.isdigit() else F.lit(1).cast("long")
    out = hit.join(f, "deflator").withColumn("expected", wanted)
    return out.select("deflator", F.when(F.col("found") == F.col("expected"), F.col("mean")).alias("level"), "found", "expected")


def refusals(nominal: DataFrame, deflators: DataFrame, reference: str, allow_partial: bool = False) -> DataFrame:
    """series, reason: why a series of nominal (series, deflator, period, value) is not deflated; the first that applies.

    deflators: deflator, period, index. Irregular or short series and deflators, unknown deflators, unlike frequencies,
    deflators of 0 or less, periods without a deflator (unless allow_partial), references that are not observed whole.
    """
    names = _known(nominal).groupBy("series").agg(F.min("deflator").alias("deflator"), F.count_distinct("deflator").alias("deflators"))
    own = frequencies(nominal).select("series", F.col("frequency").alias("own"), _shape_reason("the series").alias("r1"))
    theirs = frequencies(deflators, "deflator", "index").select("deflator", F.col("frequency").alias("their"), _shape_reason("the deflator").alias("r3"))
    low = _known(deflators, "index").groupBy("deflator").agg(F.min("index").alias("lowest"))
    at = reference_levels(deflators, reference).select("deflator", "level", "found", "expected")
    gaps = _known(nominal).join(_known(deflators, "index").select("deflator", "period"), ["deflator", "period"], "left_anti").groupBy("series").agg(F.count("*").alias("gaps"))
    about = theirs.join(low, "deflator").join(at, "deflator")
    j = names.join(own, "series").join(about, "deflator", "left").join(gaps, "series", "left")
    reason = F.coalesce(
        "r1",
        F.when(F.col("deflators") != 1, F.lit("the series names no deflator, or several")),
        F.when(F.col("lowest").isNull(), F.lit("the deflator is unknown")),
        "r3",
        F.when(F.col("own") != F.col("their"), F.concat(F.lit("the series is "), _table(WORDS, F.col("own")), F.lit(", the deflator "), _table(WORDS, F.col("their")))),
        F.when(F.col("lowest") <= 0, F.lit("the deflator has values of 0 or less")),
        F.when(F.col("gaps").isNotNull() & F.lit(not allow_partial), F.concat(F.lit("the deflator lacks "), F.col("gaps").cast("string"), F.lit(" periods of the series"))),
        F.when(F.col("level").isNull(), F.concat(F.lit(f"of the reference {reference} the deflator has "), F.col("found").cast("string"), F.lit(" of "), F.col("expected").cast("string"), F.lit(" periods"))),
    )
    return j.select("series", reason.alias("reason")).filter("reason is not null")


def deflate(nominal: DataFrame, deflators: DataFrame, reference: str, allow_partial: bool = False) -> DataFrame:
    """series, period, nominal, deflator (reference = 100), real, of the series that are not refused."""
    level = reference_levels(deflators, reference).filter("level is not null").select("deflator", "level")
    base = _known(deflators, "index").join(level, "deflator").select("deflator", "period", (F.col("index") / F.col("level") * 100).alias("rebased"))
    kept = _known(nominal).join(refusals(nominal, deflators, reference, allow_partial), "series", "left_anti")
    j = kept.join(base, ["deflator", "period"])
    return j.select("series", "period", F.col("value").alias("nominal"), F.col("rebased").alias("deflator"), (F.col("value") / (F.col("rebased") / 100)).alias("real"))


def labels(nominal: DataFrame, deflators: DataFrame, reference: str, kind: str = "real value", allow_partial: bool = False) -> DataFrame:
    """series, label, left_out: what stands beside a real series; left_out counts the periods without a deflator.

    kind is 'real wage', 'real income', 'constant price value' or the like.
    """
    kept = _known(nominal).join(refusals(nominal, deflators, reference, allow_partial), "series", "left_anti")
    seen = _known(deflators, "index").select("deflator", "period", F.lit(1).alias("_seen"))
    j = kept.join(seen, ["deflator", "period"], "left").groupBy("series", "deflator").agg(F.count(F.when(F.col("_seen").isNull(), 1)).alias("left_out"))
    j = j.join(frequencies(nominal).select("series", "frequency"), "series")
    text = F.format_string(f"%s, {kind} in prices of {reference}, deflated by %s ({reference} = 100), %s", "series", "deflator", _table(WORDS, F.col("frequency")))
    return j.select("series", text.alias("label"), "left_out")


def growth(real: DataFrame, horizon: int = 1) -> DataFrame:
    """series, period, nominal_growth, inflation, real_growth, approximation, error: percent over `horizon` periods.

    Real growth is (1 + nominal) / (1 + inflation) - 1; the approximation is the difference, error what it is off by.
    """
    w = Window.partitionBy("series").orderBy("period")
    n, p = (F.col(c) / F.lag(c, horizon).over(w) - 1 for c in ("nominal", "deflator"))
    g = real.select("series", "period", n.alias("n"), p.alias("p")).filter("n is not null")
    exact = (1 + F.col("n")) / (1 + F.col("p")) - 1
    rough = F.col("n") - F.col("p")
    return g.select("series", "period", (F.col("n") * 100).alias("nominal_growth"), (F.col("p") * 100).alias("inflation"), (exact * 100).alias("real_growth"), (rough * 100).alias("approximation"), ((rough - exact) * 100).alias("error"))


def volume_index(real: DataFrame, reference: str) -> DataFrame:
    """series, period, index: the real series, mean of the reference = 100.

    Of a reference year all periods have to be there (12, 4 or 1 by the series' frequency); else the series has no rows.
    """
    f = frequencies(real, value="real").select("series", "frequency")
    base = _known(real, "real").filter(_referred(reference)).groupBy("series").agg(F.avg("real").alias("base"), F.count("*").alias("found")).join(f, "series")
    wanted = F.lit(12) / _table(MONTHS, F.col("frequency")) if reference.isdigit() else F.lit(1)
    whole = base.filter((F.col("found") == wanted) & (F.col("base") != 0)).select("series", "base")
    return real.join(whole, "series").select("series", "period", (F.col("real") / F.col("base") * 100).alias("index"))


# --- purchasing power parities ---


def parity_refusals(values: DataFrame, parities: DataFrame, broadcast_annual: bool = False) -> DataFrame:
    """series, reason: why values (series, period, value) are not converted at parities (series, period, ppp).

    Irregular series, unlike frequencies (annual parities are held through the year only if broadcast_annual is set),
    periods or years without a parity, parities of 0 or less.
    """
    own = frequencies(values).select("series", F.col("frequency").alias("own"), _shape_reason("the series").alias("r1"))
    theirs = frequencies(parities, value="ppp").select("series", F.col("frequency").alias("their"), _shape_reason("the parity").alias("r2"))
    low = _known(parities, "ppp").groupBy("series").agg(F.min("ppp").alias("lowest"))
    gaps = _converted(values, parities, broadcast_annual).filter("ppp is null").groupBy("series").agg(F.count("*").alias("gaps"))
    j = own.join(theirs.join(low, "series"), "series", "left").join(gaps, "series", "left")
    held = (F.col("their") == "A") & F.lit(broadcast_annual)
    reason = F.coalesce(
        "r1",
        F.when(F.col("lowest").isNull(), F.lit("there is no parity")),
        "r2",
        F.when((F.col("own") != F.col("their")) & ~held, F.concat(F.lit("the series is "), _table(WORDS, F.col("own")), F.lit(", the parity "), _table(WORDS, F.col("their")))),
        F.when(F.col("gaps").isNotNull(), F.concat(F.col("gaps").cast("string"), F.lit(" periods have no parity"))),
        F.when(F.col("lowest") <= 0, F.lit("the parity has values of 0 or less")),
    )
    return j.select("series", reason.alias("reason")).filter("reason is not null")


def _converted(values: DataFrame, parities: DataFrame, broadcast_annual: bool) -> DataFrame:
    """Values with the parity of their period, or of their year where the parity is annual and that is asked for."""
    p = _known(parities, "ppp").select("series", "period", "ppp")
    out = _known(values).join(p, ["series", "period"], "left")
    if broadcast_annual:
        annual = frequencies(parities, value="ppp").filter("frequency = 'A'").select("series")
        years = p.join(annual, "series").select("series", F.year("period").alias("_year"), F.col("ppp").alias("_held"))
        out = out.withColumn("_year", F.year("period")).join(years, ["series", "_year"], "left").withColumn("ppp", F.coalesce("_held", "ppp")).drop("_year", "_held")
    return out


def convert(values: DataFrame, parities: DataFrame, broadcast_annual: bool = False) -> DataFrame:
    """series, period, value, ppp, converted (value / ppp), of the series that are not refused."""
    kept = _converted(values, parities, broadcast_annual).join(parity_refusals(values, parities, broadcast_annual), "series", "left_anti")
    return kept.select("series", "period", "value", "ppp", (F.col("value") / F.col("ppp")).alias("converted"))


def price_levels(parities: DataFrame, rates: DataFrame) -> DataFrame:
    """series, period, index: parity over exchange rate (series, period, rate), times 100, in the periods both have.

    Series whose parity and rate differ in frequency, or are irregular, have no rows.
    """
    f = frequencies(parities, value="ppp").select("series", "frequency").join(frequencies(rates, value="rate").select("series", F.col("frequency").alias("_f")), "series")
    alike = f.filter("frequency = _f").select("series")
    j = _known(parities, "ppp").join(_known(rates, "rate").select("series", "period", "rate"), ["series", "period"]).join(alike, "series")
    return j.filter("rate <> 0").select("series", "period", (F.col("ppp") / F.col("rate") * 100).alias("index"))
