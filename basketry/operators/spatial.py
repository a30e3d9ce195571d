"""Which regions a spatial comparison can hold: reachability, thin overlaps, published parities and their use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.operators.domain import country_product_dummy, spatial_geary_khamis
from basketry.sources.staging import staged


class SpatialError(ValueError):
    """The comparison is not possible."""


def reached_regions(prices: DataFrame, base: str) -> DataFrame:
    """region: those that a chain of shared products links with the base, the base included.

    A frontier of regions is widened by semi joins, to the products they price and on to the regions that price those,
    until nothing is added; products and regions met before are left out of the next round.
    Raises if the base prices nothing.
    """
    priced = staged(prices.filter("region is not null and product is not null and price is not null").select("region", "product").distinct(), "priced")
    frontier = staged(priced.filter(F.col("region") == base).select("region").distinct(), "frontier")
    if frontier.isEmpty():
        raise SpatialError(f"the base region {base!r} has no prices")
    reached, left = frontier, priced
    while True:
        products = left.join(frontier, "region", "left_semi").select("product").distinct()
        left = staged(left.join(frontier, "region", "left_anti"), "left")
        frontier = staged(left.join(products, "product", "left_semi").select("region").distinct(), "frontier")
        if frontier.isEmpty():
            return reached
        reached = staged(reached.unionByName(frontier), "reached")


def overlaps(prices: DataFrame) -> DataFrame:
    """region, other, matched: products priced in both, for regions that share one; a self-join grouped at once."""
    p = prices.filter("region is not null and product is not null and price is not null").select("region", "product").distinct()
    return p.join(p.withColumnRenamed("region", "other"), "product").filter("region <> other").groupBy("region", "other").agg(F.count("*").alias("matched"))


def thin_pairs(prices: DataFrame, least: int = 5) -> DataFrame:
    """region_a < region_b and matched for pairs of regions that share fewer than `least` products, none included."""
    prices = staged(prices.select("region", "product", "price"), "prices")
    regions = prices.filter("price is not null and product is not null").select("region").filter("region is not null").distinct()
    every = regions.agg(F.collect_set("region").alias("all"))
    pairs = regions.join(F.broadcast(every)).select(F.col("region").alias("region_a"), F.explode("all").alias("region_b")).filter("region_a < region_b")  # one row of regions
    known = overlaps(prices).select(F.col("region").alias("region_a"), F.col("other").alias("region_b"), "matched")
    return pairs.join(known, ["region_a", "region_b"], "left").withColumn("matched", F.coalesce("matched", F.lit(0))).filter(F.col("matched") < least)


def withholding(prices: DataFrame, base: str, least: int = 5) -> DataFrame:
    """region, shared (the most products with any one other region), reason: unreachable, thin or null.

    A parity is published if a chain of shared products reaches the region from the base and it shares `least` products
    with one other region; the base always is.
    """
    prices = staged(prices.select("region", "product", "price"), "prices")
    regions = prices.filter("region is not null and product is not null and price is not null").select("region").distinct()
    best = overlaps(prices).groupBy("region").agg(F.max("matched").alias("shared"))
    reached = reached_regions(prices, base).withColumn("reached", F.lit(True))
    j = regions.join(best, "region", "left").join(reached, "region", "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    reason = F.when(F.col("reached").isNull(), "unreachable").when((F.col("region") != base) & (F.col("shared") < least), "thin")
    return j.select("region", "shared", reason.alias("reason"))


def parities(prices: DataFrame, base: str, method: str = "cpd", least: int = 5) -> DataFrame:
    """region, estimated, published, shared, reason.

    method is cpd, wcpd (weighted by expenditure shares) or gk. Only regions that the base reaches are estimated; a
    thin one has an estimate that is not published. Raises on prices that are not positive, on a region that prices a
    product twice, and if no other region is reached.
    """
    prices = staged(prices, "prices")
    if not prices.filter("price <= 0").isEmpty():
        raise SpatialError("prices must be positive")
    if not prices.groupBy("region", "product").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise SpatialError("a region prices a product more than once")
    held = staged(withholding(prices, base, least), "held")
    reached = held.filter("reason is null or reason <> 'unreachable'").select("region")
    if reached.limit(2).count() < 2:
        raise SpatialError(f"no region is connected to {base!r} through shared products")
    part = prices.join(reached, "region", "left_semi")
    found = spatial_geary_khamis(part, base) if method == "gk" else country_product_dummy(part, base, weighted=method == "wcpd")
    return held.join(found.withColumnRenamed("parity", "estimated"), "region", "left").select("region", "estimated", F.when(F.col("reason").isNull(), F.col("estimated")).alias("published"), "shared", "reason")


def convert(values: DataFrame, published: DataFrame) -> DataFrame:
    """region, local, parity, converted, reason: local values over published parities; a withheld region keeps its reason."""
    p = published.select("region", F.col("published").alias("parity"), F.coalesce("reason", F.lit("")).alias("reason"))
    return values.select("region", F.col("value").alias("local")).join(p, "region", "left").select("region", "local", "parity", (F.col("local") / F.col("parity")).alias("converted"), F.coalesce("reason", F.lit("no parity")).alias("reason"))


def price_levels(published: DataFrame, rates: DataFrame) -> DataFrame:
    """region, level: published parity over the exchange rate (region, rate), times 100. Raises if no region has both."""
    out = published.filter("published is not null").join(rates, "region").select("region", (F.col("published") / F.col("rate") * 100).alias("level"))
    if out.isEmpty():
        raise SpatialError("no region has both a published parity and an exchange rate")
    return out
