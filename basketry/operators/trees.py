"""Classification trees of any depth: registration, closure, weights, aggregation and contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.sources.staging import staged

NODE = "scheme string, code string, label string, level int, parent_code string"


class TreeError(ValueError):
    """The nodes are no forest, or the weights no weights."""


def new_nodes(registered: DataFrame, nodes: DataFrame, scheme: str) -> DataFrame:
    """The rows (NODE) that registering nodes (code, label, level, parent_code) under a scheme appends to the table.

    Codes are trimmed and blank parents are null. A code that the scheme has is left as it is, so loading a file twice
    or after half a load adds only what is missing; of several rows with one code the least in order of level, parent
    and label counts. Appending the result to the table is the load.
    """
    blank = F.trim(F.coalesce("parent_code", F.lit("")))
    n = nodes.select(F.lit(scheme).alias("scheme"), F.trim("code").alias("code"), "label", F.col("level").cast("int").alias("level"), F.nullif(blank, F.lit("")).alias("parent_code"))
    n = n.filter("code <> ''").groupBy("scheme", "code").agg(F.min(F.struct("level", "parent_code", "label")).alias("n")).select("scheme", "code", "n.label", "n.level", "n.parent_code")
    return n.join(registered.select("scheme", "code"), ["scheme", "code"], "left_anti")


def closure(tree: DataFrame) -> DataFrame:
    """code, ancestor, distance for all nodes of a tree (code, parent) and all their ancestors, themselves at 0.

    Paths are doubled: those of 2^k steps are joined with all found so far, so the rounds go with the logarithm of the
    depth. A parent without a row of its own is a root. Raises where a code has two parents or stands on a cycle.
    """
    edges = tree.filter("code is not null and parent is not null").select("code", F.col("parent").alias("ancestor")).distinct()
    found = staged(edges.withColumn("distance", F.lit(1)), "closure")
    if two := found.groupBy("code").agg(F.count("*").alias("n")).filter("n > 1").orderBy("code").limit(5).collect():
        raise TreeError(f"codes with several parents: {[r['code'] for r in two]}")
    reach = 1
    while True:
        if on := found.filter("code = ancestor").orderBy("code").limit(5).collect():
            raise TreeError(f"codes that are their own ancestors: {[r['code'] for r in on]}")
        ends = found.filter(F.col("distance") == reach).select("code", F.col("ancestor").alias("mid"))
        on = found.select(F.col("code").alias("mid"), "ancestor", "distance")
        more = ends.join(on, "mid").select("code", "ancestor", (F.col("distance") + reach).alias("distance"))
        found = staged(found.unionByName(more), "closure")
        if found.filter(F.col("distance") > reach).isEmpty():
            break
        reach *= 2
    nodes = tree.select("code").unionByName(tree.select(F.col("parent").alias("code"))).filter("code is not null").distinct()
    return found.unionByName(nodes.select("code", F.col("code").alias("ancestor"), F.lit(0).alias("distance")))


def depths(closed: DataFrame) -> DataFrame:
    """code, depth: the number of ancestors."""
    return closed.groupBy("code").agg(F.max("distance").alias("depth"))


def parent_map_for(tree: DataFrame, categories: DataFrame) -> DataFrame | None:
    """code, parent of the categories (column category) and all their ancestors; None if one of them is no code of the tree."""
    wanted = categories.select(F.col("category").cast("string").alias("code")).filter("code is not null").distinct()
    codes = tree.select("code").distinct()
    if wanted.isEmpty() or not wanted.join(codes, "code", "left_anti").isEmpty():
        return None
    keep = closure(tree).join(wanted, "code", "left_semi").select(F.col("ancestor").alias("code")).distinct()
    return keep.join(tree.select("code", "parent").distinct(), "code", "left")


def weight_problems(weights: DataFrame, tree: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """parent, children, total, weight, difference of nodes whose weight is not the sum of their children's.

    weights has code and weight. Nodes without a weight, or with a child without one, are no inconsistency. Weights
    that are decimals are compared exactly; sums of doubles may differ by their rounding.
    """
    edges = tree.filter("parent is not null").select("code", "parent").distinct()
    kids = edges.join(weights.select("code", F.col("weight").alias("w")), "code", "left")
    sums = kids.groupBy("parent").agg(F.count("*").alias("children"), F.count("w").alias("known"), F.sum("w").alias("total")).filter("children = known")
    j = sums.join(weights.select(F.col("code").alias("parent"), "weight"), "parent").filter("weight is not null")
    return j.withColumn("difference", F.col("total") - F.col("weight")).filter(F.abs("difference") > tolerance).select("parent", "children", *[F.col(c).cast("double").alias(c) for c in ("total", "weight", "difference")])


def aggregate_tree(levels: DataFrame, weights: DataFrame, tree: DataFrame) -> DataFrame:
    """code, period, index, weight, depth of every leaf and of every node above one.

    levels has code, period and index of the leaves, weights their code and weight. A node is the weighted mean of its
    children, which unfolds to the weighted sum of its leaves over their whole weight, whether or not a leaf has a
    level in the period: one grouping of leaves by ancestor gives all levels of a tree of any depth. A leaf without a
    weight counts nowhere above it; a node that has levels of its own stands for all below it.
    Raises on negative weights.
    """
    if bad := weights.filter("weight < 0").select("code").orderBy("code").limit(5).collect():
        raise TreeError(f"negative weights: {[r['code'] for r in bad]}")
    closed = closure(tree)
    leaves = levels.filter("code is not null").select("code").distinct()
    up = leaves.join(closed.filter("distance > 0"), "code")
    own = up.join(leaves.select(F.col("code").alias("ancestor")), "ancestor", "left_semi").groupBy("code").agg(F.min("distance").alias("stop"))
    up = up.join(own, "code", "left").filter("stop is null or distance < stop").select("code", F.col("ancestor").alias("node"))
    known = weights.filter("weight is not null and not isnan(weight)").select("code", F.col("weight").alias("w"))
    weighed = up.join(known, "code")
    whole = weighed.groupBy("node").agg(F.sum("w").alias("weight"))
    sums = levels.filter("index is not null").join(weighed, "code").groupBy("node", "period").agg(F.sum(F.col("w") * F.col("index")).alias("s"))
    nodes = sums.join(whole, "node").filter("weight > 0").select(F.col("node").alias("code"), "period", (F.col("s") / F.col("weight")).alias("index"), "weight")
    below = levels.select("code", "period", "index").join(known.withColumnRenamed("w", "weight"), "code", "left")
    return below.unionByName(nodes).join(depths(closed), "code", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def unweighted_leaves(levels: DataFrame, weights: DataFrame) -> DataFrame:
    """code of the leaves that have levels and no finite weight: they count nowhere above."""
    known = weights.filter("weight is not null and not isnan(weight)").select("code")
    return levels.select("code").distinct().join(known, "code", "left_anti")


def contribution_table(aggregated: DataFrame, start, end) -> DataFrame:
    """code, parts of the change from start to end of the nodes given: weight, level_start, level_end, change_pct, contribution_pp.

    aggregated is a part of aggregate_tree()'s result, say the children of one node; contributions sum to the change
    of their weighted mean. Nodes without a weight or a level at either end are left out.
    """
    at = lambda p: F.max(F.when(F.col("period") == F.lit(p).cast("date"), F.col("index")))
    t = aggregated.filter("weight is not null").groupBy("code").agg(F.max("weight").alias("weight"), at(start).alias("level_start"), at(end).alias("level_end")).filter("level_start is not null and level_end is not null")
    base = t.agg(F.sum(F.col("weight") * F.col("level_start")).alias("base"))
    move = F.col("level_end") - F.col("level_start")
    return t.join(F.broadcast(base)).select("code", "weight", "level_start", "level_end", (move / F.col("level_start") * 100).alias("change_pct"), (F.col("weight") * move / F.col("base") * 100).alias("contribution_pp"))  # one row


def hicp_parent(code):
    """The parent of a code: two digits for a division, one more for a group; CP00 is the root."""
    return F.when(code == "CP00", None).when(F.length(code) == 4, "CP00").otherwise(F.substring(code, 1, 4))


def hicp_tree(indices: DataFrame, weights: DataFrame, year: int, tolerance: float = 0.01) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Levels, leaves and notes of one year's tree of divisions and groups.

    indices has coicop, period (month) and value; weights coicop, year and value, per mille. Levels (coicop, period,
    index) run from December of the year before, which is 100, to December of the year; a series without an index in that
    December has null ones, and keeps its weight. Leaves (code, parent, weight)
    are the groups of a division that cover its weight within tolerance, else the division itself; notes (division,
    groups, covered, weight) name divisions taken as leaves although they have groups.
    Raises if December of the year before has no index, or the year no weights.
    """
    at = F.make_date(F.lit(year - 1), F.lit(12), F.lit(1))
    base = indices.filter(F.col("period") == at).select("coicop", F.col("value").alias("base"))
    w = weights.filter(F.col("year") == year).select(F.col("coicop").cast("string").alias("code"), F.col("value").cast("double").alias("weight"))
    if base.isEmpty():
        raise TreeError(f"no index for December {year - 1}, where the weights of {year} begin")
    if w.isEmpty():
        raise TreeError(f"no weights for {year}")
    span = indices.filter((F.col("period") >= at) & (F.year("period") <= year))
    levels = span.join(base, "coicop", "left").select("coicop", "period", (F.col("value") / F.col("base") * 100).alias("index"))
    w = w.join(span.select(F.col("coicop").alias("code")).distinct(), "code", "left_semi")
    divisions = w.filter("length(code) = 4 and code <> 'CP00'")
    groups = w.filter("length(code) = 5").withColumn("parent", hicp_parent(F.col("code")))
    covered = groups.groupBy("parent").agg(F.sum("weight").alias("covered"), F.sort_array(F.collect_list("code")).alias("groups"))
    d = divisions.join(covered, divisions.code == covered.parent, "left").drop("parent")
    fits = F.coalesce(F.abs(F.col("covered") - F.col("weight")) <= tolerance * F.greatest(F.col("weight"), F.lit(1e-12)) + 0.05, F.lit(False))
    split = d.filter(fits).select(F.col("code").alias("parent"))
    leaves = d.filter(~fits).select("code", F.lit("CP00").alias("parent"), "weight").unionByName(groups.join(split, "parent", "left_semi").select("code", "parent", "weight"))
    notes = d.filter(~fits & F.col("groups").isNotNull()).select(F.col("code").alias("division"), "groups", "covered", "weight")
    return levels, leaves, notes
