"""Trees, spatial reachability, stored layers: rules, refusals and small worked cases."""

import datetime
import random
import uuid

import pytest

from basketry.operators import spatial, trees
from basketry.operators.governance import frame_hash
from basketry.sources import layers
from basketry.sources.staging import numbered

DAY = datetime.date


def tree_of(spark, pairs):
    return spark.createDataFrame(pairs, "code string, parent string")


# --- trees ---


def test_closure_of_any_depth(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(21)] + [("x", "n3"), ("alone", None)]
    got = {(r["code"], r["ancestor"]): r["distance"] for r in trees.closure(tree_of(spark, chain)).collect()}
    want = {(f"n{i}", f"n{j}"): i - j for i in range(21) for j in range(i + 1)} | {("x", "x"): 0, ("alone", "alone"): 0} | {("x", f"n{j}"): 4 - j for j in range(4)}
    assert got == want


@pytest.mark.parametrize("length", [1, 2, 3, 8])
def test_closure_refuses_cycles(spark, length):
    ring = [(f"c{i}", f"c{(i + 1) % length}") for i in range(length)] + [("leaf", "c0")]
    with pytest.raises(trees.TreeError, match="own ancestors"):
        trees.closure(tree_of(spark, ring))


def test_closure_refuses_two_parents(spark):
    with pytest.raises(trees.TreeError, match="several parents.*'a'"):
        trees.closure(tree_of(spark, [("a", "b"), ("a", "c")]))


def test_dangling_parent_is_a_root(spark):
    got = {tuple(r) for r in trees.closure(tree_of(spark, [("a", "gone")])).collect()}
    assert got == {("a", "gone", 1), ("a", "a", 0), ("gone", "gone", 0)}


def test_parent_map_for(spark):
    t = tree_of(spark, [("1", None), ("1.1", "1"), ("1.1.1", "1.1"), ("2", None)])
    used = lambda *c: spark.createDataFrame([(x,) for x in c], "category string")
    assert {tuple(r) for r in trees.parent_map_for(t, used("1.1.1")).collect()} == {("1.1.1", "1.1"), ("1.1", "1"), ("1", None)}
    assert trees.parent_map_for(t, used("1.1", "no code")) is None
    assert trees.parent_map_for(t, used()) is None


def test_new_nodes_are_added_once(spark):
    nodes = spark.createDataFrame([(" 01 ", "Food", 1, ""), ("01.1", "Bread", 2, " 01 "), ("01.1", "Bread again", 2, "01"), ("", "blank", 1, None)], "code string, label string, level int, parent_code string")
    none = spark.createDataFrame([], trees.NODE)
    first = trees.new_nodes(none, nodes, "S")
    assert {tuple(r) for r in first.collect()} == {("S", "01", "Food", 1, None), ("S", "01.1", "Bread", 2, "01")}
    assert trees.new_nodes(first, nodes, "S").count() == 0
    assert trees.new_nodes(first, nodes, "T").count() == 2


def test_weight_problems(spark):
    t = tree_of(spark, [("a", None), ("a1", "a"), ("a2", "a"), ("b1", "b"), ("c1", "c"), ("c2", "c")])
    w = spark.createDataFrame([("a", 3.0), ("a1", 1.0), ("a2", 2.5), ("b", 2.0), ("b1", 2.0), ("c", 1.0), ("c1", 5.0)], "code string, weight double")
    assert [tuple(r) for r in trees.weight_problems(w, t).collect()] == [("a", 2, 3.5, 3.0, 0.5)]  # c2 has no weight


def aggregate_by_hand(levels, weights, parent):
    """Depth first, children before parents."""
    index, weight = {c: dict(p) for c, p in levels.items()}, dict(weights)
    kids = {}
    for c, p in parent.items():
        kids.setdefault(p, []).append(c)

    def up(node):
        for k in kids.get(node, []):
            up(k)
        own = [k for k in kids.get(node, []) if k in weight and k in index]
        if node is not None and own and node not in levels:
            total = sum(weight[k] for k in own)
            periods = {p for k in own for p in index[k]}
            index[node] = {p: sum(weight[k] * index[k][p] for k in own if p in index[k]) / total for p in periods}
            weight[node] = total

    up(None)
    return index, weight


def test_aggregate_tree_by_hand(spark):
    rng = random.Random(3)
    parent = {"r": None}
    for i in range(40):
        parent[f"n{i}"] = rng.choice([c for c in parent])
    leaves = [c for c in parent if c not in parent.values()] + ["n3"]  # n3 may stand for all below it
    levels = {c: {DAY(2020, m, 1): rng.uniform(50, 150) for m in range(1, 5) if rng.random() < 0.8} for c in leaves}
    levels = {c: p for c, p in levels.items() if p}
    weights = {c: rng.uniform(1, 5) for c in levels if rng.random() < 0.9}
    got = trees.aggregate_tree(
        spark.createDataFrame([(c, p, v) for c, its in levels.items() for p, v in its.items()], "code string, period date, index double"),
        spark.createDataFrame(list(weights.items()), "code string, weight double"),
        tree_of(spark, list(parent.items())),
    )
    index, weight = aggregate_by_hand(levels, weights, parent)
    found = {(r["code"], r["period"]): (r["index"], r["weight"]) for r in got.collect()}
    assert found.keys() == {(c, p) for c, its in index.items() for p in its}
    for (c, p), (i, w) in found.items():
        assert i == pytest.approx(index[c][p]) and (w is None) == (c not in weight) and (w is None or w == pytest.approx(weight[c]))


def test_aggregate_tree_refuses_negative_weights(spark):
    levels = spark.createDataFrame([("a", DAY(2020, 1, 1), 100.0)], "code string, period date, index double")
    with pytest.raises(trees.TreeError, match="negative weights"):
        trees.aggregate_tree(levels, spark.createDataFrame([("a", -1.0)], "code string, weight double"), tree_of(spark, [("a", None)]))


def test_contributions_add_up(spark):
    rows = [(c, DAY(2020, m, 1), i, w, 1) for c, w, its in (("a", 2.0, (100.0, 110.0)), ("b", 3.0, (90.0, 80.0)), ("c", None, (1.0, 2.0))) for m, i in zip((1, 2), its, strict=True)]
    got = trees.contribution_table(spark.createDataFrame(rows, "code string, period date, index double, weight double, depth int"), "2020-01-01", "2020-02-01").collect()
    assert {r["code"] for r in got} == {"a", "b"}
    assert sum(r["contribution_pp"] for r in got) == pytest.approx(((2 * 110 + 3 * 80) / (2 * 100 + 3 * 90) - 1) * 100)


def test_hicp_tree(spark):
    months = [DAY(2023, 12, 1), DAY(2024, 1, 1)]
    index = {"CP00": (80, 82), "CP01": (50, 51), "CP011": (40, 44), "CP012": (60, 60), "CP08": (10, 20), "CP081": (10, 10)}
    rows = [(c, m, float(v)) for c, its in index.items() for m, v in zip(months, its, strict=True)]
    weights = [("CP00", 1000.0), ("CP01", 600.0), ("CP011", 200.0), ("CP012", 400.0), ("CP08", 400.0), ("CP081", 30.0)]
    i = spark.createDataFrame(rows, "coicop string, period date, value double")
    w = spark.createDataFrame([(c, 2024, v) for c, v in weights], "coicop string, year int, value double")
    levels, leaves, notes = trees.hicp_tree(i, w, 2024)
    assert {tuple(r) for r in leaves.collect()} == {("CP011", "CP01", 200.0), ("CP012", "CP01", 400.0), ("CP08", "CP00", 400.0)}
    assert [tuple(r) for r in notes.collect()] == [("CP08", ["CP081"], 30.0, 400.0)]
    assert {r["index"] for r in levels.filter("period = '2023-12-01'").collect()} == {100.0}
    with pytest.raises(trees.TreeError, match="December 2019"):
        trees.hicp_tree(i, w, 2020)
    with pytest.raises(trees.TreeError, match="no weights"):
        trees.hicp_tree(i, w.filter("year = 1"), 2024)


# --- spatial ---

PRICES = [("A", "x", 1.0), ("B", "x", 2.0), ("B", "y", 3.0), ("C", "y", 4.0), ("D", "z", 5.0), ("E", "z", 6.0), ("E", None, 1.0), (None, "x", 1.0)]


def test_reached_by_a_chain(spark):
    p = spark.createDataFrame(PRICES, "region string, product string, price double")
    assert {r[0] for r in spatial.reached_regions(p, "A").collect()} == {"A", "B", "C"}
    assert {r[0] for r in spatial.reached_regions(p, "E").collect()} == {"D", "E"}
    with pytest.raises(spatial.SpatialError, match="'Z'"):
        spatial.reached_regions(p, "Z")
    held = {r["region"]: (r["shared"], r["reason"]) for r in spatial.withholding(p, "A", 1).collect()}
    assert held == {"A": (1, None), "B": (1, None), "C": (1, None), "D": (1, "unreachable"), "E": (1, "unreachable")}
    held = {r["region"]: r["reason"] for r in spatial.withholding(p, "A", 2).collect()}
    assert held["A"] is None and held["C"] == "thin" and held["D"] == "unreachable"
    thin = {(r["region_a"], r["region_b"]): r["matched"] for r in spatial.thin_pairs(p, 1).collect()}
    assert thin == {k: 0 for k in [("A", "C"), ("A", "D"), ("A", "E"), ("B", "D"), ("B", "E"), ("C", "D"), ("C", "E")]}


def test_parities_of_the_connected_part(spark):
    """Two regions that buy equal quantities: country-product dummies give the geometric mean of the ratios."""
    rows = [("A", "x", 1.0, 1.0, 1.0), ("A", "y", 1.0, 1.0, 1.0), ("B", "x", 2.0, 1.0, 2.0), ("B", "y", 4.0, 1.0, 4.0), ("C", "z", 9.0, 1.0, 9.0)]
    p = spark.createDataFrame(rows, "region string, product string, price double, quantity double, expenditure double")
    got = {r["region"]: r for r in spatial.parities(p, "A", least=2).collect()}
    assert got["B"]["published"] == pytest.approx(8**0.5) and got["A"]["published"] == 1
    assert got["C"]["estimated"] is None and got["C"]["reason"] == "unreachable"
    gk = {r["region"]: r["published"] for r in spatial.parities(p, "A", "gk", least=2).collect()}
    assert gk["B"] == pytest.approx(3.0)
    thin = {r["region"]: (r["estimated"], r["published"]) for r in spatial.parities(p, "A", least=3).collect()}
    assert thin["B"][0] == pytest.approx(8**0.5) and thin["B"][1] is None and thin["A"][1] == 1
    out = {r["region"]: (r["converted"], r["reason"]) for r in spatial.convert(spark.createDataFrame([("B", 10.0), ("C", 1.0), ("Z", 1.0)], "region string, value double"), spatial.parities(p, "A", least=2)).collect()}
    assert out["B"][0] == pytest.approx(10 / 8**0.5) and out["C"] == (None, "unreachable") and out["Z"] == (None, "no parity")
    level = spatial.price_levels(spatial.parities(p, "A", least=2), spark.createDataFrame([("B", 2.0), ("C", 1.0)], "region string, rate double")).collect()
    assert [(r["region"], round(r["level"], 6)) for r in level] == [("B", round(8**0.5 * 50, 6))]


def test_parities_refuse(spark):
    schema = "region string, product string, price double, quantity double, expenditure double"
    with pytest.raises(spatial.SpatialError, match="positive"):
        spatial.parities(spark.createDataFrame([("A", "x", 0.0, 1.0, 1.0)], schema), "A")
    with pytest.raises(spatial.SpatialError, match="more than once"):
        spatial.parities(spark.createDataFrame([("A", "x", 1.0, 1.0, 1.0)] * 2, schema), "A")
    with pytest.raises(spatial.SpatialError, match="no region is connected"):
        spatial.parities(spark.createDataFrame([("A", "x", 1.0, 1.0, 1.0), ("B", "y", 1.0, 1.0, 1.0)], schema), "A")


# --- layers ---


def quotes(spark, rows=None):
    rows = rows or [(DAY(2020, m, 1), "c", i, p, 1.0, p) for m, prices in ((1, (1.0, 2.0)), (2, (1.1, 0.0)), (3, (1.2, 2.2))) for i, p in zip("ab", prices, strict=True)]
    return spark.createDataFrame(rows, "period date, category string, item_id string, price double, quantity double, expenditure double")


@pytest.fixture
def root(spark):
    from basketry.sources.staging import shared_folder

    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def test_raw_layers_are_written_once(spark, root):
    p = quotes(spark)
    content = layers.write_raw(p, root)
    assert content == frame_hash(p) == layers.write_raw(p.orderBy("price"), root)
    assert [tuple(r)[:3] for r in layers.manifest(spark, root).collect()] == [("raw", content, 6)]
    assert layers.read_raw(spark, root, content).count() == 6
    assert layers.write_raw(p.limit(5), root) != content
    with pytest.raises(layers.ImmutableLayerError, match="no raw layer"):
        layers.read_raw(spark, root, "0" * 64)


def test_changed_raw_layer_is_named(spark, root):
    content = layers.write_raw(quotes(spark), root)
    quotes(spark).limit(2).write.mode("append").parquet(f"{root}/raw/{content}")
    with pytest.raises(layers.ImmutableLayerError, match=content):
        layers.read_raw(spark, root, content)
    with pytest.raises(layers.ImmutableLayerError, match=content):
        layers.write_raw(quotes(spark), root)


def test_half_written_layer_is_written_again(spark, root):
    p = quotes(spark)
    p.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/raw/{frame_hash(p)}")
    assert layers.read_raw(spark, root, layers.write_raw(p, root)).count() == 6


@pytest.mark.parametrize("method", ["none", "carry_forward", "class_mean", "targeted_mean", "overall_mean"])
def test_replay(spark, root, method):
    content = layers.write_raw(quotes(spark), root)
    path, log = layers.write_cleaned(spark, root, content, {"imputation": method})
    assert layers.read_log(spark, path) == log
    assert layers.write_cleaned(spark, root, content, {"imputation": method})[0] == path
    again = layers.replay(quotes(spark), log)
    assert layers.differing(spark.read.parquet(f"{path}/rows"), again, ["period", "item_id"]).count() == 0
    filled = {r["item_id"]: r["price_imputed"] for r in again.filter("period = '2020-02-01'").collect()}
    assert filled["b"] == {"none": None, "carry_forward": 2.0}.get(method, pytest.approx(2.2))
    with pytest.raises(layers.ImmutableLayerError, match="the log is of"):
        layers.replay(quotes(spark).limit(3), log)


def test_receipts_add_up(spark, root):
    for who in ("ann", "bob"):
        content = layers.record_receipt(quotes(spark), root, kind="prices", source="upload:q.csv", file_sha256="ff", actor=who)
    assert {r["received_by"] for r in layers.receipts(spark, root, content).collect()} == {"ann", "bob"}
    assert layers.manifest(spark, root).count() == 1


def test_runs_are_reproduced_or_refused(spark, root):
    content = layers.write_raw(quotes(spark), root)
    settings = {"imputation": "carry_forward"}
    result = layers.store_run(spark, root, "run", content, settings)
    assert {r["series"] for r in result.collect()} == {"c", "All items"}
    assert layers.differing(result, layers.reproduce(spark, root, "run"), ["series", "period"]).count() == 0
    result.withColumn("index", result["index"] + (result["period"] == "2020-03-01").cast("int")).write.parquet(f"{root}/changed")
    spark.read.parquet(f"{root}/changed").write.mode("overwrite").parquet(f"{root}/runs/run/result")
    with pytest.raises(layers.ImmutableLayerError, match="2020-03-01"):
        layers.reproduce(spark, root, "run")


def test_differing(spark):
    schema = "k string, x double, s string"
    a = spark.createDataFrame([("a", 1.0, "p"), ("b", 2.0, None), (None, 3.0, "q"), ("d", None, "q"), ("e", 1.0, "q")], schema)
    b = spark.createDataFrame([("a", 1.0 + 1e-12, "p"), ("b", 2.0, "r"), (None, 3.0, "q"), ("d", None, "q"), ("f", 1.0, "q")], schema)
    assert sorted((r["k"], r["side"]) for r in layers.differing(a, b, ["k"]).collect()) == [("b", "both"), ("e", "left"), ("f", "right")]


def test_numbered(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i) for i in rng.sample(range(1000), 300)]
    got = numbered(spark.createDataFrame(rows, "g string, x int"), ["g"], ["x"], "n").collect()
    for g in "ab":
        assert [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["x"])] == list(range(sum(x[0] == g for x in rows)))
