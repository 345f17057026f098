"""Graph operators against hand-built graphs and plain closures."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spindrift.exceptions import ColumnNotFoundError, LineageError
from spindrift.operators import graph as G
from spindrift.operators import reports as R

#: A given fixture of four edges, to which the expected traces below belong.
ROWS = [("raw_orders", "id", "stg_orders", "order_id", "rename"), ("raw_orders", "status", "stg_orders", "order_status", "rename"), ("stg_orders", "order_id", "orders", "order_id", "passthrough"), ("stg_orders", "order_status", "orders", "is_completed", "conditional")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "resolved") for r in ROWS], "source_model string, source_column string, target_model string, target_column string, transform_type string, resolution_status string")


def names(df):
    return [tuple(r) for r in df.collect()]


def test_trace(edges):
    found, roots = G.trace(edges, "orders", "is_completed")
    assert [r["source_model"] for r in found.collect()] == ["raw_orders", "stg_orders"]
    assert names(roots) == [("raw_orders", "status")]


def test_trace_of_a_root_is_itself(edges):
    found, roots = G.trace(edges, "RAW_ORDERS", "ID")
    assert found.count() == 0 and names(roots) == [("raw_orders", "id")]


def test_impact(edges):
    found, hit = G.impact(edges, "raw_orders", "id")
    assert found.count() == 2 and names(hit) == [("orders", "order_id"), ("stg_orders", "order_id")]


def test_unknown_column_lists_columns(edges):
    with pytest.raises(ColumnNotFoundError, match="is_completed, order_id"):
        G.trace(edges, "orders", "nope")


def test_selection(edges):
    assert names(G.model_dependencies(edges, "orders")) == [("stg_orders",)]
    assert names(G.all_models(edges)) == [("orders",), ("raw_orders",), ("stg_orders",)]
    assert names(G.all_columns(edges, "orders")) == [("is_completed",), ("order_id",)]
    assert names(G.search_columns(edges, "STATUS")) == [("raw_orders", "status"), ("stg_orders", "order_status")]
    assert names(G.search_columns(edges, "%")) == []
    assert G.edges_between(edges, "raw_orders", "stg_orders").count() == 2
    assert names(G.stats(edges)) == [(3, 6, 4)]


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted(names(G.reachable(e, seeds))) == [("a",), ("b",), ("c",), ("d",)]
    nodes = spark.createDataFrame([(x,) for x in "abcdx"], "node string")
    assert dict(names(G.levels(nodes, e))) == {"x": 0, "a": 1, "b": 1, "c": 1, "d": 1}


def test_a_round_limit_raises(spark):
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string")
    seeds = spark.createDataFrame([("0",)], "node string")
    assert G.reachable(e, seeds).count() == G.reachable(e, seeds, 7).count() == 6
    with pytest.raises(LineageError, match="3 rounds"):
        G.reachable(e, seeds, 3)


@pytest.mark.parametrize("few", [1, 100])
def test_small_and_large_closures_agree(spark, monkeypatch, few):
    """Random graphs with cycles: followed by filters, by broadcast lists, and by joins over many rounds."""
    rng = random.Random(few)
    monkeypatch.setattr(G, "FEW", few)
    rows = [(f"m{rng.randint(0, 5)}", str(rng.randint(0, 9)), f"m{rng.randint(0, 5)}", str(rng.randint(0, 9)), rng.choice(["rename", "cast"])) for _ in range(60)]
    rows += [("chain", str(i), "chain", str(i + 1), "rename") for i in range(6)] + [("chain", "6", "m1", "1", "cast")]
    e = spark.createDataFrame(rows, "source_model string, source_column string, target_model string, target_column string, transform_type string")
    cases = [(f, m, c) for f in (G.trace, G.impact) for m, c in (("m1", "1"), ("chain", "3"))]
    near = [[names(x) for x in f(e, m, c)] for f, m, c in cases]
    monkeypatch.setattr(G, "SMALL", 0)
    monkeypatch.setattr(G, "COMPACT", 2)
    for (f, m, c), (found, ends) in zip(cases, near):
        far = [names(x) for x in f(e, m, c)]
        assert sorted(far[0]) == sorted(found) and far[1] == ends
    pairs = {(a + b, c + d) for a, b, c, d, _ in rows}
    nodes = spark.createDataFrame([(n,) for n in {x for p in pairs for x in p} | {"lone"}], "node string")
    graph = spark.createDataFrame(sorted(pairs), "src string, dst string")
    assert dict(names(G.levels(nodes, graph))) == G._ordered([n for (n,) in names(nodes)], sorted(pairs))
    ranks = dict(names(G.topological(nodes, graph)))
    level = G._ordered(list(ranks), sorted(pairs))
    assert sorted(ranks, key=ranks.get) == sorted(ranks, key=lambda n: (level[n], n)) and set(ranks.values()) == set(range(1, len(ranks) + 1))


def test_diamond_levels(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("zz", "a")], "src string, dst string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    assert dict(names(G.levels(nodes, e))) == {"a": 0, "b": 1, "c": 1, "d": 2}


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.tuples(st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=12))
def test_all_pairs_is_the_closure(spark, pairs):
    closed = set(pairs)
    while more := {(a, d) for a, b in closed for c, d in closed if b == c} - closed:
        closed |= more
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src string, dst string")
    assert {(int(a), int(b)) for a, b in names(G.all_pairs(df))} == closed


def test_rollup_and_degrees(edges):
    rows = {(r["source_model"], r["target_model"]): (r["cnt"], r["types"], r["dominant"]) for r in R.model_rollup(edges).collect()}
    assert rows == {("raw_orders", "stg_orders"): (2, {"rename": 2}, "rename"), ("stg_orders", "orders"): (2, {"passthrough": 1, "conditional": 1}, "conditional")}
    assert {r["model"]: (r["in_degree"], r["out_degree"], r["degree"]) for r in R.degrees(edges).collect()} == {"raw_orders": (0, 1, 1), "stg_orders": (1, 1, 2), "orders": (1, 0, 1)}


def test_reports_of_nothing(spark, edges):
    none = edges.limit(0)
    assert R.model_rollup(none).count() == 0 and R.transform_breakdown(none).count() == 0 and G.all_models(none).count() == 0
    assert names(R.pair_stats(none)) == [(0, 0, 0)]


def test_whole_queries_see_every_edge(spark, tmp_path):
    """A star schema of two regions, by brute force: the lines are in, and every start."""
    from spindrift.plans import catalog

    tables = {
        "nation": ("n_regionkey long, n_nationkey long", [(0, 0), (1, 1)]), "customer": ("c_nationkey long, c_custkey long", [(0, 1), (1, 2)]), "supplier": ("s_nationkey long, s_suppkey long", [(1, 1)]), "orders": ("o_custkey long, o_orderkey long", [(1, 1), (2, 2), (2, 3)]),
        "lineitem": ("l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long", [(1, 1, 7, 1), (1, 2, 8, 1), (3, 1, 7, 1), (3, 1, 8, 1)]),
    }
    for name, (kinds, rows) in tables.items():
        spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/{name}.parquet")
    run = lambda name: catalog.QUERIES[name](spark, str(tmp_path)).collect()
    every = [r.asDict() for r in catalog.key_edges(spark, str(tmp_path)).collect()]
    ends = lambda e: ((e["source_model"], e["source_column"]), (e["target_model"], e["target_column"]))
    pairs = {ends(e) for e in every}
    while more := {(a, d) for a, b in pairs for c, d in pairs if b == c} - pairs:
        pairs |= more
    sizes = {a: sum(x == a for x, _ in pairs) for a, _ in pairs}
    assert {(r["model"], r["column"]): r["n"] for r in run("graph_closure_sizes")} == sizes
    statuses = {}
    for target in {ends(e)[1] for e in every}:
        for e in {ends(e): e for e in every}.values():
            if ends(e)[1] == target or (ends(e)[1], target) in pairs:
                statuses[e["resolution_status"]] = statuses.get(e["resolution_status"], 0) + 1
    assert dict(map(tuple, run("report_resolution"))) == statuses
    key = lambda e: ends(e)[0] + ends(e)[1]
    got = {tuple(r)[:4]: (r["label"], r["note"]) for r in run("report_labels")}
    label = lambda e: f"rename: {e['source_column']} -> {e['target_column']}" if e["transform_type"] in ("passthrough", "rename") and e["source_column"] != e["target_column"] else e["transform_type"]
    assert got == {key(e): (label(e), "" if e["resolution_status"] == "resolved" else "[ambiguous]") for e in every}
    assert {tuple(r)[:4]: r["n_steps"] for r in run("report_chain_steps")} == {key(e): 1 if e["transform_type"] == "passthrough" else 2 for e in every}
    rows = [("source_model", "target_model", "target_column", "source_column", "transform_type")]
    size = lambda e: sum(x["source_model"] == e["source_model"] for x in every)
    assert [(r[0], r["group_size"], *r[2:]) for r in run("report_grouped_by_source")] == [(k[0], size(e), *k[1:]) for k, e in sorted(((tuple(e[c] for c in rows[0]), e) for e in every), key=lambda x: x[0])]
    rank = {"aggregation": 7, "cast": 4, "function": 3, "rename": 2}
    for name, best in (("edges_first_wins", lambda e: -int(e["target_column"])), ("edges_merged", lambda e: (rank.get(e["transform_type"], 0), int(e["target_column"])))):
        want = {}
        for e in every:
            k = (e["source_model"], e["source_column"], e["target_model"], "x")
            want[k] = max((e, want.get(k, e)), key=best)
        assert {tuple(r)[:4]: r["transform_type"] for r in run(name)} == {k: e["transform_type"] for k, e in want.items()}
