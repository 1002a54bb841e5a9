"""Betweenness by hubs against Brandes' walks from each source."""

import random
import re

import pytest

from lexmill.operators import graph, hubs
from lexmill.storage import written

EDGE = "era string, src string, dst string, weight long"


def values(df):
    return {(r["era"], r["node"]): r["betweenness"] for r in df.collect()}


def test_hubs_give_what_walks_give(spark):
    """Four hubs among up to 150 nodes, some linked both ways, some only out or in, hubs linked to each other in one era."""
    rng = random.Random(3)
    rows = {}
    for era, n, heavy in (("e", 150, 3), ("f", 120, 9), ("g", 100, 1)):
        for i in range(n):
            for _ in range(rng.randrange(1, 5)):
                h, v = f"h{rng.randrange(4)}", f"v{i}"
                rows[(era, *((h, v) if rng.random() < 0.5 else (v, h)))] = rng.randrange(1, heavy + 1)
    rows |= {("f", f"h{a}", f"h{b}"): 2 for a, b in ((0, 1), (1, 2), (3, 0))}
    edges = spark.createDataFrame([(*k, w) for k, w in rows.items()], EDGE)
    assert hubs.hub_nodes(edges).groupBy("era").count().where("count = 4").count() == 3
    want = values(graph.betweenness(spark, edges))
    assert values(graph.betweenness(spark, edges, few_edges=0)) == pytest.approx(want, abs=2e-9) and any(want.values())


def test_graphs_without_hubs_are_walked(spark):
    """A ring touches no few hubs; hubs among very few nodes are all of them."""
    ring = [("r", f"n{i}", f"n{(i + 1) % 200}", 1) for i in range(200)]
    small = [("s", f"n{a}", f"n{b}", 1 + (a * b) % 3) for a in range(7) for b in range(7) if a != b and (a + 2 * b) % 3]
    edges = spark.createDataFrame([*ring, *small], EDGE)
    assert {r["era"] for r in hubs.hub_nodes(edges).collect()} == {"s"}
    want = values(graph.betweenness(spark, edges))
    assert values(graph.betweenness(spark, edges, few_edges=0)) == pytest.approx(want, abs=2e-9) and any(want.values())


def test_a_large_network_of_terms_is_done_in_time(spark):
    """40,000 nodes around a term, more than a walk from each node gets through. Values by hand: all paths go over the term."""
    n = 20_000
    rows = [("e", f"a{i}", "t", 1) for i in range(n)] + [("e", "t", f"b{i}", 1) for i in range(n)]
    got = values(graph.betweenness(spark, spark.createDataFrame(rows, EDGE)))
    assert got.pop(("e", "t")) == pytest.approx(n * n / (2 * n * (2 * n - 1)), abs=1e-9) and not any(got.values())


def test_growth_of_a_large_network(spark):
    """network_growth's steps on 20,000 nodes before or after a term; all paths between others go over it."""
    n = 10_000
    rows = [("e", f"a{i}", "t", 1 + i % 3) for i in range(n)] + [("e", "t", f"b{i}", 1 + i % 2) for i in range(n)]
    edges = spark.createDataFrame(rows, EDGE)
    got = graph.growth(edges, graph.pagerank(spark, edges, 4), graph.betweenness(spark, edges)).first()
    nodes = 2 * n + 1
    assert (got["nodes"], got["edges"], got["top_node"]) == (nodes, 2 * n, "t")
    assert got["mean_betweenness"] == pytest.approx(n * n / ((nodes - 1) * (nodes - 2)) / nodes, abs=1e-9)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_are_found_in_one_pass(spark):
    """Heads, children and modifiers come from one reading of the frames, missing lists and names among them."""
    kinds = "era string, target_lemma string, dep_head_lemma string, dep_relation string, dep_children array<struct<text:string,dep:string>>, modifiers array<struct<lemma:string,dep:string>>"
    rows = [("e", "t", "H", "obj", [("A", "det"), (None, "det")], [("A", "amod")]), ("e", "t", "h", "obj", None, None), ("e", "t", "", "obj", [], [("t", "amod")])]
    edges = graph.edge_weights(written(spark, spark.createDataFrame(rows, kinds), "frames"))
    assert plan(edges).count("FileScan") == 1
    got = {(r["era"], r["src"], r["dst"], r["weight"], r["relations"]) for r in edges.collect()}
    assert got == {("e", "t", "h", 2, "obj"), ("e", "a", "t", 2, "amod|det")}


def test_no_task_holds_all_nodes_of_a_graph(spark):
    """A join by graph alone would deal a network's nodes to one task; totals of graphs are broadcast, however large joins are made."""
    edges = spark.createDataFrame([("e", f"a{i}", f"a{i * 7 % 50}", 1 + i % 3) for i in range(1, 50)], EDGE)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (graph.pagerank(spark, edges, 1), graph.betweenness(spark, edges)):
            assert not re.search(r"SortMergeJoin \[era#\d+\], \[era#\d+\]", plan(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
