"""Queries that do the whole job, against brute force in Python."""

from lexmill.operators import frames
from lexmill.plans import catalog


def rows(spark, sf_dir, name):
    return catalog.queries()[name](spark, sf_dir).collect()


def test_terms_of_whole_texts(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = {i: ",".join(w for w in ("and", "ore", "then", "thin") if w in t) for i, t in texts.items()}
    assert {r["doc_id"]: r["terms"] for r in rows(spark, sf_dir, "terms_in_context")} == want
    assert any(w in t and w not in t[:400] for t in texts.values() for w in ("and", "ore", "then", "thin"))


def test_networks_hold_every_edge(spark, sf_dir):
    edges = [(r["era"], r["src"], r["dst"]) for r in rows(spark, sf_dir, "edge_weights")]
    near = {}
    for era, a, b in edges:
        near.setdefault((era, a), set()).add((era, b))
        near.setdefault((era, b), set()).add((era, a))
    want = {}
    for start in sorted(near):  # the first node met of a component is its least
        todo = [] if start in want else [start]
        while todo:
            node = todo.pop()
            if node not in want:
                want[node] = start[1]
                todo += near[node]
    assert {(r["era"], r["node"]): r["component"] for r in rows(spark, sf_dir, "connected_components")} == want
    assert {(r["era"], r["node"]) for r in rows(spark, sf_dir, "betweenness")} == set(want)
    for name in ("centrality_fill", "centrality_shift"):
        assert {r["node"] for r in rows(spark, sf_dir, name)} == {n for _, n in want}
    order = list(catalog.ERA_ORDER)
    for name, first in (("emerging_edges", min(order)), ("emerging_edges_chronological", order[0])):
        known = {(a, b) for era, a, b in edges if era == first}
        got = rows(spark, sf_dir, name)
        assert {(r["src"], r["dst"]) for r in got} == {(a, b) for era, a, b in edges if era in order and era != first and (a, b) not in known}


def test_bridges_join_hubs_that_are_not_linked(spark, sf_dir):
    pairs = {(r["l_returnflag"], f"S{r['l_suppkey']}", f"P{r['l_partkey']}") for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()}
    pairs |= {(e, b, a) for e, a, b in pairs}
    bridges = rows(spark, sf_dir, "bridge_nodes")
    assert len(bridges) > 50
    assert all((r["era"], r["a"], r["b"]) not in pairs and {(r["era"], r["a"], r["bridge"]), (r["era"], r["bridge"], r["b"])} <= pairs for r in bridges)


def test_only_sentences_with_terms_are_flagged(spark):
    rows = [("d", "c", i, "passive", "AGENTLESS", "nobody") for i in range(6)]
    rows += [("d", "c", 6 + i, "passive", "AGENTLESS", "x" * 250 + f" the Board {i}") for i in range(6)]
    found = spark.createDataFrame(rows, "t string, chunk_id string, token_idx int, voice string, agent_category string, sentence string")
    got = frames.flagged_sentences(found, ["t"], terms=("board", "act")).orderBy("rank").collect()
    assert [(r["rank"], r["sentence"], r["terms"]) for r in got] == [(k, "x" * 200, ["board"]) for k in range(1, 6)]


def test_flagged_in_context(spark, sf_dir):
    got = rows(spark, sf_dir, "flagged_sentences")
    assert got and all(r["terms"].split(",") == [w for w in ("and", "in") if w in r["sentence"].lower()] for r in got)
