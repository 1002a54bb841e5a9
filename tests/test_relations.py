"""Frames, discourse, topics and graphs on hand-made relations."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.dims import ERAS, era_table
from lexmill.operators import discourse, frames, graph, providers, topics
from lexmill.streaming import incremental

FRAME = (
    "chunk_id string, doc_year int, target_term string, target_lemma string, sentence string, syntactic_role string, dep_relation string, "
    "dep_head_lemma string, dep_head_pos string, dep_children array<struct<text:string,dep:string,pos:string>>, "
    "modifiers array<struct<text:string,lemma:string,pos:string,dep:string>>, governing_verb string, token_idx int, era string"
)


def frame(term="Gaelic", year=2005, role="patient", verb=None, rel="compound", head="language", kids=(), mods=(), sentence="s", idx=0, era="e", chunk="c"):
    return (chunk, year, term, term.lower(), sentence, role, rel, head, "NOUN", list(kids), list(mods), verb, idx, era)


def test_agency_keeps_surface_forms_apart(spark):
    rows = [frame(role="agent", verb="promote"), frame(verb="promote"), frame(role="modifier"), frame("gaelic", verb="use")]
    got = {r["target_term"]: r for r in frames.agency_summary(spark.createDataFrame(rows, FRAME)).collect()}
    assert (got["Gaelic"]["agency_ratio"], got["Gaelic"]["total_occurrences"], got["Gaelic"]["top_verb"]) == (0.5, 3, "promote")
    assert (got["gaelic"]["agency_ratio"], got["gaelic"]["total_occurrences"]) == (0.0, 1)


def test_edges_count_a_child_that_modifies_twice(spark):
    kid, mod = ("Scottish", "amod", "ADJ"), ("scottish", "scottish", "ADJ", "amod")
    rows = spark.createDataFrame([frame(kids=[kid], mods=[mod]), frame(rel="nmod")], FRAME)
    edge = lambda least: {(r["src"], r["dst"]): (r["weight"], r["relations"]) for r in graph.edge_weights(rows, least).collect()}
    assert edge(1) == {("scottish", "gaelic"): (2, "amod"), ("gaelic", "language"): (2, "compound|nmod")}
    assert edge(2) == {("scottish", "gaelic"): (2, "amod")}


def test_emerging_edges_by_name_and_by_time(spark):
    d, g, m, p = "devolution (1998-2004)", "gaelic-revival (2005-2022)", "modern (2023-2025)", "pre-devolution (1707-1997)"
    rows = [(d, "a", "b", 1), (g, "a", "b", 1), (g, "c", "d", 1), (m, "c", "d", 1), (p, "e", "f", 1)]
    edges = spark.createDataFrame(rows, "era string, src string, dst string, weight long")
    named = {(r["src"], r["era"]) for r in graph.emerging_edges(edges, sorted(ERAS)).collect()}
    assert named == {("c", g), ("c", m), ("e", p)}
    timed = {(r["src"], r["era"]) for r in graph.emerging_edges(edges, list(ERAS), once=True).collect()}
    assert timed == {("a", d), ("c", g)}


def test_roles_and_agents(spark):
    given = [("nsubj", None, "agent"), ("nsubj", "Pass", "patient"), ("nsubjpass", None, "patient"), ("pobj", None, "patient"), ("obl", None, "oblique"), ("amod", None, "modifier"), ("conj", None, "other")]
    rows = spark.createDataFrame(given, "d string, v string, want string")
    assert rows.where(frames.role_of(F.col("d"), F.col("v")) != F.col("want")).count() == 0
    names = [("Creative Scotland", "INSTITUTIONAL"), ("Scotland act", "LEGAL_PROCESS"), ("action", "LEGAL_PROCESS"), ("somebody", "INSTITUTIONAL"), ("they", "OTHER")]
    rows = spark.createDataFrame(names, "n string, want string")
    assert rows.where(frames.agent_category(F.col("n"), F.lower("n")) != F.col("want")).count() == 0


TOKEN = "chunk_id string, sent_id int, i int, text string, lemma string, pos string, tag string, dep string, head_i int, voice string, left int, right int"


def sentence(spark):
    """Gaelic was promoted by the board ."""
    words = [
        ("Gaelic", "Gaelic", "PROPN", "NNP", "nsubjpass", 2, 0, 0),
        ("was", "be", "AUX", "VBD", "auxpass", 2, 1, 1),
        ("promoted", "promote", "VERB", "VBN", "ROOT", 2, 0, 6),
        ("by", "by", "ADP", "IN", "agent", 2, 3, 5),
        ("the", "the", "DET", "DT", "det", 5, 4, 4),
        ("board", "board", "NOUN", "NN", "pobj", 3, 4, 5),
        (".", ".", "PUNCT", ".", "punct", 2, 6, 6),
    ]
    rows = [("c", 0, i, t, le, p, g, d, h, None, lo, hi) for i, (t, le, p, g, d, h, lo, hi) in enumerate(words)]
    return spark.createDataFrame(rows, TOKEN)


def test_parsed_frames_and_triples(spark):
    tokens = sentence(spark)
    found = frames.parsed_frames(tokens, ("Gaelic",))
    row = found.first()
    assert (row["syntactic_role"], row["governing_verb"], row["dep_head"]) == ("patient", "promote", "promoted")
    agents = frames.verb_agents(tokens)
    verb = agents.where("i = 2").first()
    assert (verb["agent_text"], verb["agent_lemma"], verb["voice"], verb["by_phrase"]) == ("the board", "board", "passive", True)
    climbs = frames.governing_verbs(tokens).select("i", "verb_i")
    triple = frames.triples(found.join(climbs, found["token_idx"] == climbs["i"]).drop("i"), agents).first()
    assert (triple["agent_category"], triple["voice"]) == ("INSTITUTIONAL", "passive")


def test_parsed_triples_need_no_join_by_hand(spark):
    tokens = sentence(spark)
    found = frames.parsed_frames(tokens, ("Gaelic",))
    row = found.first()
    assert (row["verb_i"], row["verb_text"], row["sentence"], row["subtree_text"]) == (2, "promoted", "Gaelic was promoted by the board .", "Gaelic")
    triple = frames.parsed_triples(found, tokens).first()
    assert (triple["agent_category"], triple["voice"], triple["agent_text"]) == ("INSTITUTIONAL", "passive", "the board")


def test_agents_of_relative_clauses_and_of_the_first_verb_that_has_one(spark):
    """the board that wants to use Gaelic: `that` is the subject of use, whose relative clause is above it; `use` stands twice."""
    words = [
        ("use", "use", "VERB", "VB", "dep", 3, 0, 0),
        ("the", "the", "DET", "DT", "det", 2, 1, 1),
        ("board", "board", "NOUN", "NN", "ROOT", 2, 0, 7),
        ("that", "that", "PRON", "WDT", "nsubj", 5, 3, 3),
        ("wants", "want", "VERB", "VBZ", "relcl", 2, 3, 7),
        ("use", "use", "VERB", "VB", "xcomp", 4, 3, 7),
        ("Gaelic", "Gaelic", "PROPN", "NNP", "dobj", 5, 6, 6),
        ("given", "give", "VERB", "VBN", "acl", 6, 7, 7),
    ]
    tokens = spark.createDataFrame([("c", 0, i, t, le, p, g, d, h, None, lo, hi) for i, (t, le, p, g, d, h, lo, hi) in enumerate(words)], TOKEN)
    wanted = spark.createDataFrame([("c", 0, "use", "use"), ("c", 0, "give", "given"), ("c", 0, "want", "wants")], "chunk_id string, sent_id int, verb_lemma string, verb_text string")
    got = {r["verb_lemma"]: (r["agent_text"], r["voice"], r["by_phrase"]) for r in frames.wanted_agents(tokens, wanted).collect()}
    assert got["use"] == ("use the board that wants use Gaelic given", "active", None)
    assert got["give"] == (None, "passive", False) and "want" not in got


def test_top_frames_order_and_text(spark):
    rows = [frame(role="other", sentence=str(i % 17), idx=i) for i in range(20)] + [frame(role="agent", sentence="a", verb="go", rel="nsubj", idx=20)]
    found = frames.top_frames(spark.createDataFrame(rows, FRAME))
    assert found.count() == 15 and found.where("rank = 1").first()["syntactic_role"] == "agent"
    assert frames.frame_lines(found).first()["frames"].splitlines()[0] == '- "Gaelic" as AGENT(dep: nsubj, verb: go)'


def test_markedness(spark):
    era = "gaelic-revival (2005-2022)"
    rows = [("A", era, "Gaelic")] * 3 + [("B", era, "English")] * 2 + [("B", era, "Gaelic")] + [("B", era, "Scots")] * 4
    found = discourse.markedness_rollup(spark.createDataFrame(rows, "doc_title string, era string, language string"), era_table(spark))
    got = {r["name"]: (r["markedness_ratio"], r["english_invisibility_index"]) for r in found.collect()}
    assert got["A"] == (float("inf"), 1.0) and got["B"][0] == 2.5 and got[era] == (4.0, 0.8)
    assert got["modern (2023-2025)"] == (float("inf"), None) and len(got) == 7


def test_protection_density(spark):
    mentions = spark.createDataFrame([("A", "c1", "Gaelic"), ("A", "c2", "Gaelic")], "doc_title string, chunk_id string, language string")
    cls = [("A", "c1", "predication", True, ["Gaelic"]), ("A", "c2", "predication", True, ["Scots"]), ("A", "c3", "nomination", None, [])]
    found = discourse.protection_density(mentions, spark.createDataFrame(cls, "doc_title string, chunk_id string, strategy string, present boolean, target_languages array<string>"))
    got = {r["language"]: (r["n_both"], r["n_only"], r["density"]) for r in found.collect()}
    assert got["Gaelic"] == (1, 1, pytest.approx(1 / 3)) and got["Scots"] == (0, 0, 0.0)


def topoi(spark):
    given = {1707: [["law"], ["law", "history"]], 1872: [["culture"], ["culture", "law"]], 1992: [["culture"]], 1998: [["law"]]}
    rows = [(y, "argumentation", True, [f"topos_of_{t}" for t in ts], ["Gaelic", "Gaelic", "Manx"]) for y, many in given.items() for ts in many]
    df = spark.createDataFrame(rows, "doc_year int, strategy string, present boolean, topoi array<string>, target_languages array<string>")
    return discourse.with_era(df, era_table(spark))


def test_turning_points(spark):
    got = {r["doc_year"]: r for r in discourse.turning_points(topoi(spark)).collect()}
    assert sorted(got) == [1707, 1872, 1998]
    assert got[1707]["turning_point"] == "new_topoi_emergence" and got[1707]["magnitude"] is None
    assert (got[1872]["turning_point"], got[1872]["magnitude"]) == ("dominant_change_and_new_topoi", 0.5)
    assert got[1998]["turning_point"] == "dominant_topos_change" and got[1998]["magnitude"] is None


def test_identity_and_targeting(spark):
    got = {r["era"]: r for r in discourse.identity_timeline(topoi(spark)).collect()}["pre-devolution (1707-1997)"]
    assert got["frame_diversity"] == pytest.approx(1.449, abs=1e-3) and got["law_vs_culture_ratio"] == pytest.approx(3 / 7)
    counts = {(r["language"], r["doc_year"]): r["n"] for r in discourse.targeting(topoi(spark)).collect()}
    assert counts["Gaelic", 1992] == 2 and counts["Manx", 1992] == 1


def test_topic_course(spark):
    rows = [(1707, 1, 2), (1998, 1, 2), (1992, 2, 1), (2005, 2, 1), (2025, 2, 1)]
    got = {r["topic_id"]: r for r in topics.trajectories(spark.createDataFrame(rows, "doc_year int, topic_id int, frequency long")).collect()}
    assert got[1]["declining"] and got[1]["peak_year"] == 1707 and got[2]["emerging"] and got[2]["persistent"]


def test_weighted_agency(spark):
    rows = [frame(role="agent"), frame(), frame(role="other"), frame(role="other"), frame("Gàidhlig")]
    df = spark.createDataFrame(rows, FRAME).withColumn("language", F.lit("Gaelic"))
    row = frames.weighted_agency(df, ["language", "doc_year"]).first()
    assert (row["agency_ratio"], row["n"]) == (0.4, 5)


EDGE = "era string, src string, dst string, weight long"


def test_graph_measures(spark):
    edges = spark.createDataFrame([("e", "a", "b", 1), ("e", "b", "c", 1), ("e", "x", "y", 2), ("f", "a", "b", 1)], EDGE)
    comp = {(r["era"], r["node"]): r["component"] for r in graph.components(spark, edges).collect()}
    assert comp == {("e", "a"): "a", ("e", "b"): "a", ("e", "c"): "a", ("e", "x"): "x", ("e", "y"): "x", ("f", "a"): "a", ("f", "b"): "a"}
    between = {(r["era"], r["node"]): r["betweenness"] for r in graph.betweenness(spark, edges).collect()}
    assert between["e", "b"] == pytest.approx(1 / 12) and between["e", "a"] == 0
    ranks = graph.pagerank(spark, edges.where("era = 'e'"), 30)
    assert ranks.agg(F.sum("pagerank")).first()[0] == pytest.approx(1, abs=1e-4)
    stats = {r["era"]: (r["nodes"], r["edges"], r["density"]) for r in graph.graph_stats(edges).collect()}
    assert stats == {"e": (5, 3, 3 / 20), "f": (2, 1, 0.5)}


def test_large_graphs_are_worked_out_in_tables(spark):
    rng = random.Random(0)
    links = {(rng.randrange(7), rng.randrange(7)): rng.randrange(1, 3) for _ in range(16)}
    rows = [(era, f"n{a}", f"n{b}", w) for era in "e" for (a, b), w in links.items() if a != b]
    edges = spark.createDataFrame(rows, EDGE)
    value = lambda df: {(r["era"], r["node"]): r["betweenness"] for r in df.collect()}
    want = value(graph.betweenness(spark, edges))
    assert value(graph.betweenness(spark, edges, most_edges=0)) == pytest.approx(want) and any(want.values())


def test_pagerank_goes_on_to_its_tolerance(spark):
    """Slow to settle: a star into a cycle."""
    rows = [("e", f"s{i}", "c0", 1) for i in range(20)] + [("e", f"c{i}", f"c{(i + 1) % 30}", 1) for i in range(30)]
    edges = spark.createDataFrame(rows, EDGE)
    rank = lambda **k: {r["node"]: r["pagerank"] for r in graph.pagerank(spark, edges, digits=12, **k).collect()}
    nodes = sorted({x for _, a, b, _ in rows for x in (a, b)})
    out = {a: b for _, a, b, _ in rows}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(300):
        new = dict.fromkeys(nodes, 0.15 / len(nodes))
        for a in nodes:
            new[out[a]] += 0.85 * want[a]
        want = new
    off = lambda got: sum(abs(got[v] - want[v]) for v in nodes)
    assert off(rank(steps=100, every=2, tolerance=1e-6)) < 10 * 1e-6 * len(nodes) < off(rank(steps=10, every=2))


def test_cache_aside(spark):
    prompts = spark.createDataFrame([("c1", "p"), ("c2", "p"), ("c3", "q"), ("c4", "fails")], "chunk_id string, prompt string")
    prompts = prompts.withColumn("prompt_sha", providers.prompt_key(F.col("prompt")))
    cache = prompts.where("prompt = 'q'").select("prompt_sha", F.struct(F.lit(True).alias("present")).alias("result"))
    misses = providers.cache_misses(prompts, cache)
    assert misses.count() == 2

    def client(text):
        if text == "fails":
            raise ConnectionError
        return text.upper()

    replies = providers.ask(misses, client).collect()
    assert [r["reply"] for r in replies] == ["P"]
    assert {r["chunk_id"]: r["present"] for r in providers.answered(prompts, cache).collect()} == {"c1": False, "c2": False, "c3": True, "c4": False}


def test_evidence_is_flagged(spark):
    cls = spark.createDataFrame([("c", "nomination", ["in it", "not in it"])], "chunk_id string, strategy string, evidence_quotes array<string>")
    texts = spark.createDataFrame([("c", "what is in it")], "chunk_id string, text string")
    assert {r["quote"]: r["verified"] for r in discourse.evidence(cls, texts).collect()} == {"in it": True, "not in it": False}


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", "the cat of the hill"), ("t", "of")], "source string, text string")
    rows.write.parquet(str(tmp_path / "in"))
    languages = {"the": "English", "of": "Gaelic"}
    stream = incremental.mention_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), languages)
    run = stream.writeStream.outputMode("complete").format("memory").queryName("mentions").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(spark.table("mentions").collect()) == sorted(incremental.mention_stream(rows, languages).collect())
