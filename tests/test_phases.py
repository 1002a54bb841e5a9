"""Phases write tables, skip what is up to date, and tell what they did; plot tables and the rest of the operators."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunking, cleaning, frames, graph, plots, providers
from lexmill.plans import bindings, phases


def test_phases(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 40").select("doc_id", "text")
    meta = docs.select("doc_id", F.col("doc_id").cast("int").alias("doc_no"), F.lit("T").alias("doc_title"), F.lit(2005).alias("doc_year"))
    one = phases.run_phase1(spark, docs, meta, str(tmp_path / "1"), "[A-Z]{2,}\\b")
    assert one["chunks"] >= 40 and one["vectors"] == one["chunks"] and sum(one["chunks_per_doc"].values()) == one["chunks"]

    chunks = bindings.chunks(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    two = phases.run_phase2(spark, chunks, vectors, str(tmp_path / "2"), bindings.LEXICON, 4)
    assert two["frames"] > 0 and two["edges"] > 0 and two["topics"] >= 1
    three = phases.run_phase3(spark, chunks, str(tmp_path / "3"), bindings.CUES, bindings.LEXICON, sample=50)
    assert three["rows"] == 250 and set(three["present"]) <= set(bindings.CUES.strategies)
    deep = phases.run_deep_analysis(
        spark, bindings.frames(spark, sf_dir), bindings.classified(spark, sf_dir), bindings.triples(spark, sf_dir), str(tmp_path / "d")
    )
    assert len(deep["tables"]) == 12
    four = phases.run_phase4(spark, str(tmp_path / "2"), str(tmp_path / "4"))
    # the target terms of the test tables are function words, which networks leave out
    assert four["network_growth"] == 4 and four["network"] == 0 and four["topic_heatmap"] > 0
    with pytest.raises(ValueError, match="triples"):
        phases.run_deep_analysis(spark, bindings.frames(spark, sf_dir), bindings.classified(spark, sf_dir), None, str(tmp_path / "e"), skip_identity=True, skip_markedness=True)


def test_phase3_asks_a_client_behind_its_cache(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "T", 2005, "era", t) for i, t in enumerate(["aaaa", "aaaa", "bbbbb", None, "fail"])], "chunk_id long, doc_title string, doc_year int, era string, text string")
    log = tmp_path / "asked"
    log.mkdir()

    def client(up):
        def call(text):
            import uuid

            (log / uuid.uuid4().hex).write_text(text)
            if "Text:\nfail" in text and not up:
                raise ConnectionError("down")
            return bindings.echo_client(text)

        return call

    run = lambda up: phases.run_phase3(spark, chunks, str(tmp_path / "3"), bindings.CUES, bindings.LEXICON, client=client(up), pause=0.0)
    first = run(False)
    # equal prompts are asked once, and a lost connection three times
    assert first["rows"] == 25 and len(list(log.iterdir())) == 5 * (3 + 3)
    found = spark.read.parquet(str(tmp_path / "3" / "classifications"))
    assert {r["chunk_id"]: r["notes"] for r in found.where("error").collect()} == {4: "ConnectionError: down"}
    run(True)
    # only what failed is asked again
    assert len(list(log.iterdir())) == 5 * (3 + 3) + 5
    run(True)
    assert len(list(log.iterdir())) == 5 * (3 + 3) + 5
    assert spark.read.parquet(str(tmp_path / "3" / "classifications")).where("error").count() == 0
    with pytest.raises(ValueError, match="unknown"):
        providers.strategy_prompts(chunks, strategies=("irony",))

    def refuses(text):
        raise providers.Refused("too long")

    out, fresh = providers.classify(spark, providers.strategy_prompts(chunks), None, refuses)
    assert {r["notes"] for r in out.collect()} == {"refused: too long"} and fresh.count() == 0


def test_stage_is_made_anew_only_for_other_input(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    df = spark.range(3)
    for rows, force in ((df, False), (df.repartition(2), False), (spark.range(4), False), (spark.range(4), True)):
        out = phases.stage(spark, str(tmp_path), "t", phases.fingerprint(rows, k=1), lambda rows=rows: make(rows.count()), force)
    assert made == [3, 4, 4] and out.count() == 4
    assert phases.fingerprint(df, k=1) != phases.fingerprint(df, k=2)


def test_detected_sections(spark):
    text = "\n".join(f"l{i}" for i in range(10))
    lines = cleaning.lines_of(spark.createDataFrame([(0, text)], "doc_id long, text string"))
    found = spark.createDataFrame([(0, 1, "a"), (0, 3, "near"), (0, 4, "b"), (0, 6, "near"), (0, 7, "c"), (0, 7, "c")], "doc_id long, line_no int, title string")
    kept = chunking.kept_boundaries(found)
    assert sorted(r["line_no"] for r in kept.collect()) == [1, 4, 7]
    rows = chunking.sections_at(lines, kept).orderBy("section_seq").collect()
    assert [(r["section_id"], r["start_line"], r["end_line"]) for r in rows] == [("a", 1, 3), ("b", 4, 6), ("c", 7, 9)]
    assert chunking.window_texts(lines, 4).orderBy("window").first()["text"] == "0: l0\n1: l1\n2: l2\n3: l3"


def test_verbs_are_located(spark):
    rows = [("c", 0, 0, "Promote", "promote", "NOUN", "NN"), ("c", 0, 1, "promoted", "promote", "VERB", "VBN"), ("c", 0, 2, "uses", "utilise", "VERB", "VBZ")]
    tokens = spark.createDataFrame(rows, "chunk_id string, sent_id int, i int, text string, lemma string, pos string, tag string")
    wanted = spark.createDataFrame([("c", 0, "promote", "promoted"), ("c", 0, "use", "uses"), ("c", 0, "none", "none")], "chunk_id string, sent_id int, verb_lemma string, verb_text string")
    assert {r["verb_lemma"]: (r["i"], r["step"]) for r in frames.locate_verbs(tokens, wanted).collect()} == {"promote": (1, 1), "use": (2, 2)}


def test_flagged_sentences_and_terms(spark):
    rows = [("d", f"c{i}", i, "passive", "AGENTLESS", "x" * 300) for i in range(7)] + [("d", "c", 0, "active", "OTHER", "no")]
    found = frames.flagged_sentences(spark.createDataFrame(rows, "t string, chunk_id string, token_idx int, voice string, agent_category string, sentence string"), ["t"])
    assert [len(r["sentence"]) for r in found.collect()] == [200] * 5
    df = spark.createDataFrame([("The Board and the somebody",)], "s string")
    assert df.select(frames.terms_in_context(F.col("s"), ("board", "body", "act"))).first()[0] == ["board", "body"]


EDGE = "era string, src string, dst string, weight long"


def test_network_plots(spark):
    edges = spark.createDataFrame([("e", "a", "m", 9), ("e", "b", "m", 8), ("e", "the", "a", 9), ("e", "--", "a", 9), ("e", "x", "y", 1)], EDGE)
    scores = spark.createDataFrame([("e", n, s) for n, s in (("a", 9), ("b", 8), ("m", 1), ("the", 20), ("--", 20), ("x", 2), ("y", 1))], "era string, node string, total_degree long")
    stop = spark.createDataFrame([("the",)], "lemma string")
    assert sorted(r["node"] for r in graph.named_nodes(scores, stop).collect()) == ["a", "b", "m", "x", "y"]
    got = {(r["src"], r["dst"], r["kind"]) for r in graph.plot_network(edges, scores, stop, top=2).collect()}
    assert got == {("a", "m", "bridge"), ("b", "m", "bridge")}
    parts = graph.components(spark, edges.where("src not in ('the', '--')"))
    assert [(r["src"], r["dst"]) for r in graph.virtual_edges(parts, scores).collect()] == [("a", "x")]


def test_labels_and_streams(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 9), (2, 0.1, 0.1, 5), (3, 5.0, 5.0, 2)], "topic_id int, x double, y double, n long")
    assert {r["topic_id"]: r["label"] for r in plots.spaced_labels(points).collect()} == {1: True, 2: False, 3: True}
    counts = spark.createDataFrame([(1998, "law", 0.5), (1998, "culture", 1.0), (2005, "law", 1.0)], "doc_year int, topos string, proportion double")
    got = {(r["doc_year"], r["topos"]): (r["proportion"], r["base"]) for r in plots.streamgraph(counts, [1998, 2005], ["culture", "law"]).collect()}
    assert got[1998, "culture"] == (1.0, -0.75) and got[1998, "law"] == (0.5, 0.25) and got[2005, "culture"] == (0.0, -0.5)


def test_command_line(spark, sf_dir, tmp_path, capsys):
    from lexmill.__main__ import main

    assert main(["list"]) == 0 and "markedness_by_doc" in capsys.readouterr().out
    assert main(["run", "role_histogram", "--tables", sf_dir, "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 5


def test_cache_outlives_a_run_that_ends_half_way(spark, tmp_path):
    texts = [f"text {i:03d} " + "x" * (i % 3) for i in range(60)]
    chunks = spark.createDataFrame([(i, "T", 2005, t) for i, t in enumerate([*texts, texts[0], None])], "chunk_id long, doc_title string, doc_year int, text string")
    log = tmp_path / "asked"
    log.mkdir()
    flag = tmp_path / "broken"

    def client(text):
        import uuid

        if "text 013" in text and flag.exists():
            raise RuntimeError("the client itself is broken")
        (log / uuid.uuid4().hex).write_text(text)
        return bindings.echo_client(text)

    flag.write_text("")
    path = str(tmp_path / "cache")
    run = lambda: providers.classify_chunks(spark, chunks, path, client, retries=1, pause=0.0, workers=2, commit_rows=6)
    with pytest.raises(Exception, match="broken"):
        run()
    flag.unlink()
    held = providers.cached(spark, path).count()
    first = len(list(log.iterdir()))
    assert 0 < held < 61 * 5
    out = run()
    rows = out.collect()
    assert len(rows) == 62 * 5 and {r["strategy"] for r in rows} == set(bindings.CUES.strategies)
    # what was cached, parsed or not, is not asked again: all that parse are asked once, and one lot twice at most
    again = len(list(log.iterdir())) - first
    assert again <= 61 * 5 - held
    parsed = [p.read_text() for p in log.iterdir()]
    assert {t for t in parsed} == {r["prompt"] for r in providers.strategy_prompts(chunks).select("prompt").distinct().collect()}
    keys = providers.strategy_prompts(chunks).groupBy("prompt").agg(F.count_distinct("prompt_sha").alias("n"), F.first("prompt_sha").alias("k"))
    assert keys.where("n > 1").count() == 0 and keys.select("k").distinct().count() == keys.count() == 61 * 5
    before = len(list(log.iterdir()))
    run().collect()
    errors = len({r["prompt_sha"] for r in rows if r["error"]})
    assert len(list(log.iterdir())) - before == errors
