"""Phases write what the queries can, by function and from the command line; hooks for encoders, detectors and token counts."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill import __main__ as cli
from lexmill.operators import providers, subwords
from lexmill.plans import bindings, phases
from lexmill.sources import readers


def small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 30").select("doc_id", "text")
    meta = docs.select("doc_id", F.col("doc_id").cast("int").alias("doc_no"), F.concat(F.lit("T"), F.col("doc_id") % 3).alias("doc_title"), F.lit(2005).alias("doc_year"))
    return docs, meta


def test_phase1_with_models(spark, sf_dir, tmp_path):
    docs, meta = small(spark, sf_dir)

    def encoder(texts):
        return pa.array([[float(len(t)), 1.0] for t in texts.to_pylist()], pa.list_(pa.float64()))

    def detector(window):
        return "\n".join(json.dumps({"line_num": int(x.split(": ", 1)[0]), "section_id": "s"}) for x in window.split("\n")[:1])

    out = str(tmp_path / "1")
    run = lambda **more: phases.run_phase1(spark, docs, meta, out, "[A-Z]{2,}\\b", encoder=encoder, detector=detector, count=subwords.counter(["a", "##b"]), model="m1", artefacts=True, **more)  # noqa: E731, E501
    got = run()
    vectors = {r["chunk_id"]: r["embedding"] for r in spark.read.parquet(f"{out}/embeddings").collect()}
    chunks = spark.read.parquet(f"{out}/chunks").collect()
    assert got["vectors"] == got["chunks"] == len(chunks) == sum(got["chunks_per_doc"].values())
    assert all(vectors[c["chunk_key"]] == [float(len(c["text_with_prefix"])), 1.0] for c in chunks) and {c["section_id"] for c in chunks} >= {"s"}
    index = spark.read.parquet(f"{out}/embeddings_index").collect()
    assert len(index) == len(chunks) and {(r["dimensions"], r["is_zero"]) for r in index} == {(2, False)}
    back = spark.read.json(f"{out}/json/chunks")
    assert back.count() == len(chunks) and spark.read.csv(f"{out}/csv/chunks_per_doc", header=True).count() == 3
    with pytest.raises(Exception, match="vectors for"):
        providers.encoded(spark.createDataFrame([("c", "t")], "chunk_id string, text_with_prefix string"), lambda t: pa.array([], pa.list_(pa.float32()))).collect()


PHASE2 = [
    "topics", "topics_over_time", "topic_trajectories", "topic_words", "topic_terms_reranked", "frames", "agency_summary", "predicate_inventory", "edges",
    "degrees", "pagerank", "emerging_edges", "centrality_table", "network_comparison", "betweenness", "network_growth",
]


def test_phase2_by_density_and_its_artefacts(spark, sf_dir, tmp_path):
    rng = np.random.default_rng(2)
    chunks = bindings.chunks(spark, sf_dir).where("chunk_id < 90")
    vectors = spark.createDataFrame([(i, (rng.normal(0, 0.05, 8) + 5 * np.eye(8)[i % 3]).tolist()) for i in range(90)], "chunk_id long, embedding array<double>")
    out = str(tmp_path / "2")
    got = phases.run_phase2(spark, chunks, vectors, out, bindings.LEXICON, by_density=True, merge_to=2, grams=2, stop=("the",), artefacts=True, between=True)
    for name in PHASE2:
        assert spark.read.parquet(f"{out}/{name}").count() >= 0, name
    found = {r["vec_id"]: r["topic_id"] for r in spark.read.parquet(f"{out}/topics").collect()}
    assert len(found) == 90 and len(set(found.values()) - {-1}) == 2
    assert got["topics"] == 2 and spark.read.parquet(f"{out}/topic_terms_reranked").count() == 20
    edges = spark.read.parquet(f"{out}/edges")
    back = readers.graphml(spark, f"{out}/graphml")
    assert back.count() == edges.count() and back.agg(F.sum("weight")).first()[0] == edges.agg(F.sum("weight")).first()[0]
    nodes = readers.graphml_nodes(spark, f"{out}/graphml")
    assert nodes.where("data['pagerank'] is null").count() == 0 and nodes.count() == spark.read.parquet(f"{out}/degrees").count()
    assert spark.read.json(f"{out}/json/topic_words").count() == spark.read.parquet(f"{out}/topic_words").count()


def test_profiles(spark, sf_dir, tmp_path):
    quotes = F.when(F.col("present"), F.array(F.lit("so it says"))).otherwise(F.array().cast("array<string>"))
    classified = bindings.classified(spark, sf_dir).withColumn("evidence_quotes", quotes)
    got = phases.run_profiles(
        spark, bindings.chunks(spark, sf_dir), bindings.frames(spark, sf_dir), classified, str(tmp_path / "p"), bindings.triples(spark, sf_dir), artefacts=True
    )
    assert got["tables"] == ["titled_profiles", "topos_levels", "markedness_density", "markedness_profile", "identity_evidence", "power_profiles", "agency_flags"]
    for name in got["tables"]:
        n = spark.read.parquet(str(tmp_path / "p" / name)).count()
        assert n > 0 and spark.read.json(str(tmp_path / "p" / "json" / name)).count() == n == spark.read.csv(str(tmp_path / "p" / "csv" / name), header=True, multiLine=True, escape='"').count(), name


def test_command_line(spark, sf_dir, tmp_path, capsys, monkeypatch):
    docs, meta = small(spark, sf_dir)
    docs.write.parquet(str(tmp_path / "docs"))
    meta.write.json(str(tmp_path / "meta.json"))
    settings = tmp_path / "settings"
    settings.write_text(f"# folders\nLEXMILL_DOCS='{tmp_path}/docs'\nLEXMILL_OUT={tmp_path}/unused\nLEXMILL_ARTEFACTS=1\n")
    monkeypatch.setenv("LEXMILL_ENV", str(settings))
    monkeypatch.setenv("LEXMILL_OUT", str(tmp_path / "1"))
    assert cli.main(["phase1", "--meta", str(tmp_path / "meta.json"), "--skip-embeddings"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert said["chunks"] > 0 and said["vectors"] == 0 and spark.read.json(str(tmp_path / "1" / "json" / "chunks")).count() == said["chunks"]
    chunks = spark.read.parquet(str(tmp_path / "1" / "chunks")).drop("chunk_id").withColumnRenamed("chunk_key", "chunk_id").withColumn("era", F.lit("e"))
    chunks.write.parquet(str(tmp_path / "chunks"))
    assert cli.main(["phase3", "--chunks", str(tmp_path / "chunks"), "--out", str(tmp_path / "3"), "--sample", "10"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rows"] == 50
    with pytest.raises(SystemExit):
        cli.main(["phase4", "--out", "x"])
