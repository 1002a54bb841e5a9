"""Readers and writers give back what was written."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.sources import readers, writers


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "Gàidhlig", 1), ("c2", None, 2)], "chunk_id string, text string, n int")
    writers.json_lines(rows, str(tmp_path / "j"))
    assert sorted(readers.json_lines(spark, str(tmp_path / "j"), "chunk_id string, text string, n int").collect(), key=str) == sorted(rows.collect(), key=str)
    grouped = readers.json_lines_grouped(spark, str(tmp_path / "j"), "chunk_id string, text string, n int", "chunk_id")
    assert {r["chunk_id"]: len(r["rows"]) for r in grouped.collect()} == {"c1": 1, "c2": 1}
    writers.csv_table(rows, str(tmp_path / "c"), ["n"])
    assert [r["n"] for r in readers.csv_table(spark, str(tmp_path / "c"), "chunk_id string, text string, n int").collect()] == [1, 2]
    assert json.loads(writers.nested_json(rows, ["chunk_id", "n"], "text")) == {"c1": {"1": "Gàidhlig"}, "c2": {"2": None}}


def test_append_once(spark, tmp_path):
    path = str(tmp_path / "cache")
    row = lambda *k: spark.createDataFrame([(x,) for x in k], "prompt_sha string")
    writers.append_once(row("a"), path, "prompt_sha")
    writers.append_once(row("a", "b"), path, "prompt_sha")
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == ["a", "b"]


def test_texts_and_meta(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("one\ntwo")
    docs = readers.whole_texts(spark, str(tmp_path / "t"))
    meta = spark.createDataFrame([("a.txt", 1)], "filename string, doc_no int")
    assert readers.with_meta(docs, meta).first()["text"] == "one\ntwo"
    with pytest.raises(Exception, match="no metadata"):
        readers.with_meta(docs, meta.where("doc_no = 2")).collect()


def test_graphml(spark, tmp_path):
    edges = spark.createDataFrame([("era (1)", "a<", "b", 2, "amod|obl")], "era string, src string, dst string, weight long, relations string")
    row = writers.graphml(edges).first()
    assert row["file"] == "era_1"
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "era_1.graphml").write_text(row["content"])
    back = readers.graphml(spark, str(tmp_path / "g")).first()
    assert (back["src"], back["dst"], back["weight"], back["relations"]) == ("a<", "b", 2.0, "amod|obl")


def test_scanned_pages(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"p1|p2")
    (tmp_path / "bad.pdf").write_bytes(b"?")

    def ocr(content):
        if content == b"?":
            raise ValueError("no pages")
        return content.decode().split("|")

    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in readers.scanned_pages(spark, str(tmp_path), ocr).collect()}
    assert got == {"x.pdf": ("p1\n\np2", None), "bad.pdf": (None, "no pages")}


def test_graphml_files_round_trip(spark, tmp_path):
    odd = ['a & b', '<edge source="x"/>', "it's \"so\"", "é\n\tx", " space ", "</edge>"]
    edges = [("Era (1)", a, b, float(i), f"{a}|<r>") for i, a in enumerate(odd) for b in odd if a != b]
    edges += [("two", f"n{i}", f"n{i + 1}", 1.0, None) for i in range(500)]
    df = spark.createDataFrame(edges, "era string, src string, dst string, weight double, relations string").repartition(5)
    nodes = spark.createDataFrame([("Era (1)", a, i, f"{a}!") for i, a in enumerate(odd)] + [("empty", "alone", None, None)], "era string, node string, size long, label string")
    nodes = nodes.unionByName(spark.createDataFrame([("two", f"n{i}", i, None) for i in range(501)], nodes.schema))
    path = str(tmp_path / "net")
    writers.graphml_files(df, path, nodes)
    got = {(r["src"], r["dst"]): (r["weight"], r["relations"] or None) for r in readers.graphml(spark, path).collect()}
    assert got == {(a, b): (w, r) for _, a, b, w, r in edges}
    held = {r["node"]: r["data"] for r in readers.graphml_nodes(spark, path).collect()}
    assert held["a & b"] == {"size": "0", "label": "a & b!"} and held["alone"] == {} and len(held) == len(odd) + 502
    # each file is well formed and in order
    from xml.etree import ElementTree

    files = list((tmp_path / "net").glob("file=*/part-*"))
    assert len(files) == 3
    for f in files:
        top = ElementTree.parse(f).getroot()
        names = [n.get("id") for n in top.iter("{http://graphml.graphdrawing.org/xmlns}node")]
        assert names == sorted(names)


def test_graphml_of_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 200_000
    edges = spark.range(n).select(F.lit("e").alias("era"), F.concat(F.lit("s"), F.col("id") % 1000).alias("src"), F.concat(F.lit("t"), F.col("id")).alias("dst"), F.lit(2.0).alias("weight"), F.lit("a&b").alias("relations"))
    path = str(tmp_path / "net")
    writers.graphml_files(edges, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        back = readers.graphml(spark, path)
        assert back.rdd.getNumPartitions() > 3
        row = back.agg(F.count(F.lit(1)), F.sum("weight"), F.count_distinct("dst"), F.min("relations"), F.max("relations")).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(row) == (n, 2.0 * n, n, "a&b", "a&b")


def test_graphml_of_another_writer(spark, tmp_path):
    text = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
  <key id="d1" for="edge" attr.name="relations" attr.type="string" />
  <key id="d0" for="edge" attr.name="weight" attr.type="long"/>
  <graph edgedefault="directed">
    <node id="a" />
    <node
      id="b"><data key="dx">q</data></node>
    <edge target="b" source="a" />
    <edge source='b' target='a &gt; b'>
      <data key="d0">3</data>
      <data key="d1">x|y</data>
    </edge>
  </graph>
</graphml>"""
    (tmp_path / "g.graphml").write_text(text)
    got = sorted(tuple(r) for r in readers.graphml(spark, str(tmp_path / "g.graphml")).collect())
    assert got == [("g.graphml", "a", "b", 1.0, None), ("g.graphml", "b", "a > b", 3.0, "x|y")]
    assert {r["node"]: r["data"] for r in readers.graphml_nodes(spark, str(tmp_path / "g.graphml")).collect()} == {"a": {}, "b": {"dx": "q"}}


def test_pages_are_read_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "log").mkdir()
    for name, content in (("a.pdf", b"p1|p2|bad"), ("b.pdf", b"q1"), ("c.pdf", b"?")):
        (tmp_path / "in" / name).write_bytes(content)
    log, fixed = tmp_path / "log", tmp_path / "fixed"

    def split(content):
        if content == b"?":
            raise ValueError("no pages")
        return content.split(b"|")

    def ocr(page):
        import uuid

        (log / uuid.uuid4().hex).write_bytes(page)
        if page == b"bad" and not fixed.exists():
            raise ValueError("smudged")
        return page.decode().upper()

    run = lambda again=False: readers.ocr_pages(spark, str(tmp_path / "in"), str(tmp_path / "out"), split, ocr, again)
    shown = lambda df: {(r["path"].rsplit("/", 1)[1], r["page"]): (r["text"], r["error"]) for r in df.collect()}
    want = {("a.pdf", 1): ("P1", None), ("a.pdf", 2): ("P2", None), ("a.pdf", 3): (None, "ValueError: smudged"), ("b.pdf", 1): ("Q1", None), ("c.pdf", 0): (None, "ValueError: no pages")}
    assert shown(run()) == want and len(list(log.iterdir())) == 4
    assert shown(run()) == want and len(list(log.iterdir())) == 4
    (tmp_path / "in" / "d.pdf").write_bytes(b"r1|r2")
    assert shown(run()) == want | {("d.pdf", 1): ("R1", None), ("d.pdf", 2): ("R2", None)} and len(list(log.iterdir())) == 6
    fixed.write_text("")
    out = run(again=True)
    assert shown(out)["a.pdf", 3] == ("BAD", None) and len(list(log.iterdir())) == 7
    docs = {r["path"].rsplit("/", 1)[1]: (r["text"], r["errors"]) for r in readers.whole_documents(out).collect()}
    assert docs == {"a.pdf": ("P1\n\nP2\n\nBAD", 0), "b.pdf": ("Q1", 0), "c.pdf": ("", 1), "d.pdf": ("R1\n\nR2", 0)}
