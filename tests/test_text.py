"""Cleaning, sections, chunks and tolerant parsing on small inputs."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as ft
from lexmill.operators import chunking, cleaning


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def lines(df):
    return [r["line"] for r in df.orderBy("line_no").collect()]


def value(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def test_boilerplate_goes_before_the_contents_are_counted(spark):
    left = cleaning.drop_contents(cleaning.drop_boilerplate(cleaning.lines_of(docs(spark, "B\nl1\nl2\nl3")), ["B$"]), 1)
    assert lines(left) == ["l2", "l3"]


@pytest.mark.parametrize(
    ("text", "left"),
    [("body\n\n© Crown Copyright\nx\nISBN 12-3", ["body"]), ("ISBN 1\nx", ["ISBN 1", "x"]), ("", [""])],
)
def test_publisher_tail(spark, text, left):
    assert lines(cleaning.drop_publisher_tail(cleaning.lines_of(docs(spark, text)))) == left


@pytest.mark.parametrize(
    ("text", "left"),
    [
        ("a\nTextual Amendments\nF2\nS. 1(2) inserted by x\n(b) keep\nc", ["a", "(b) keep", "c"]),
        ("Textual Amendments\n\nF2", ["", "F2"]),
        ("a\nb", ["a", "b"]),
        ("Textual Amendments\nF2 New wording\nkeep", ["F2 New wording", "keep"]),
        ("Textual Amendments\nS.S.I. 2006/1\n2006/1,  reg. 2\nS.S.I. x", ["S.S.I. x"]),
    ],
)
def test_amendments(spark, text, left):
    assert lines(cleaning.drop_amendments(cleaning.lines_of(docs(spark, text)))) == left


def test_government_headers(spark):
    text = "changes to legislation: all\nx View outstanding changes\nJINDIPERS!\nkeep\nPart One\nbefore 1 December 2025 x\nappear in the content and are referenced y"
    assert lines(cleaning.drop_government_headers(cleaning.lines_of(docs(spark, text)), ("Part",))) == ["keep"]


def test_text_functions(spark):
    assert value(spark, ft.fix_ocr, "xfORy tbat") == "xFORy that"
    assert value(spark, ft.rejoin_hyphens, "Interpreta-\ntion co-\nOp") == "Interpretation co-\nOp"
    assert value(spark, ft.normalize_space, "a  \n\n\nb\n") == "a\n\nb"
    assert value(spark, ft.strip, "  x\t ") == "x"
    assert value(spark, ft.sentences, 'A b. C d! (e) f? "G" h. lower\n\nNew') == ["A b.", "C d!", "(e) f?", '"G" h. lower', "New"]


def test_whole_chain(spark):
    out = cleaning.clean_documents(docs(spark, "B\ntoc\nfOR the Interpreta-\ntion  \n\n\nend", None), ("B$",), 1)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {0: "FOR the Interpretation\n\nend"}


def test_sections(spark):
    found = chunking.sections(cleaning.lines_of(docs(spark, "Intro\n1. Title A\nbody\n2. B", "\n2. \n", "")), "\\d+\\.\\s")
    rows = [(r["doc_id"], r["section_id"], r["section_title"], r["start_line"], r["end_line"]) for r in found.orderBy("doc_id", "section_seq").collect()]
    assert rows == [(0, "preamble", "Preamble", 0, 0), (0, "1.", "Title A", 1, 2), (0, "2.", "B", 3, 3), (1, "preamble", "Preamble", 1, 2), (2, "full", "Full Document", 0, 0)]


@pytest.mark.parametrize(
    ("sizes", "packs"),
    [((2, 2, 3), [[0, 1], [1, 2]]), ((3, 2, 5), [[0, 1], [1, 2]]), ((), []), ((5,), [[0]])],
)
def test_packing_with_overlap(sizes, packs):
    units = [(str(i), n) for i, n in enumerate(sizes)]
    assert [[int(u) for u, _ in p] for p in chunking.pack(units, 5, 2)] == packs


def test_a_sentence_beyond_the_budget_is_cut_by_words():
    got = chunking.chunk_texts([("s1 s1", 2), ("w1 w2 w3 w4 w5 w6 w7", 7)], 5, 2, lambda w: 1)
    assert got == ["s1 s1", "w1 w2 w3 w4 w5", "w4 w5 w6 w7"]


def test_labels_are_not_cut(spark):
    chunks = spark.createDataFrame([(7, 1, "1.", 1000, "x", 1), (8, 1, "1.", 2, "y", 1)], "doc_id long, section_seq long, section_id string, chunk_no int, text string, token_count int")
    meta = spark.createDataFrame([(7, 100, "T", 1998)], "doc_id long, doc_no int, doc_title string, doc_year int")
    assert sorted(r["chunk_id"] for r in chunking.assemble(chunks, meta).collect()) == ["doc00_1._002", "doc100_1._1000"]


def test_section_texts_are_stripped(spark):
    found = chunking.sections(cleaning.lines_of(docs(spark, "  1. A\n x \n\n")), "\\d+\\.\\s")
    assert [r["text"] for r in found.collect()] == ["1. A\n x"]


def test_chunks_are_labelled(spark):
    found = chunking.sections(cleaning.lines_of(docs(spark, "1. A\nx y z")), "\\d+\\.\\s")
    meta = spark.createDataFrame([(0, 3, "T", 1998)], "doc_id long, doc_no int, doc_title string, doc_year int")
    row = chunking.assemble(chunking.chunk_sections(found), meta).first()
    assert (row["chunk_id"], row["total_chunks_in_section"]) == ("doc03_1._000", 1)
    assert row["text_with_prefix"].startswith("[DOC: T (1998) | SEC: 1.] 1. A")


WHOLE = {"strategy_name": "nomination", "present": True, "confidence": 0.5, "evidence_quotes": ["q"], "target_languages": ["Gaelic"]}


@pytest.mark.parametrize(
    ("reply", "got"),
    [
        (json.dumps(WHOLE), (True, 0.5, ["q"], None)),
        ("text\n```json\n" + json.dumps(WHOLE) + "\n```", (True, 0.5, ["q"], None)),
        ('{"strategy_name": "predication", "present": true, "confidence": 0.8, "evidence_quotes": ["a long quote", "tiny"', (True, 0.8, ["a long quote"], True)),
        ('{"strategy_name": "predication", "confidence": 0.8', None),
        ("nothing", None),
        (None, None),
    ],
)
def test_tolerant_reply(spark, reply, got):
    r = value(spark, ft.parse_reply, reply)
    assert (r and (r["present"], r["confidence"], r["evidence_quotes"], r["repaired"])) == got
