"""Sentence rows against the token tables, and the parser hook."""

import collections
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.operators import frames, providers, sentences
from test_relations import TOKEN, sentence

LEMMAS = ["Gaelic", "be", "use", "promote", "board", "that", "who", "by", "the", "act"]
POS = ["NOUN", "VERB", "AUX", "ADJ", "DET", "ADV", "ADP", "PROPN"]
DEPS = ["nsubj", "nsubjpass", "csubj", "auxpass", "aux", "agent", "pobj", "dobj", "relcl", "amod", "compound", "prep", "obl", "acl"]


def tree(rng, n):
    """A random tree in projective order: the head of a span, then spans at its sides."""
    head = np.zeros(n, int)

    def grow(low, high, above):
        if low > high:
            return
        at = int(rng.integers(low, high + 1))
        head[at] = at if above < 0 else above
        for a, b in ((low, at - 1), (at + 1, high)):
            while a <= b:
                end = int(rng.integers(a, b + 1))
                grow(a, end, at)
                a = end + 1

    grow(0, n - 1, -1)
    return head.tolist()


def random_sentences(spark, count=150):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(count):
        n = int(rng.integers(1, 14))
        head = tree(rng, n)
        left, right = list(range(n)), list(range(n))
        for i in range(n):  # a subtree's ends, by every node's way up
            at = i
            while True:
                left[at], right[at] = min(left[at], i), max(right[at], i)
                if head[at] == at:
                    break
                at = head[at]
        for i in range(n):
            lemma, pos, dep = (str(rng.choice(x)) for x in (LEMMAS, POS, DEPS))
            tag = str(rng.choice(["VBN", "VBD", "NN"])) if pos == "VERB" else "NN"
            voice = "Pass" if rng.random() < 0.1 else None
            rows.append((f"c{s % 9}", s, i, lemma.upper() if rng.random() < 0.2 else lemma, lemma, pos, tag, "ROOT" if head[i] == i else dep, head[i], voice, left[i], right[i]))
    return spark.createDataFrame(rows, TOKEN).repartition(3)


SHARED = [
    "chunk_id", "sent_id", "token_idx", "target_term", "target_lemma", "dep_head", "dep_head_lemma", "dep_head_pos", "dep_relation", "dep_children",
    "syntactic_role", "modifiers", "governing_verb", "verb_i", "verb_text", "sentence", "subtree_text",
]


def bag(df):
    return collections.Counter(map(repr, df.collect()))


@pytest.fixture(scope="module")
def parsed(spark):
    tokens = random_sentences(spark)
    return tokens, sentences.sentences_of(tokens)


def test_frames_equal_those_of_token_tables(parsed):
    tokens, rows = parsed
    terms = ("gaelic", "Act", "the")
    old = frames.parsed_frames(tokens, terms).select(*SHARED)
    assert bag(old) == bag(sentences.frames(rows, terms).select(*SHARED)) and old.count() > 150


def test_triples_equal_those_of_token_tables(parsed):
    tokens, rows = parsed
    terms = ("gaelic", "Act", "the")
    columns = [*SHARED, "agent_text", "voice", "by_phrase", "agent_category"]
    old = frames.parsed_triples(frames.parsed_frames(tokens, terms), tokens).select(*columns)
    new = sentences.triples(rows, terms).select(*columns)
    assert bag(old) == bag(new)
    assert {"active", "passive", "unknown"} == {r["voice"] for r in new.collect()}


def test_relative_clause_in_a_row(spark):
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
    row = sentences.triples(sentences.sentences_of(tokens), ("gaelic",)).first()
    assert (row["governing_verb"], row["agent_text"], row["agent_category"]) == ("use", "use the board that wants use Gaelic given", "INSTITUTIONAL")
    assert [c["text"] for c in row["dep_children"]] == ["given"] and row["subtree_text"] == "Gaelic"


def test_a_sentence_without_an_exchange(spark):
    rows = sentences.sentences_of(sentence(spark))
    path_free = spark.createDataFrame(rows.collect(), rows.schema)
    plan = sentences.triples(path_free, ("gaelic",))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_long_sentence(spark):
    n = 5000
    words = [("c", 0, i, "w", "w", "NOUN", "NN", "dep", max(0, i - 1), None, i, n - 1) for i in range(n)]
    words[0] = ("c", 0, 0, "use", "use", "VERB", "VB", "ROOT", 0, None, 0, n - 1)
    words[-1] = ("c", 0, n - 1, "Gaelic", "Gaelic", "NOUN", "NN", "dobj", n - 2, None, n - 1, n - 1)
    tokens = spark.createDataFrame(words, TOKEN)
    rows = sentences.sentences_of(tokens)
    held = spark.createDataFrame(rows.collect(), rows.schema)
    sentences.triples(held, ("none",)).collect()
    began = time.perf_counter()
    row = sentences.triples(held, ("gaelic",)).first()
    assert (row["verb_i"], row["verb_text"], row["voice"]) == (0, "use", "unknown")
    assert time.perf_counter() - began < 10  # quadratic or worse would take minutes


def verb_and_object():
    """A function made here travels to the workers whole."""

    def two_words(texts: pa.Array) -> pa.Array:
        """A verb and its object; says how many texts it was asked by the tag."""
        made = []
        for t in texts.to_pylist():
            if t is None:
                made.append(None)
                continue
            verb, thing = t.split(" ")
            made.append(
                [
                    {"i": 0, "text": verb, "lemma": verb, "pos": "VERB", "tag": str(len(texts)), "dep": "ROOT", "head_i": 0, "left": 0, "right": 1, "voice": None},
                    {"i": 1, "text": thing, "lemma": thing, "pos": "NOUN", "tag": "NN", "dep": "dobj", "head_i": 0, "left": 1, "right": 1, "voice": None},
                ]
            )
        return pa.array(made, pa.list_(providers.TOKEN))

    return two_words


@pytest.mark.parametrize("once", [False, True])
def test_parser_hook(spark, once):
    rows = [(i, "use Gaelic" if i % 2 else "keep Scots", "x") for i in range(40)] + [(40, None, "x"), (None, "use Gaelic", None)]
    df = spark.createDataFrame(rows, "id long, sentence string, tokens_of string").repartition(1)
    out = providers.parsed_sentences(df, verb_and_object(), once=once)
    got = out.collect()
    assert len(got) == 42 and all((r["tokens"] is None) == (r["sentence"] is None) for r in got)
    # equal sentences are asked once a batch
    assert {r["tokens"][0]["tag"] for r in got if r["tokens"]} <= {"1", "2"}
    found = sentences.frames(out, ("gaelic",)).select("governing_verb", "syntactic_role").distinct().collect()
    assert [tuple(r) for r in found] == [("use", "patient")]
    assert providers.parsed_sentences(df.limit(0), verb_and_object(), once=once).count() == 0


def test_stand_in_parser_is_asked_with_any_batch():
    from lexmill.plans import bindings

    assert len(bindings.five_words(pa.array([], pa.string()))) == 0
    tokens = bindings.five_words(pa.array(["A bb abcd ee F"])).to_pylist()[0]
    assert [t["dep"] for t in tokens] == ["nsubjpass", "auxpass", "ROOT", "agent", "pobj"] and [t["head_i"] for t in tokens] == [2, 2, 2, 2, 3]
