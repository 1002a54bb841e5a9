"""Terms, re-ranking and merging of topics against plain versions."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.operators import topics


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_runs_of_words_stop_at_stop_words(spark, grams):
    texts = ["The law of the land", "a b c", "", None, "of of", "word", "The Scots law AND the Scots tongue"]
    stop = ("the", "of", "and")

    def plain(text):
        words = [w if w not in stop else None for w in re.findall("[A-Za-z]+", (text or "").lower())]
        runs = [words[i : i + n] for n in range(1, grams + 1) for i in range(len(words) - n + 1)]
        return sorted(" ".join(r) for r in runs if None not in r)

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", topics.terms_of(F.col("text"), stop, grams).alias("t")).collect()
    assert {r["i"]: sorted(r["t"]) for r in rows} == {i: plain(t) for i, t in enumerate(texts)}


def plain_merges(scores, wanted):
    """One merge at a time by mean cosine across groups; ties to the pair of the least names."""
    norms = {t: math.sqrt(sum(x * x for x in s.values())) for t, s in scores.items()}
    cos = lambda a, b: sum(x * scores[b].get(w, 0) for w, x in scores[a].items()) / norms[a] / norms[b]
    groups = {t: [t] for t in scores}
    while len(groups) > wanted:
        best = None
        for a, b in itertools.combinations(sorted(groups), 2):
            s = round(sum(cos(x, y) for x in groups[a] for y in groups[b]) / len(groups[a]) / len(groups[b]), 12)
            if s > 0 and (best is None or (s, -a, -b) > best):
                best = (s, -a, -b)
        if best is None:
            break
        groups[-best[1]] += groups.pop(-best[2])
    return {t: min(g) for g in groups.values() for t in g}


@pytest.mark.parametrize("wanted", [1, 5, 11, 40])
def test_merges_equal_one_at_a_time(spark, wanted):
    rng = np.random.default_rng(9)
    scores = {t: {f"w{w}": float(x) for w, x in zip(rng.choice(25, 6, replace=False), rng.uniform(0.1, 3, 6), strict=True)} for t in range(20)}
    scores[20] = {"alone": 1.0}
    rows = [(t, w, x) for t, s in scores.items() for w, x in s.items()]
    df = spark.createDataFrame(rows, "topic_id long, term string, score double")
    got = {r["topic_id"]: r["merged_id"] for r in topics.merged_topics(spark, df, wanted).collect()}
    assert got == plain_merges(scores, wanted)


def test_reranking(spark):
    candidates = spark.createDataFrame([(1, "a"), (1, "b"), (1, "none"), (2, "a"), (2, "c")], "topic_id int, term string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 2.0])], "term string, v array<double>")
    centroids = spark.createDataFrame([(1, [1.0, 1.0]), (2, [0.0, 0.0])], "topic_id int, v array<double>")
    got = [tuple(r) for r in topics.reranked(candidates, vectors, centroids, most=2).orderBy("topic_id", "rank").collect()]
    assert got == [(1, "b", 1.0, 1), (1, "a", 0.707107, 2), (2, "a", 0.0, 1), (2, "c", 0.0, 2)]
