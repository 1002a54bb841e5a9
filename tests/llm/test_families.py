"""Families of near copies: pairs that are formed stay few, links stay all."""

import random

from pyspark.sql import functions as F

from lexmill.llm import partenum


def family(n: int) -> list[str]:
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(400), rng.randrange(1, 12)):
            words[at] = f"x{i}y{at}"
        out.append(" ".join(words))
    return out


def least_reachable(texts: list[str], num: int = 85, den: int = 100) -> list[int]:
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split(" ") for t in texts)]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            same = len(x & sets[j])
            if den * same >= num * (len(x) + len(sets[j]) - same) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if v == high else v for v in label]
    return label


def test_pairs_of_a_family_are_few_and_its_links_all(spark, monkeypatch):
    """Each step's distinct pairs before whole bitmaps: chains in proportion to the sets, the rest few of all pairs."""
    formed = []
    possible = partenum.possible

    def counting(pairs, *rest):
        formed.append(pairs.count())
        return possible(pairs, *rest)

    monkeypatch.setattr(partenum, "possible", counting)
    n = 160
    texts = family(n)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in partenum.components(spark, docs).collect()}
    want = dict(enumerate(least_reachable(texts)))
    assert found == want and 1 < len(set(want.values())) < n
    assert formed[0] <= 8 * n and formed[1] < n * n / 8


def test_the_middle_bitmap_rules_out_no_link(spark):
    """similar_middle() holds for every pair of similar sets, of small sets and of sets larger than the bitmap."""
    for size in (3, 40, 1500):
        words = [f"w{i}" for i in range(size)]
        texts = [" ".join(words), " ".join([*words, "more"]), " ".join(f"v{i}" for i in range(size))]
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        sets = docs.mapInArrow(partenum.describe(1), partenum.META_SQL).select("doc_id", F.struct(F.col("n_shingles").alias("n"), "middle").alias("x"))
        pair = sets.alias("l").join(sets.select("doc_id", F.col("x").alias("y")).alias("r"), F.col("l.doc_id") < F.col("r.doc_id"))
        kept = {(r[0], r[1]) for r in pair.where(partenum.similar_middle("x", "y", 3, 4)).select("l.doc_id", "r.doc_id").collect()}
        assert (0, 1) in kept and (0, 2) not in kept
