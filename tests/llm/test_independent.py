"""Operators against versions written apart from their code, and against the best possible result."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
from lexmill.llm import multiset, packing, textfeat


def word_hash(word):
    """A polynomial over the bytes, then the mixer, in plain integers."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
        return x ^ (x >> 31)

    total = sum(mix((mix(b + 1) + 1) & m) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, b in enumerate(word))
    return mix(total & m), mix


def lanes(text):
    """The like lanes of a text, run by run."""
    _, mix = word_hash(b"x")
    out = collections.Counter()
    for line in text.encode().split(b"\n"):
        hashes = [word_hash(w)[0] for w in re.findall(rb"[^\x20\x09-\x0D]+", line)]
        if not hashes:
            continue
        few = len(hashes) < 3
        for i in range(max(1, len(hashes) - 2)):
            run = hashes[i : i + 3]
            total = (len(run) if few else 0) + sum(h * int(g) for h, g in zip(run, textfeat.GRAM, strict=False))
            x = mix(total & ((1 << 64) - 1))
            out[x % multiset.LIKE_LANES] += 1 - 2 * (x >> 32 & 1)
    return [out[k] for k in range(multiset.LIKE_LANES)]


def equal_lanes(text):
    sums = [0] * multiset.EQUAL_LANES
    for line in text.encode().split(b"\n"):
        if line:
            d = hashlib.blake2b(line, digest_size=8 * multiset.EQUAL_LANES).digest()
            sums = [(s + int.from_bytes(d[8 * k : 8 * k + 8], "little")) % 2**64 for k, s in enumerate(sums)]
    return sums


def test_fingerprints_run_by_run(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    texts += ["", "one", "one two", "\n\n", "a b c\nc b a\n\na b c", "é 𝒳 z\nÉ"]
    for text, mark in zip(texts, multiset.fingerprints(texts), strict=True):
        equal, like = mark.split(":")
        assert [int(equal[i : i + 16], 16) for i in range(0, len(equal), 16)] == equal_lanes(text)
        assert [int(like[i : i + 8], 16) for i in range(0, len(like), 8)] == [x % 2**32 for x in lanes(text)]


def test_likeness_is_the_cosine_of_the_lanes():
    pairs = [("a b c d e", "a b c d f"), ("a b c", "a b c"), ("a b c", "x y z"), ("", "a"), ("", "")]
    for a, b in pairs:
        va, vb = (multiset.vectors([t.encode()]) for t in (a, b))
        x, y = lanes(a), lanes(b)
        norm = math.sqrt(sum(v * v for v in x) * sum(v * v for v in y))
        want = 1.0 if a == b else max(0.0, min(0.999999, sum(p * q for p, q in zip(x, y, strict=True)) / norm if norm else 0.0))
        assert abs(multiset.likeness(va, vb)[0] - want) < 1e-9


def test_long_repetitive_texts_are_like_their_short_form():
    for n in (1_000, 33_000, 200_000):
        a, b = (multiset.vectors([("w " * k).encode()]) for k in (n, n + 50))
        assert multiset.likeness(a, b)[0] > 0.999


def cheapest(lengths, capacities):
    """The least cost over all ways to group the lengths."""
    best = math.inf
    for dealt in itertools.product(range(len(lengths)), repeat=len(lengths)):
        sums = collections.Counter()
        for n, b in zip(lengths, dealt, strict=True):
            sums[b] += n
        if all(s <= capacities[-1] for s in sums.values()):
            best = min(best, sum(packing.cost(next(c for c in capacities if c >= s)) for s in sums.values()))
    return best


def test_packing_is_near_the_optimum_of_small_blocks():
    rng = np.random.default_rng(5)
    ratios = []
    for _ in range(40):
        lengths = sorted(rng.integers(1, 65, 6).tolist(), reverse=True)
        got = sum(map(packing.cost, packing.pack_block(lengths, (16, 32, 64))[3]))
        ratios.append(got / cheapest(lengths, (16, 32, 64)))
    assert min(ratios) >= 1 - 1e-12 and np.mean(ratios) < 1.1 and max(ratios) < 1.5


def test_equal_rows_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "COPIES_EACH", 100)
    df = spark.createDataFrame([(None, "w " * 700)] * 900 + [(1, "x")], "doc_id long, text string").repartition(3)
    rows = packing.pack(df, block_rows=50).collect()
    assert sorted(r["copy"] for r in rows if r["doc_id"] is None) == list(range(900)) and sum(r["n_tokens"] for r in rows) == 900 * 700 + 1
    blocks = collections.Counter(r["sequence_id"] >> 24 for r in rows)
    assert len(blocks) > 10 and max(blocks.values()) < 150
