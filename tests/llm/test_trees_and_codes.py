"""Dual-tree rounds, the manifest and the Huffman files against plain versions, and on odd rows."""

import collections
import hashlib
import heapq
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import dualtree, huffman, merkle, queries, radix

CLASHES = "rank long, grp string, number long, content string, start long, n int, x int, pivot int, total int, place int, _d0 string"
CLASH_VALUES = (0, "g", 0, "c", 0, 0, 0, 0, 0, 0, "d")
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], DOCS).repartition(3)


def odd_docs(spark):
    long = "wörd " * 60000
    rows = [(1, None, None, "s", None), (2, "", "en", None, 0), (3, "one two", "en", "s", 7), (3, "one two", "en", "s", 7), (3, "Two one", "en", "s", 7)]
    rows += [(None, "é x <|endoftext|>y", "en", "s", 9), (None, None, "", "s", 2**63 - 1), (-5, long, "fr", "s", 5), (2**62, "z" * 5000, None, "", 1), (-(2**63), " \t", "fr", "s", -1)]
    return docs_of(spark, rows)


# ---- ranks


@pytest.mark.parametrize("limit", [1024, 3])
def test_ranks(spark, monkeypatch, limit):
    monkeypatch.setattr(radix, "LIMIT", limit)
    rng = np.random.default_rng(1)
    keys = [None] * 40 + [7] * 60 + rng.integers(0, 900, 300).tolist() + [-(2**63), 2**63 - 1, -1, 0]
    rows = [(k, "ab"[i % 2], i % 50) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    df = df.withColumn("h", F.xxhash64("v")).withColumn("u", F.col("v") + F.xxhash64("k", "g") % 1000)
    got = radix.ranked(df, "k", "h", "u", ["g"]).collect()
    for g in "ab":
        mine = sorted((r["rank"], r["k"]) for r in got if r["g"] == g)
        assert [r for r, _ in mine] == list(range(len(mine)))
        want = sorted((k for k, x, _ in rows if x == g), key=lambda k: (k is not None, k or 0))
        assert [k for _, k in mine] == want


def test_ranks_of_hot_keys_are_dealt_out(spark):
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.xxhash64("id").alias("h"), F.col("id").alias("u"))
    celled, names = radix.celled(df, "k", "h", "u", [])
    assert celled.groupBy(*names).count().agg(F.max("count")).first()[0] < 512
    same = df.withColumn("k", F.lit(5).cast("long")).withColumn("h", F.lit(9).cast("long"))
    celled, names = radix.celled(same, "k", "h", "u", [])
    assert celled.groupBy(*names).count().agg(F.max("count")).first()[0] < 64


# ---- manifest


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, more=0):
    out = ""
    for c in ("doc_id", "source", "lang", "n_chars", "text"):
        v = r[c]
        if v is not None:
            v = str(v + more if c == "n_chars" else v)
        out += "-" if v is None else f"{len(v.encode())}:{v}"
    return h(out)


def plain_tree(nodes):
    """Root, and for each leaf the (left, right) siblings by level."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for w, i in zip(ways, at, strict=True):
            w.append((level[i - 1], "") if i % 2 else ("", level[i + 1] if i + 1 < len(level) else ""))
        at = [i // 2 for i in at]
        level = [h("".join(level[i : i + 2])) for i in range(0, len(level), 2)]
    return level[0], ways


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["lang"]].append((r, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x for _, x in sorted(groups[g], key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0))]) for g in order}
    root, top = plain_tree([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, top, strict=True):
        for (r, mine), way in zip(sorted(groups[g], key=lambda p: (p[0]["doc_id"] is not None, p[0]["doc_id"] or 0)), trees[g][1], strict=True):
            hit = r["doc_id"] is not None and r["n_chars"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            x = leaf(r, 1) if hit else mine
            for a, b in way + above:
                x = h(a + x + b)
            out.append((r["doc_id"], mine, trees[g][0], root, h("".join(a + b for a, b in way + above)), x, x == root))
    return out


@pytest.mark.parametrize("fold", [10, 2])
def test_manifest(spark, sf_dir, fold):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = merkle.manifest(spark, docs, fold).collect()
    assert sorted(map(tuple, got)) == sorted(plain_manifest(docs.collect()))
    assert {r["verified"] for r in got} == {True, False}


def test_manifest_odd_rows(spark):
    docs = odd_docs(spark)
    got = merkle.manifest(spark, docs).collect()
    roots = {r["root"] for r in got}
    assert len(got) == 10 and len(roots) == 1
    # rows of one id may lie in either order; everything else is fixed
    tell = {(r["doc_id"], r["leaf"]) for r in got}
    assert tell == {(r["doc_id"], leaf(r)) for r in docs.collect()}
    caught = {r["doc_id"] for r in got if not r["verified"]}
    assert caught == {i for i in (2, 3, -5, 2**62, -(2**63)) if zlib.crc32(str(i).encode()) % 7 == 0}
    one = docs_of(spark, [(4, "a", None, None, None)])
    assert [tuple(r) for r in merkle.manifest(spark, one).collect()] == plain_manifest(one.collect())
    assert merkle.manifest(spark, docs.limit(0)).count() == 0


def test_manifest_of_one_hot_id(spark, monkeypatch):
    monkeypatch.setattr(radix, "LIMIT", 8)
    docs = docs_of(spark, [(None, f"t{i % 90}", "en", "s", i % 90) for i in range(100)])
    got = merkle.manifest(spark, docs).collect()
    assert len(got) == 100 and all(r["verified"] for r in got) and len({r["root"] for r in got}) == 1


# ---- Huffman files


def test_ids_of_words_are_ids_of_texts(spark, sf_dir):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += [None, "", " ", "a\x0bb\x0cc\x85d\xa0e f　g", "é ́a ́", "ΟΣ Σας", "don't 's 'S İ﻿x​y\x00z\x1cw"]
    texts += ["<|endoftext|> a<|startoftext|>b <|END<|endoftext|>", "<| x <", "H̱ KK ǅ", "x" * 20000, "\U0001f600‍\U0001f525 ﬁ"]
    words = huffman.Words(path)
    for lot in (texts, texts[::-1], texts[:3]):
        ids, ends = words.encode(pa.array(lot, pa.string()), 2)
        want = [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in lot]
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == want


def test_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(huffman, "WORDS", 10)
    words = huffman.Words(huffman.vocabulary_path())
    for k in range(5):
        ids, ends = words.encode(pa.array([" ".join(f"w{k}x{i}" for i in range(8))]), 2)
        assert len(words.known) <= 10 and ids[-1] == 2 and ends[-1] == len(ids)


def test_code_lengths_are_the_least():
    rng = np.random.default_rng(2)
    for n in (2, 3, 17, 200):
        weights = (rng.pareto(0.7, n) * 10 + 1).astype(int).tolist()
        heap = [(w, i, ()) for i, w in enumerate(weights)]
        heapq.heapify(heap)
        cost, k = 0, n
        while len(heap) > 1:  # Huffman's cost is the sum of all inner nodes
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a[0] + b[0]
            heapq.heappush(heap, (a[0] + b[0], k, ()))
            k += 1
        free = huffman.code_lengths(weights, 60)
        assert sum(w * x for w, x in zip(weights, free, strict=True)) == cost
        bound = max(2, (n - 1).bit_length())
        held = huffman.code_lengths(weights, bound + 1)
        assert max(held) <= bound + 1 and sum(2.0**-x for x in held) <= 1
    # brute force over all lengths of up to 3 bits
    weights = [1, 1, 2, 30, 50]
    best = min(
        sum(w * x for w, x in zip(weights, c, strict=True))
        for c in np.ndindex(*[3] * 5)
        for c in [[x + 1 for x in c]]
        if sum(2.0**-x for x in c) <= 1
    )
    assert sum(w * x for w, x in zip(weights, huffman.code_lengths(weights, 3), strict=True)) == best
    assert huffman.code_lengths([5]) == [1] and huffman.code_lengths([]) == []


def test_blocks_round_trip():
    rng = np.random.default_rng(3)
    ids = np.minimum(rng.zipf(1.3, 20000), 4999).astype(np.uint32)
    lengths = np.zeros(5000, np.uint8)
    seen, n = np.unique(ids, return_counts=True)
    lengths[seen] = huffman.code_lengths(n.tolist())
    ends = np.array([1, 257, 513, 20000])
    data, byte_ends, marks = huffman.pack(ids, ends, lengths, huffman.canonical(lengths)[1])
    sizes = np.diff(ends, prepend=0)
    lanes = np.cumsum(-(-sizes // huffman.LANE))
    cut = lambda x, at: np.split(x, at[:-1])
    parts = cut(np.frombuffer(data, np.uint8), byte_ends)
    made = huffman.block(11, [(i, int(s), m.tobytes(), p.tobytes()) for i, s, m, p in zip([None, -1, 0, 5], sizes, cut(marks, lanes), parts, strict=True)])
    table, start, got = huffman.read_block(made, huffman.decoding_table(lengths.astype(np.int64)))
    assert start == 11 and table["n"].tolist() == sizes.tolist() and table["null"].tolist() == [1, 0, 0, 0] and (got == ids).all()
    bits = sum(int(lengths[i]) for i in ids)
    assert bits <= 8 * len(data) < bits + 8 * 4 + 8


def files_match(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    ids = {t: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in {r["text"] for r in docs.select("text").collect()}}
    blocks, code = huffman.write(spark, docs)
    got = sorted((tuple(r) for r in huffman.read(blocks, code).collect()), key=lambda r: r[1])
    crc = lambda t: zlib.crc32(np.array(ids[t], "<u4").tobytes())
    assert collections.Counter((i, n, c) for i, _, n, c in got) == collections.Counter((r["doc_id"], len(ids[r["text"]]), crc(r["text"])) for r in docs.collect())
    assert [i for i, *_ in got] == sorted((i for i, *_ in got), key=lambda i: (i is not None, i or 0))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    return blocks


def test_files_of_ids(spark, sf_dir):
    files_match(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def test_files_odd_rows(spark, monkeypatch):
    files_match(spark, odd_docs(spark))
    empty = docs_of(spark, [(1, None, None, None, None)] * 3)
    files_match(spark, empty)
    assert huffman.round_trip(spark, empty.limit(0)).count() == 0
    monkeypatch.setattr(radix, "LIMIT", 8)
    hot = docs_of(spark, [(None, "same text", "en", "s", 9)] * 50 + [(7, f"text {i}", "en", "s", 9) for i in range(50)])
    assert files_match(spark, hot).count() > 20


# ---- dual-tree rounds


def plain_lloyd(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'null' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, y, strict=True)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), h(",".join(map(str, c[j])))) for i, j, d in found]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *CLASH_VALUES) for r in rows], f"vec_id long, embedding array<float>, {CLASHES}").repartition(3)


def same(spark, rows):
    got = dualtree.cluster(spark, vectors(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(plain_lloyd(rows))
    return got


def test_dual_tree_on_the_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert collections.Counter(map(tuple, queries.op11_dual_tree(spark, sf_dir).collect())) == collections.Counter(plain_lloyd(rows))


def test_dual_tree_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(i), v.tolist()) for i, v in enumerate(np.float32(rng.normal(0, 1, (60, 64)) + 6 * rng.integers(0, 3, (60, 1))))]
    one = rows[0][1]
    rows += [(7, one), (7, one), (None, one), (None, rows[1][1]), (100, None), (101, one[:63]), (102, [*one, 1.0]), (103, [None, *one[1:]])]
    rows += [(104, [float("nan"), *one[1:]]), (105, [float("inf"), *one[1:]]), (106, [0.0] * 64), (107, [0.0] * 64), (108, [-0.0, *[1e-30] * 63])]
    rows += [(200 + i, [0.5] * 64) for i in range(80)]  # one vector many times: ties between equal centroids
    same(spark, rows)
    monkeypatch.setattr(dualtree, "LOT", 5)
    same(spark, rows)
    assert len(same(spark, rows[:5])) == 5
    assert dualtree.cluster(spark, vectors(spark, rows).limit(0)).count() == 0
    huge = dualtree.cluster(spark, vectors(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)])).collect()
    assert [r["distance"] for r in huge] == [0, 0, 0]


def test_trees_cover_and_separate():
    rng = np.random.default_rng(5)
    x = rng.integers(-50, 50, (400, 64))
    x[:100] //= 20
    tree = dualtree.cover_tree(x)
    assert sorted(tree.order.tolist()) == list(range(400))
    for q in range(len(tree.center)):
        members = tree.order[tree.first[q] : tree.end[q]]
        assert tree.center[q] in members
        assert np.sqrt(((x[members] - x[tree.center[q]]) ** 2).sum(axis=1)).max() <= tree.radius[q]
        kids = np.arange(tree.child[q], tree.child[q] + tree.children[q])
        if len(kids):
            assert sorted(np.concatenate([tree.order[tree.first[k] : tree.end[k]] for k in kids]).tolist()) == sorted(members.tolist())
            assert (tree.radius[kids] <= tree.radius[q] / 2 * (1 + 1e-6)).all()
            centers = x[tree.center[kids]]
            apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) + np.eye(len(kids)) * 1e9
            assert (apart > tree.radius[q] / 2 * (1 - 1e-6)).all()


def test_pruning_leaves_most_vectors_uncompared():
    rng = np.random.default_rng(6)
    centers = rng.integers(-500, 500, (16, 64))
    x = centers[rng.integers(0, 16, 2000)] + rng.integers(-5, 5, (2000, 64))
    tree, top = dualtree.cover_tree(x), dualtree.cover_tree(centers, 1)
    nodes, owner, points, point_owner = dualtree.assign(x, tree, centers, top)
    whole = int((tree.end[nodes] - tree.first[nodes]).sum())
    assert whole + len(points) == 2000 and len(points) < 100
    near = ((x[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    for q, j in zip(nodes, owner, strict=True):
        assert (near[tree.order[tree.first[q] : tree.end[q]]] == j).all()
    assert (near[points] == point_owner).all()


def test_shards_of_a_hot_id(spark, monkeypatch):
    from lexmill.llm import sharding

    monkeypatch.setattr(radix, "LIMIT", 16)
    rows = [(None, f"t{i % 150}" * (1 + i % 3)) for i in range(400)] + [(None, "same")] * 200 + [(i, "x") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard(df, 8, 5).collect()
    order = sorted(((i is not None, i or 0, len(t) + 1, zlib.crc32(t.encode())) for i, t in rows))
    want = collections.Counter((k[1] if k[0] else None, k[2], k[3], *sharding.place(n, len(rows), 8, 5)) for n, k in enumerate(order))
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got) == want
