"""Dual-tree Lloyd: exact k-means rounds over a cover tree of vectors and a tree of centroids.

Vectors become integers, floor(SCALE * x). The cover tree's upper part is a net of
PIVOTS vectors from a bounded sample: every vector belongs to its nearest pivot. Below
it, lots of about LOT vectors of one pivot each get a subtree: a node's members lie
within its radius, its children are a net of half that radius, down to LEAF members.
Nodes keep the count and sum of their vectors. The trees are built and written once.

A round takes pairs of a node and a node of the centroid tree level by level: a
centroid node farther from all of the node's vectors than another one surely is goes;
a node with one centroid left gives it its count and sum whole; at the leaves vectors
are compared with the centroids that remain, in whole numbers. Bounds have a margin for
rounding, so only centroids that are farther for certain go, and ties go to the lower
number. What reaches the driver each round is one row of sums a centroid.

Kept are vectors of exactly DIMS components, none null, NaN or infinite. Components are
held to +-2^26 after scaling, beyond which squared distances would pass 63 bits (sums of
distances that do are held to the greatest long). A null id is hashed as `null`; rows of
equal id are ordered by their components. Repeated rows count as often as they occur.
With fewer vectors than k there are as many centroids as vectors; with none the result is
empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import hashed_sample, materialize, prepare

DIMS, SCALE, K, ROUNDS = 64, 64, 16, 3
#: Sampled vectors that pivots are taken from, pivots, vectors of a subtree, members of a leaf.
SAMPLE, PIVOTS, LOT, LEAF = 1024, 32, 512, 8
MOST = 1 << 26
#: Bounds are widened by this share, far more than their rounding errors.
MARGIN = 1e-9
#: Pairs whose differences are held at once.
PAIRS = 1 << 15


def distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact squared distances of x[i] and y[j]."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), PAIRS):
        d = x[i[a : a + PAIRS]].astype(np.int64) - y[j[a : a + PAIRS]]
        out[a : a + PAIRS] = np.einsum("ij,ij->i", d, d)
    return out


@dataclass
class Tree:
    """Nodes in order of levels: members lie together in `order`, children in the list of nodes."""

    order: np.ndarray  # vectors, so that every node's members are a run of it
    center: np.ndarray  # a vector of each node
    radius: np.ndarray  # no member is farther from the center
    first: np.ndarray
    end: np.ndarray
    child: np.ndarray  # first child, 0 for a leaf
    children: np.ndarray


def net(x: np.ndarray, members: np.ndarray, center: int, reach: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Members, the center first, more than `reach` apart, that have all members within reach; each member's nearest and its squared distance."""
    here = x[members].astype(np.int64)
    d = here - x[center]
    best = np.einsum("ij,ij->i", d, d)
    chosen, owner = [center], np.zeros(len(members), np.int64)
    while True:
        far = int(best.argmax())
        if best[far] <= reach:
            return chosen, owner, best
        d = here - here[far]
        other = np.einsum("ij,ij->i", d, d)
        closer = other < best
        best[closer], owner[closer] = other[closer], len(chosen)
        chosen.append(int(members[far]))


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Tree:
    """A node's children have at most half its radius and centers farther apart than that; equal vectors end in one leaf."""
    members = np.arange(len(x))
    _, _, best = net(x, members, 0, np.inf)
    order, nodes = members.copy(), [[0, float(best.max()), 0, len(x), 0, 0]]
    at = 0
    while at < len(nodes):
        center, radius, first, end, *_ = nodes[at]
        if end - first > leaf and radius > 0:
            mine = order[first:end]
            # radii are squared here: half the radius is a quarter of its square
            chosen, owner, best = net(x, mine, center, radius / 4)
            by = np.argsort(owner, kind="stable")
            order[first:end] = mine[by]
            sizes = np.bincount(owner, minlength=len(chosen))
            most = np.zeros(len(chosen))
            np.maximum.at(most, owner, best)
            nodes[at][4:] = len(nodes), len(chosen)
            start = first
            for c, n, r in zip(chosen, sizes.tolist(), most.tolist(), strict=True):
                nodes.append([c, r, start, start + n, 0, 0])
                start += n
        at += 1
    columns = list(zip(*nodes, strict=True))
    radii = np.sqrt(np.array(columns[1])) * (1 + MARGIN)
    return Tree(order, np.array(columns[0]), radii, *(np.array(c, np.int64) for c in columns[2:]))


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], ..., first[i] + n[i] - 1 for all i in a row."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def assign(x: np.ndarray, tree: Tree, c: np.ndarray, top: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(whole nodes, their centroid, vectors compared apart, their centroid): together every vector once."""
    nodes, node_owner, points, point_owner = [], [], [], []
    q, s = np.zeros(1, np.int64), np.zeros(1, np.int64)  # pairs of a node and a centroid node
    limit = np.full(len(tree.center), np.inf)  # no vector of the node has its nearest centroid farther away
    while len(q):
        d = np.sqrt(distances(x, c, tree.center[q], top.center[s]).astype(float))
        np.minimum.at(limit, q, (d + tree.radius[q]) * (1 + MARGIN))
        keep = d * (1 - MARGIN) - tree.radius[q] - top.radius[s] <= limit[q]
        q, s = q[keep], s[keep]
        single = top.end[s] - top.first[s] == 1
        count = np.bincount(q, minlength=len(limit))
        done = single & (count[q] == 1)
        nodes.append(q[done])
        node_owner.append(top.order[top.first[s[done]]])
        q, s, single = q[~done], s[~done], single[~done]
        q_leaf = tree.children[q] == 0
        # leaves of the centroid tree hold one centroid, or equal ones
        s_leaf = top.children[s] == 0
        wide = ~s_leaf & (q_leaf | (top.radius[s] >= tree.radius[q]))
        waits = np.zeros(len(limit), bool)
        waits[q[wide]] = True  # its pairs go on once its centroid nodes are as small
        ready = ~waits[q]
        compare = ready & q_leaf
        if compare.any():
            a, b = q[compare], s[compare]
            n = top.end[b] - top.first[b]
            a, owner = np.repeat(a, n), top.order[runs(top.first[b], n)]
            m = tree.end[a] - tree.first[a]
            point, owner = tree.order[runs(tree.first[a], m)], np.repeat(owner, m)
            by = np.lexsort((owner, distances(x, c, point, owner), point))
            point, owner = point[by], owner[by]
            nearest = np.flatnonzero(np.diff(point, prepend=-1))
            points.append(point[nearest])
            point_owner.append(owner[nearest])
        down = ready & ~q_leaf
        n = tree.children[q[down]]
        below = runs(tree.child[q[down]], n)
        limit[below] = np.minimum(limit[below], np.repeat(limit[q[down]], n))
        m = top.children[s[wide]]
        stay = ~ready & ~wide
        q, s = (
            np.concatenate([q[stay], np.repeat(q[wide], m), below]),
            np.concatenate([s[stay], runs(top.child[s[wide]], m), np.repeat(s[down], n)]),
        )
    return tuple(np.concatenate([np.zeros(0, np.int64), *found]) for found in (nodes, node_owner, points, point_owner))


# ---- over tables


def whole_numbers(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and x, the scaled components, of every kept vector."""
    v = F.col(vector)
    scaled = F.transform(v, lambda e: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(F.least(F.greatest(e.cast("double"), F.lit(-1e15)), F.lit(1e15)) * SCALE).cast("double"))).cast("int"))
    fine = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) != float("inf")))
    return vectors.where((F.size(v) == DIMS) & fine).select(F.col(key).cast("long").alias("vec_id"), scaled.alias("x"))


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The vectors of the k least hashes of their ids, in that order."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))).cast("binary"), 256)
    found = rows.select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, DIMS)


def nearest_pivot(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, x as bytes, and the number of the nearest pivot."""
    p = pivots.astype(float)
    norms = (p * p).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, DIMS).astype("<i4")
            near = (norms - 2 * (x.astype(float) @ p.T)).argmin(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b["vec_id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(near, pa.int32())], ["vec_id", "x", "pivot"])

    return rows.mapInArrow(run, "vec_id long, x binary, pivot int")


def read(data: bytes, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(*shape)


FIELDS = ("order", "center", "radius", "first", "end", "child", "children")


def grow(key: tuple, group: pa.Table) -> pa.Table:
    """The subtree of one lot of vectors, as one row."""
    x = np.frombuffer(b"".join(group["x"].to_pylist()), "<i4").reshape(-1, DIMS)
    ids = group["vec_id"].combine_chunks()
    tree = cover_tree(x)
    upto = np.concatenate([np.zeros((1, DIMS), np.int64), np.cumsum(x[tree.order].astype(np.int64), axis=0)])
    sums = upto[tree.end] - upto[tree.first]
    parts = [np.asarray(getattr(tree, f), "<f8" if f == "radius" else "<i4").tobytes() for f in FIELDS]
    columns = {"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "x": pa.array([x.tobytes()], pa.binary()), "sums": pa.array([sums.astype("<i8").tobytes()], pa.binary())}
    return pa.table(columns | {f"t_{f}": pa.array([p], pa.binary()) for f, p in zip(FIELDS, parts, strict=True)})


FOREST = "ids array<long>, x binary, sums binary, " + ", ".join(f"t_{f} binary" for f in FIELDS)


def forest(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Subtrees of all vectors: crowded pivots' vectors are dealt to several by a hash of id and place."""
    some = np.array([r["x"] for r in hashed_sample(rows, "vec_id", SAMPLE).collect()], np.int64).reshape(-1, DIMS)
    near = nearest_pivot(rows.select("vec_id", "x"), spread_out(some, PIVOTS)).withColumn("place", F.monotonically_increasing_id())
    near = materialize(spark, near, "pivoted")
    sizes = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a pivot
    parts = F.create_map(*[F.lit(v) for r in sizes for v in (r["pivot"], r["n"] // LOT + 1)]) if sizes else F.create_map(F.lit(0), F.lit(1))
    lot = F.pmod(F.xxhash64("vec_id", "place"), F.element_at(parts, F.col("pivot")))
    return materialize(spark, near.withColumn("lot", lot).groupBy("pivot", "lot").applyInArrow(grow, FOREST), "forest")


def spread_out(x: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of x, each the farthest from those before it."""
    if not len(x):
        return np.zeros((1, DIMS), np.int64)
    chosen, best = [0], np.full(len(x), np.iinfo(np.int64).max)
    while len(chosen) < min(most, len(x)):
        best = np.minimum(best, distances(x, x, np.arange(len(x)), np.full(len(x), chosen[-1])))
        if not best.max():
            break
        chosen.append(int(best.argmax()))
    return x[chosen]


def lots(batches: Iterator[pa.RecordBatch], c: np.ndarray) -> Iterator[tuple]:
    """(ids, vectors, sums of nodes, tree, assignment to centroids c) of every subtree."""
    top = cover_tree(c, 1) if len(c) else None
    for b in batches:
        for i in range(b.num_rows):
            got = {n: b[n][i] for n in b.schema.names}
            x = read(got["x"].as_py(), "<i4", -1, DIMS)
            tree = Tree(*(read(got[f"t_{f}"].as_py(), "<f8" if f == "radius" else "<i4", -1).astype(float if f == "radius" else np.int64) for f in FIELDS))
            yield got["ids"].values, x, read(got["sums"].as_py(), "<i8", -1, DIMS), tree, assign(x, tree, c, top)


def sums(trees: DataFrame, c: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors of each centroid, counted and added up: one row a centroid reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros((len(c), DIMS), np.int64)
        for _, x, node_sums, tree, (nodes, node_owner, points, owner) in lots(batches, c):
            np.add.at(count, node_owner, tree.end[nodes] - tree.first[nodes])
            np.add.at(total, node_owner, node_sums[nodes])
            np.add.at(count, owner, 1)
            np.add.at(total, owner, x[points])
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    rows = trees.mapInArrow(run, "cluster int, n long, total array<long>")
    added = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(DIMS)]
    got = rows.groupBy("cluster").agg(F.sum("n").alias("n"), *added).collect()
    count, total = [0] * len(c), [[0] * DIMS for _ in c]
    for r in got:
        count[r["cluster"]], total[r["cluster"]] = r["n"], [int(r[f"s{i}"]) for i in range(DIMS)]
    return count, total


def labels(trees: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x, _, tree, (nodes, node_owner, points, owner) in lots(batches, c):
            n = tree.end[nodes] - tree.first[nodes]
            point = np.concatenate([tree.order[runs(tree.first[nodes], n)], points])
            owner = np.concatenate([np.repeat(node_owner, n), owner])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(point)), pa.array(owner, pa.int32()), pa.array(distances(x, c, point, owner))], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def lloyd(rows: DataFrame, trees: DataFrame, k: int = K, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after all rounds; an empty one stays where it is."""
    c = first_centroids(rows, k)
    for _ in range(rounds if len(c) else 0):
        count, total = sums(trees, c)
        c = np.array([[s // n for s in t] if n else old for n, t, old in zip(count, total, c.tolist(), strict=True)], np.int64)
    return c


def held(total: Column) -> Column:
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def cluster(spark: SparkSession, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector."""
    prepare(spark)
    rows = whole_numbers(vectors, key, vector)
    trees = forest(spark, rows)
    c = lloyd(rows, trees, k, rounds)
    found = materialize(spark, labels(trees, c), "labels")
    by = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()  # one row a centroid
    marks = [hashlib.sha256(",".join(map(str, r)).encode()).hexdigest() for r in c.tolist()]
    most = (1 << 63) - 1
    total = min(most, sum(int(r["d"]) for r in by))
    inertia = dict.fromkeys(range(max(1, len(c))), 0) | {r["cluster"]: min(most, int(r["d"])) for r in by}
    own = F.element_at(F.array(*[F.lit(inertia[i]).cast("long") for i in sorted(inertia)]), F.col("cluster") + 1)
    mark = F.element_at(F.array(*[F.lit(m) for m in marks or [""]]), F.col("cluster") + 1)
    return found.select("vec_id", "cluster", "distance", own.alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), mark.alias("centroid_sha256"))
