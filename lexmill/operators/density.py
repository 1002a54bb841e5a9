"""Clusters of uneven density with noise: a hierarchy of density levels over a neighbour graph.

A point's core distance is that to its min_samples-th nearest other row; two neighbours
reach each other at the greatest of their distance and core distances. At each of a
bounded ladder of reaches the points fall into components. Read from the widest reach
down, a component that parts into two or more of at least min_size rows is split, one
that only loses points goes on, and clusters are chosen over their own parts where they
last longer (excess of mass). With every distinct reach as a level this is the exact
hierarchy; with fewer, splits are seen at the next level.

All state is in tables: neighbours, spanning forests of blocks of edges, components of
all levels in one run, and the tree of clusters, which has at most two rows for
min_size points. Points of no chosen cluster get -1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.operators.graph import components
from lexmill.operators.neighbours import neighbours, points
from lexmill.storage import discard, written

#: Edges that one task takes a spanning forest of.
FOREST_EDGES = 1 << 18


def reach(near: DataFrame, pts: DataFrame, min_samples: int) -> DataFrame:
    """(a, b, w), a < b: each neighbouring pair once with its mutual reach. Copies of a point are rows at distance 0."""
    weight = pts.select(F.col("point").alias("b"), "weight")
    upto = F.sum("weight").over(Window.partitionBy("a").orderBy("d", "b"))
    ranked = near.join(weight, "b").withColumn("upto", upto)
    own = pts.select(F.col("point").alias("a"), F.col("weight").alias("own"))
    # the first neighbour with which enough rows are within reach; the last one where neighbours are too few
    enough = F.min(F.when(F.col("upto") + F.col("own") - 1 >= min_samples, F.col("d")))
    core = ranked.join(own, "a").groupBy("a").agg(F.first("own").alias("own"), F.coalesce(enough, F.max("d")).alias("core"))
    core = core.select("a", F.when(F.col("own") > min_samples, F.lit(0.0)).otherwise(F.col("core")).alias("core"))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    both = pairs.join(core.withColumnRenamed("core", "ca"), "a").join(core.select(F.col("a").alias("b"), F.col("core").alias("cb")), "b")
    return both.select("a", "b", F.greatest("d", "ca", "cb").alias("w"))


class Trees:
    """Disjoint sets of whole numbers, each named by its least one."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def by_reach(rows: pa.Table) -> list[tuple[int, int, float]]:
    a, b, w = (rows[c].to_numpy() for c in ("a", "b", "w"))
    order = np.lexsort((b, a, w))
    return list(zip(a[order].tolist(), b[order].tolist(), w[order].tolist(), strict=True))


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Up to about FOREST_EDGES rows at a time."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= FOREST_EDGES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def blocks_of(edges: DataFrame, count: int) -> DataFrame:
    """A point's edges to points after it lie together, so that short cycles meet in one block."""
    return edges.repartition(max(1, math.ceil(count / FOREST_EDGES)), "a")


def thinned(edges: DataFrame, count: int) -> DataFrame:
    """edges without those that close a cycle of lighter ones inside a block: the components at every reach stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            trees = Trees()
            kept = [e for e in by_reach(block) if trees.join(e[0], e[1])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*kept, strict=True)], ["a", "b", "w"])

    return blocks_of(edges, count).mapInArrow(run, "a long, b long, w double")


def stars(edges: DataFrame, at: list[float], count: int) -> DataFrame:
    """(level, src, dst): for every level each point of a block with the least one that the block's edges link it to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in in_blocks(batches):
            trees, rows, i = Trees(), by_reach(block), 0
            for level, most in enumerate(at):
                while i < len(rows) and rows[i][2] <= most:
                    trees.join(rows[i][0], rows[i][1])
                    i += 1
                far = [(x, top) for x in list(trees.parent) if (top := trees.find(x)) != x]
                columns = [pa.array([str(p[j]) for p in far], pa.string()) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array([level] * len(far), pa.int32()), *columns], ["level", "src", "dst"])

    return blocks_of(edges, count).mapInArrow(run, "level int, src string, dst string")


def ladder(edges: DataFrame, levels: int | None) -> list[float]:
    """Ascending reaches: quantiles of the edges' reach, or every one of them (None)."""
    if levels is None:
        return sorted(r["w"] for r in edges.select("w").distinct().collect())
    found = edges.agg(F.percentile_approx("w", [i / levels for i in range(1, levels + 1)], 100 * levels)).first()[0]
    return sorted(set(found or []))


def levelled(spark: SparkSession, pts: DataFrame, edges: DataFrame, at: list[float]) -> DataFrame:
    """(level, node, component, weight) for every point and level, level 0 the narrowest; components are named by a point."""
    linked = components(spark, stars(edges, at, edges.count()), by=("level",))
    grid = pts.select(F.explode(F.sequence(F.lit(0), F.lit(len(at) - 1))).alias("level"), F.col("point").cast("string").alias("node"), "weight")
    found = grid.join(linked, ["level", "node"], "left").select("level", "node", F.coalesce("component", "node").alias("component"), "weight")
    return written(spark, found, "levels")


def cluster_tree(spark: SparkSession, found: DataFrame, at: list[float], min_size: int) -> DataFrame:
    """(top, name, size, parent_top, parent, own): clusters by the level and component they start with, their parents, and how much lasts in them.

    The whole set is the cluster (len(at), '').
    """
    n = len(at)
    inverse = F.array(*[F.lit(1 / x) for x in at], F.lit(0.0))
    big = found.groupBy("level", "component").agg(F.sum("weight").alias("size")).where(F.col("size") >= min_size)
    # the component's name is one of its points, so its way up is that point's
    above = found.select((F.col("level") - 1).alias("level"), F.col("node").alias("component"), F.col("component").alias("up"))
    big = big.join(above, ["level", "component"], "left").withColumn("up", F.coalesce("up", F.lit("")))
    siblings = F.count(F.lit(1)).over(Window.partitionBy("level", "up"))
    lasting = F.col("size") * (F.get(inverse, F.col("level")) - F.get(inverse, F.col("level") + 1))
    big = big.withColumns({"starts": siblings > 1, "lasting": lasting})
    # each component points to itself where a cluster starts, else one level up; jumping doubles the way
    jump = big.select("level", "component", F.when(F.col("starts"), F.col("level")).otherwise(F.col("level") + 1).alias("top"), F.when(F.col("starts"), F.col("component")).otherwise(F.col("up")).alias("name"))
    jump = written(spark, jump, "jumps")
    for _ in range(max(1, n).bit_length()):
        ahead = jump.select(F.col("level").alias("top"), F.col("component").alias("name"), F.col("top").alias("_t"), F.col("name").alias("_n"))
        jump = jump.join(ahead, ["top", "name"], "left").select("level", "component", F.coalesce("_t", "top").alias("top"), F.coalesce("_n", "name").alias("name"))
    jump = written(spark, jump, "jumps")
    own = big.join(jump, ["level", "component"]).groupBy("top", "name").agg(F.sum("lasting").alias("own"), F.max("size").alias("size"))
    first = big.where("starts").select(F.col("level").alias("top"), F.col("component").alias("name"), "up")
    way = jump.select((F.col("level") - 1).alias("top"), F.col("component").alias("up"), F.col("top").alias("parent_top"), F.col("name").alias("parent"))
    out = own.join(first, ["top", "name"], "left").join(way, ["top", "up"], "left")
    return out.select("top", "name", "size", F.coalesce("parent_top", F.lit(n)).alias("parent_top"), F.coalesce("parent", F.lit("")).alias("parent"), "own")


def chosen(spark: SparkSession, tree: DataFrame, n: int) -> DataFrame:
    """(top, name, size) of the clusters that last longer than their parts together, the widest first."""
    tree = written(spark, tree.withColumn("root", (F.col("top") == n) & (F.col("name") == "")), "tree")
    best = None
    # from the narrowest level up: a cluster's parts start below it
    for level in [r["top"] for r in tree.select("top").distinct().orderBy("top").collect()]:
        here = tree.where(F.col("top") == level)
        if best is None:
            parts = here.withColumn("parts", F.lit(0.0))
        else:
            sums = best.groupBy(F.col("parent_top").alias("top"), F.col("parent").alias("name")).agg(F.sum("best").alias("parts"))
            parts = here.join(sums, ["top", "name"], "left").na.fill(0.0, ["parts"])
        takes = (F.col("own") >= F.col("parts")) & ~F.col("root")
        step = parts.withColumn("takes", takes).withColumn("best", F.when(F.col("takes"), F.col("own")).otherwise(F.col("parts"))).drop("parts")
        last, best = best, written(spark, step if best is None else best.unionByName(step), "best")
        discard(spark, last)
    if best is None:
        return tree.select("top", "name", "size").limit(0)
    # those below a cluster that is taken go: names of taken ones wander down the tree
    pick, front = None, best.where((F.col("parent") == "") & (F.col("parent_top") == n) & ~F.col("root"))
    while front.limit(1).count():
        took = front.where("takes").select("top", "name", "size")
        pick = took if pick is None else pick.unionByName(took)
        up = front.where("not takes").select(F.col("top").alias("parent_top"), F.col("name").alias("parent"))
        front = written(spark, best.where("not root").join(up, ["parent_top", "parent"], "left_semi"), "front")
    return tree.select("top", "name", "size").limit(0) if pick is None else pick


def density_clusters(
    spark: SparkSession, vectors: DataFrame, min_size: int = 5, min_samples: int = 2, k: int = 15, levels: int | None = 24, trees: int = 4,
    key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(key, topic_id): clusters numbered by their rows, the most first, ties by name; -1 for noise and for vectors that can't be read.

    levels: how many reaches are looked at; None takes every one (each reaches the driver: for small sets).
    All rows together are no cluster.
    """
    pts = points(spark, vectors, vector)
    near = written(spark, neighbours(spark, pts, k, trees), "near")
    edges = written(spark, thinned(reach(near, pts, min_samples), near.count()), "edges")
    at = [x for x in ladder(edges, levels) if x > 0] or [1.0]
    found = levelled(spark, pts, edges, at)
    picked = chosen(spark, cluster_tree(spark, found, at, min_size), len(at))
    place = F.row_number().over(Window.orderBy(F.col("size").desc(), F.col("name").cast("long"), "top")) - 1  # one row a cluster
    named = picked.select(F.col("top").alias("level"), F.col("name").alias("component"), place.alias("topic_id"))
    labels = found.join(named, ["level", "component"]).select(F.col("node").cast("long").alias("point"), "topic_id")
    labels = written(spark, labels, "topics")
    discard(spark, near, edges, found)
    by_vector = pts.join(labels, "point").select(F.col("v").alias("_v"), "topic_id")
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("_v"))
    return rows.join(by_vector, "_v", "left").select(key, F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))
