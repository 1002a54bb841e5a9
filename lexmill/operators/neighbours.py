"""Nearest neighbours of vectors: candidates from random-projection trees, distances exact.

Every vector is dealt to one leaf of each of several trees, whose upper splits come from
a bounded sample; the rows of a leaf meet in one task, which splits them on until a
block has `block` rows and compares these with each other. Each split is at a median, so
leaves stay even. Equal vectors must be made one row with a weight first (``points``),
as a split can't part them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.storage import ship, written

#: Sampled vectors that the upper splits are made from, and how many of them a leaf has at least.
SAMPLE, SAMPLED_EACH = 16384, 16


def points(spark: SparkSession, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(point, v, weight): each distinct vector of finite numbers once, written to the shared folder.

    Vectors that are null, empty, or hold a null, NaN or infinite number are left out.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.where((F.size(vector) > 0) & fine).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("weight"))
    return written(spark, rows.select(F.monotonically_increasing_id().alias("point"), "v", "weight"), "points")


def split(x: np.ndarray, rows: np.ndarray, most: int, rng: np.random.Generator) -> Iterator[tuple[list, np.ndarray]]:
    """Blocks of `most` rows at most with the splits that lead to them: (direction, bound, side)."""
    todo = [([], rows)]
    while todo:
        way, at = todo.pop()
        if len(at) <= most:
            yield way, at
            continue
        # from one row to another: a direction along which the rows are spread
        a, b = x[rng.choice(at, 2, replace=False)]
        direction = b - a
        if not direction.any():
            direction = rng.normal(size=x.shape[1])
        along = x[at] @ direction
        bound = float(np.median(along))
        low = along < bound
        if not low.any() or low.all():  # nothing to tell them apart along this way
            low = rng.permutation(len(at)) < len(at) // 2
        todo += [([*way, (direction, bound, True)], at[low]), ([*way, (direction, bound, False)], at[~low])]


def leaves(x: np.ndarray, most: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that gives the leaf of vectors in a tree whose splits are made from x."""
    rng = np.random.default_rng(seed)
    found = list(split(x, np.arange(len(x)), max(1, most), rng)) if len(x) else []
    ways = [w for w, _ in found]

    def leaf(y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y), np.int64)
        todo = [(list(range(len(ways))), 0, np.arange(len(y)))]
        while todo:
            mine, depth, rows = todo.pop()
            if not len(rows) or len(mine) < 2:
                out[rows] = mine[0] if mine else 0
                continue
            direction, bound, _ = ways[mine[0]][depth]
            low = y[rows] @ direction < bound
            todo.append(([i for i in mine if ways[i][depth][2]], depth + 1, rows[low]))
            todo.append(([i for i in mine if not ways[i][depth][2]], depth + 1, rows[~low]))
        return out

    return leaf


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and distances of the k nearest other rows of each row, ties to the lower number."""
    square = (x * x).sum(axis=1)
    d = square[:, None] + square[None] - 2 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    near = np.argsort(d, axis=1, kind="stable")[:, :k] if k < 1 or len(x) < 3 * k else np.argpartition(d, k - 1, axis=1)[:, :k]
    gap = x[near] - x[:, None]
    return near, np.sqrt((gap * gap).sum(axis=2))  # again, without the rounding of the products


def neighbours(spark: SparkSession, pts: DataFrame, k: int = 15, trees: int = 4, block: int = 512, seed: int = 1) -> DataFrame:
    """(a, b, d): the k nearest of the candidates of each point. With one block or fewer, those are all other points."""
    ship(spark)
    n = pts.count()
    sample = pts.orderBy(F.xxhash64("point"), "point").limit(min(n, SAMPLE)).select("v").collect() if n > block else []
    x = np.array([r["v"] for r in sample], float)
    each = max(SAMPLED_EACH, int(len(x) * 8 * block / max(1, n)))  # a leaf of about eight blocks, or more where the sample ends
    trees = trees if n > block else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf = [leaves(x, each, seed + t) for t in range(trees)]
        for b in batches:
            if not b.num_rows:
                continue
            y = np.stack([np.asarray(r, float) for r in b["v"].to_pylist()])
            for t in range(trees):
                made = [pa.array(np.full(len(y), t), pa.int32()), pa.array(leaf[t](y), pa.int32())]
                yield pa.RecordBatch.from_arrays([b["point"], b["v"], *made], ["point", "v", "tree", "leaf"])

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        ids = group["point"].to_numpy()
        order = np.argsort(ids)
        ids = ids[order]
        y = np.stack([np.asarray(r, float) for r in group["v"].to_pylist()])[order]
        rng = np.random.default_rng(seed + 1000 * key[0].as_py() + key[1].as_py())
        a, b, d = [], [], []
        for _, rows in split(y, np.arange(len(y)), block, rng):
            near, far = nearest(y[rows], k)
            a.append(np.repeat(ids[rows], near.shape[1]))
            b.append(ids[rows][near].ravel())
            d.append(far.ravel())
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64()), "d": np.concatenate(d)})

    dealt = pts.select("point", "v").mapInArrow(deal, "point long, v array<double>, tree int, leaf int")
    found = dealt.groupBy("tree", "leaf").applyInArrow(compare, "a long, b long, d double").groupBy("a", "b").agg(F.min("d").alias("d"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
