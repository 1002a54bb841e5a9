"""Merkle manifest of a dataset: leaves of rows, a tree for each group, proofs, and their check.

A leaf is the SHA-256 of a row's columns, each as its byte count and value. Leaves
are ranked inside their group by id from digit histograms (``radix``). The digits of
a rank to the base of the fan-out key the nodes of a trie: leaves that share all
digits but the last FOLD are reduced together, their roots again, and so on, so a
tree of n leaves takes log(n) / FOLD shuffles. The group's roots, in order of the
group, make one more tree. The way from a leaf to the root is put together from the
top down, and every (tampered) leaf is folded along it.

Nulls: a null column is `-` in a leaf; a null group is a group of its own and the
first; a null id sorts first and is never tampered with. Rows of equal id are ordered
by a hash of their leaf. Repeated rows have their own places. Empty input gives an
empty result. Columns beyond those named are ignored. Only ids and digests move.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm import radix
from lexmill.llm.common import discard, materialize, prepare

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Digits of the rank that one shuffle takes off; FANOUT ** FOLD nodes at most are reduced together.
FOLD = 10
#: Rows whose checksum this divides are tampered with, to show what a proof catches.
TAMPERED = 7


def digest(x: str) -> str:
    return sha256(x.encode()).hexdigest()


def height(n: int, fanout: int = FANOUT) -> int:
    """Levels above n nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


def climb(nodes: list[str], levels: int, fanout: int = FANOUT) -> list[list[str]]:
    """nodes and the given number of levels above them; a run of one node is hashed too."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def steps(levels: list[list[str]], i: int, fanout: int = FANOUT) -> Iterator[tuple[str, str]]:
    """(siblings to the left, siblings to the right) of node i and of the nodes above it, as hex text."""
    for nodes in levels[:-1]:
        run = i - i % fanout
        yield "".join(nodes[run:i]), "".join(nodes[i + 1 : run + fanout])
        i //= fanout


def written_way(way: list[tuple[str, str]]) -> str:
    return ",".join(f"{a}/{b}" for a, b in way)


def read_way(way: str) -> list[tuple[str, str]]:
    return [tuple(x.split("/")) for x in way.split(",")] if way else []


def fold(leaf: str, way: list[tuple[str, str]]) -> str:
    for a, b in way:
        leaf = digest(a + leaf + b)
    return leaf


def proof(way: list[tuple[str, str]]) -> str:
    return digest("".join(a + b for a, b in way))


def leaf_of(columns: dict[str, Column]) -> Column:
    parts = []
    for x in columns.values():
        s = x.cast("string")
        parts.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp, doc_id, leaf, tampered (null where the row is not tampered with), and what ranks need."""
    plain = {c: F.col(c) for c in COLUMNS}
    # wider than any integer, so that the greatest one can be added to
    edited = plain | {"n_chars": F.col("n_chars").cast("decimal(30,0)") + 1}
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0)
    return docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_of(plain).alias("leaf"),
        F.when(hit, leaf_of(edited)).alias("tampered"),
        F.monotonically_increasing_id().alias("number"),
    ).withColumn("content", F.xxhash64("leaf"))


def together(nodes: DataFrame, columns: list[str], fold_digits: int) -> DataFrame:
    """One row for each run of nodes that agree in all digits of `rank` but the last ones: a bounded array each."""
    each = FANOUT**fold_digits
    run = F.array_sort(F.collect_list(F.struct("rank", *columns)))
    return nodes.withColumn("place", F.expr(f"rank div {each}L")).groupBy("grp", "total", "place").agg(run.alias("run"))


def table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    names, types = zip(*[c.split() for c in schema.split(", ")], strict=True)
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


NODE = "grp string, rank long, total long, leaf string"
WAY = "grp string, place long, way string"
FINAL = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def roots(runs: DataFrame, fold_digits: int) -> DataFrame:
    """The root of each run, as a node with rank and total of the next stage."""
    each = FANOUT**fold_digits

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(r["grp"], r["place"], -(-r["total"] // each), climb(r["nodes"], min(fold_digits, height(r["total"])))[-1][0]) for r in b.to_pylist()]
            yield table_of(out, NODE)

    return runs.select("grp", "place", "total", F.col("run.leaf").alias("nodes")).mapInArrow(reduce, NODE)


def ways(runs: DataFrame, above: DataFrame, fold_digits: int) -> DataFrame:
    """The way to the root of each node of runs; `above` has that of each run's root (grp, place, way)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                levels = climb(r["nodes"], min(fold_digits, height(r["total"])))
                local = [written_way(list(steps(levels, i))) for i in range(len(r["nodes"]))]
                yield table_of([(r["grp"], r["first"] + i, ",".join(x for x in (w, r["way"]) if x)) for i, w in enumerate(local)], WAY)

    rows = runs.select("grp", "place", "total", F.col("run.leaf").alias("nodes"), F.col("run")[0]["rank"].alias("first")).join(above, ["grp", "place"])
    return rows.mapInArrow(go, WAY)


def proven(fold_digits: int):
    """For mapInArrow: rows of the result for runs of leaves with the way above them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                nodes, above = r["nodes"], read_way(r["way"])
                levels = climb(nodes, min(fold_digits, height(r["total"])))
                out = []
                for i, (doc, leaf, other) in enumerate(zip(r["ids"], nodes, r["changed"], strict=True)):
                    full = [*steps(levels, i), *above]
                    folded = fold(leaf if other is None else other, full)
                    out.append((doc, leaf, r["subroot"], r["root"], proof(full), folded, folded == r["root"]))
                yield table_of(out, FINAL)

    return run


def tree(spark: SparkSession, nodes: DataFrame, columns: list[str], fold_digits: int) -> tuple[list[DataFrame], DataFrame]:
    """Runs of every stage, written, and the groups' roots (grp, leaf), for nodes (grp, rank, total, leaf, columns)."""
    stages, most = [], None
    while True:
        stages.append(materialize(spark, together(nodes, columns, fold_digits), "runs"))
        if most is None:
            most = stages[0].agg(F.max("total")).first()[0] or 0
        nodes, columns = roots(stages[-1], fold_digits), ["leaf"]
        most = -(-most // FANOUT**fold_digits)
        if most <= 1:
            return stages, materialize(spark, nodes.select("grp", "leaf"), "roots")



def manifest(spark: SparkSession, docs: DataFrame, fold_digits: int = FOLD) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs."""
    prepare(spark)
    rows = materialize(spark, leaves(docs), "leaves")
    totals = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("total"))
    nodes = radix.ranked(rows, "doc_id", "content", "number", ["grp"]).join(totals, "grp")
    stages, subroots = tree(spark, nodes, ["doc_id", "leaf", "tampered"], fold_digits)
    # one row a group from here on
    order = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("lang"), "leaf", (F.row_number().over(Window.orderBy("grp")) - 1).cast("long").alias("rank"))
    order = order.crossJoin(F.broadcast(subroots.agg(F.count(F.lit(1)).alias("total"))))
    top_stages, top = tree(spark, order, ["lang", "leaf"], fold_digits)
    root = top.first()
    above = top.select("grp", F.lit(0).cast("long").alias("place"), F.lit("").alias("way"))
    for runs in reversed(top_stages):
        above = ways(runs, above, fold_digits)
    named = top_stages[0].select(F.explode("run").alias("x")).select(F.col("x.rank").alias("place"), F.col("x.lang").alias("lang"))
    above = named.join(above.drop("grp"), "place").select(F.col("lang").alias("grp"), F.lit(0).cast("long").alias("place"), "way")
    for runs in reversed(stages[1:]):
        above = ways(runs, above, fold_digits)
    above = above.join(subroots.withColumnRenamed("leaf", "subroot"), "grp").withColumn("root", F.lit(root["leaf"] if root else None).cast("string"))
    runs = stages[0].select("grp", "place", "total", F.col("run.doc_id").alias("ids"), F.col("run.leaf").alias("nodes"), F.col("run.tampered").alias("changed"))
    discard(spark, rows)
    return runs.join(above, ["grp", "place"]).mapInArrow(proven(fold_digits), FINAL)
