"""Betweenness of graphs whose edges all touch one of a few hubs, as networks around target terms are.

Every path of such a graph has a hub, so a shortest path from s to t is an edge from s to
its first hub, a shortest path between hubs, and an edge from its last hub to t (hubs are
their own first or last hub). What a node is as a source is therefore its list of edges to
hubs, less those that a way over other hubs beats, by their differences; nodes of one such
profile are counted, not walked. Work is one join of the edges with the hubs and one of the
profiles with each other, not a walk from each node; the result is exact.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.storage import written

#: Hubs of a graph at most.
MOST = 64


def hub_nodes(edges: DataFrame, most: int = MOST) -> DataFrame:
    """(era, node): hubs that touch all edges, for eras that have `most` such or fewer; no parallel edges, weights over 0."""
    ends = edges.select("era", F.explode(F.array("src", "dst")).alias("node")).groupBy("era", "node").count()
    place = Window.partitionBy("era").orderBy(F.col("count").desc(), "node")
    spark = edges.sparkSession
    top = written(spark, ends.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).select("era", "node"), "top")
    # one pass over the edges: weight is null where an edge is parallel to another or has no weight over 0
    pairs = edges.groupBy("era", "src", "dst").agg(F.when((F.count(F.lit(1)) == 1) & (F.max("weight") > 0), F.lit(1)).alias("weight"))
    tag = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"))
    src, dst, none = F.col("src"), F.col("dst"), F.lit(None).cast("string")
    odd = tag("odd", none, none)
    outer = tag("outer", F.when(F.col("sh"), src).otherwise(dst), none)
    seen = marked(pairs, top).select("era", F.when(F.expr("weight is null or not (sh or dh)"), odd).when(F.expr("sh and dh"), tag("inner", src, dst)).otherwise(outer).alias("t"))
    seen = written(spark, seen.select("era", "t.*").distinct(), "touched")
    # of the top nodes those with a neighbour that is none, and the ends of edges that these don't touch
    odd = seen.where("kind = 'odd'").select("era").distinct()
    outer = seen.where("kind = 'outer'").select("era", F.col("a").alias("node"))
    inner = seen.where("kind = 'inner'").select("era", "a", "b")
    for end in ("a", "b"):
        inner = inner.join(F.broadcast(outer.withColumnRenamed("node", end)), ["era", end], "left_anti")
    inner = inner.select("era", F.explode(F.array("a", "b")).alias("node"))
    return outer.unionByName(inner).distinct().join(F.broadcast(odd), "era", "left_anti")


def marked(edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """edges with sh, dh: whether source and target are hubs."""
    of = lambda end, name: F.broadcast(hubs.select("era", F.col("node").alias(end), F.lit(True).alias(name)))
    rows = edges.select("era", "src", "dst", "weight").join(of("src", "sh"), ["era", "src"], "left").join(of("dst", "dh"), ["era", "dst"], "left")
    return rows.select("era", "src", "dst", "weight", F.coalesce("sh", F.lit(False)).alias("sh"), F.coalesce("dh", F.lit(False)).alias("dh"))


def hub_paths(arcs: pd.DataFrame) -> pd.DataFrame:
    """Distances and numbers of shortest paths between different hubs of one era, from arcs g, k, w, c (c ways of length w)."""
    out = defaultdict(list)
    for g, k, w, c in zip(arcs["g"], arcs["k"], arcs["w"], arcs["c"], strict=True):
        out[g].append((k, w, c))
    rows = []
    for s in list(out):
        dist, paths, heap, done = {s: 0.0}, defaultdict(float, {s: 1.0}), [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            for u, w, c in out.get(v, ()):
                if u not in dist or d + w < dist[u]:
                    dist[u], paths[u] = d + w, paths[v] * c
                    heapq.heappush(heap, (d + w, u))
                elif d + w == dist[u]:
                    paths[u] += paths[v] * c
        rows += [(arcs["era"].iloc[0], s, v, dist[v], paths[v]) for v in dist if v != s]
    return pd.DataFrame(rows, columns=["era", "h", "k", "d", "n"])


def profiles(likes: DataFrame, ways: DataFrame) -> DataFrame:
    """(era, id, n, a, b): of the links o and i of likes (era, id, n, o, i), as sources (a) and targets (b), those that no
    way (era, h, k, d) over another link's hub beats, by hub, less the least w; null where there are no links."""
    links = [likes.select("era", "id", "n", F.lit(side).alias("side"), F.inline(name)) for side, name in (("a", "o"), ("b", "i"))]
    both = ways.select("era", F.lit("a").alias("side"), "h", "k", "d").unionByName(ways.select("era", F.lit("b").alias("side"), F.col("k").alias("h"), F.col("h").alias("k"), "d"))
    far = links[0].unionByName(links[1]).join(F.broadcast(both), ["era", "side", "h"])
    # a hub's own way to itself has length 0, so the link is among what it is compared with
    best = far.groupBy("era", "id", "n", "side", F.col("k").alias("h")).agg(F.min(F.col("w") + F.col("d")).alias("m"), F.max(F.when(F.col("h") == F.col("k"), F.col("w"))).alias("w"))
    kept = best.where("w <= m").groupBy("era", "id", "n")
    kept = kept.agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("h", "w")))).alias(side) for side in "ab"])
    least = lambda side: F.array_min(F.transform(side, lambda x: x["w"]))
    less = lambda side: F.transform(side, lambda x: F.struct(x["h"].alias("h"), (x["w"] - least(side)).alias("w")))
    return kept.select("era", "id", "n", *[F.when(F.size(side) > 0, less(side)).alias(side) for side in "ab"])


def hub_betweenness(spark: SparkSession, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """(era, node, part): the sum of dependencies on each node; hubs from hub_nodes(), eras without hubs are left out."""
    edges = marked(edges.where("src != dst").join(F.broadcast(hubs.select("era").distinct()), "era"), hubs)
    edges = edges.withColumn("weight", F.col("weight").cast("double"))
    # each node's edges to hubs (o) and from hubs (i), and how many nodes are alike in both; all steps but the last are on likes
    sh, src, dst = F.col("sh"), F.col("src"), F.col("dst")
    x = F.struct(F.when(sh, src).otherwise(dst).alias("h"), F.col("weight").alias("w"))
    links = edges.where("sh != dh").select("era", F.when(sh, dst).otherwise(src).alias("node"), "sh", x.alias("x"))
    lists = [F.array_sort(F.collect_list(F.when(at, F.col("x")))).alias(name) for at, name in ((~sh, "o"), (sh, "i"))]
    members = written(spark, links.groupBy("era", "node").agg(*lists), "members")
    likes = members.groupBy("era", "o", "i").agg(F.count(F.lit(1)).alias("n"))
    likes = written(spark, likes.withColumn("id", F.monotonically_increasing_id()), "likes")
    pairs = lambda rows: rows.select("*", F.explode("i").alias("_i")).select("*", F.explode("o").alias("_o")).where("_i.h != _o.h")
    via = lambda rows, x: pairs(rows).select("era", x, F.col("_i.h").alias("g"), F.col("_o.h").alias("k"), F.expr("_i.w + _o.w").alias("w"))
    direct = edges.where("sh and dh").select("era", F.col("src").alias("g"), F.col("dst").alias("k"), F.col("weight").alias("w"), F.lit(1).cast("long").alias("n"))
    arcs = via(likes, "n").unionByName(direct).groupBy("era", "g", "k", "w").agg(F.sum("n").cast("double").alias("c"))
    arcs = arcs.groupBy("era", "g", "k").agg(F.min(F.struct("w", "c")).alias("m")).select("era", "g", "k", "m.w", "m.c")
    arcs = written(spark, arcs, "arcs")
    paths = arcs.groupBy("era").applyInPandas(hub_paths, "era string, h string, k string, d double, n double")
    own = hubs.select("era", F.col("node").alias("h"), F.col("node").alias("k"), F.lit(0.0).alias("d"), F.lit(1.0).alias("n"))
    paths = written(spark, paths.unionByName(own), "ways")

    # profiles as sources (a) and as targets (b); a hub is its own
    itself = F.array(F.struct(F.col("node").alias("h"), F.lit(0.0).alias("w")))
    nodes = profiles(likes, paths).select("era", "a", "b", "n", F.lit(False).alias("hub"))
    nodes = nodes.unionByName(hubs.select("era", itself.alias("a"), itself.alias("b"), F.lit(1).cast("long").alias("n"), F.lit(True).alias("hub")))
    kinds = written(spark, nodes.groupBy("era", "hub", "a", "b").agg(F.sum("n").alias("n")), "kinds")
    side = lambda x: kinds.where(F.col(x).isNotNull()).groupBy("era", F.col("hub").alias(f"{x}h"), x).agg(F.sum("n").alias(f"{x}n"))
    source = side("a").select("*", F.explode("a").alias("f")).select("era", "ah", "a", "an", F.col("f.h").alias("h"), F.col("f.w").alias("aw"))
    target = side("b").select("*", F.explode("b").alias("f")).select("era", "bh", "b", "bn", F.col("f.h").alias("k"), F.col("f.w").alias("bw"))
    ways = source.join(F.broadcast(paths), ["era", "h"]).join(target, ["era", "k"])
    ways = ways.withColumn("x", F.struct((F.col("aw") + F.col("d") + F.col("bw")).alias("far"), "h", "k", "d", "n"))
    ways = ways.groupBy("era", "ah", "a", "an", "bh", "b", "bn").agg(F.collect_list("x").alias("x"))
    # a node is no pair with itself
    same = kinds.where("a is not null and b is not null").select("era", F.col("hub").alias("ah"), "a", F.col("hub").alias("bh"), "b", F.col("n").alias("own"))
    ways = ways.join(same, ["era", "ah", "a", "bh", "b"], "left").withColumn("pairs", F.col("an") * F.col("bn") - F.coalesce("own", F.lit(0)))
    ways = ways.withColumn("least", F.array_min(F.transform("x", lambda x: x["far"]))).withColumn("x", F.expr("filter(x, y -> y.far = least)"))
    ways = ways.withColumn("share", F.col("pairs") / F.aggregate("x", F.lit(0.0), lambda t, x: t + x["n"]))
    ways = ways.select("era", "ah", "bh", "share", F.explode("x").alias("x"))
    sums = lambda where: F.sum(F.when(where, F.col("share")).otherwise(0.0))
    flow = ways.groupBy("era", "x.h", "x.k", "x.d", "x.n").agg(
        F.sum("share").alias("all"), sums(~F.col("ah")).alias("left"), sums(~F.col("bh")).alias("right"), sums(~F.col("ah") & ~F.col("bh")).alias("both")
    )
    flow = written(spark, flow, "flow")

    # hubs that begin or end the way between hubs, unless they are the path's own ends; hubs and other nodes inside it
    first = flow.where("h != k").select("era", F.col("h").alias("node"), (F.col("left") * F.col("n")).alias("part"))
    last = flow.where("h != k").select("era", F.col("k").alias("node"), (F.col("right") * F.col("n")).alias("part"))
    only = flow.where("h = k").select("era", F.col("h").alias("node"), F.col("both").alias("part"))
    head = paths.select("era", "h", F.col("k").alias("g"), F.col("d").alias("d1"), F.col("n").alias("n1"))
    tail = paths.select("era", F.col("h").alias("j"), "k", F.col("d").alias("d2"), F.col("n").alias("n2"))
    lead = flow.join(head, ["era", "h"])
    middle = lead.where("g != h and g != k").join(tail.withColumnRenamed("j", "g"), ["era", "g", "k"]).where("d1 + d2 = d")
    middle = middle.select("era", F.col("g").alias("node"), (F.col("all") * F.col("n1") * F.col("n2")).alias("part"))
    used = lead.join(arcs.withColumnRenamed("k", "j"), ["era", "g"]).join(tail, ["era", "j", "k"]).where("d1 + w + d2 = d")
    used = used.groupBy("era", "g", F.col("j").alias("k"), "w").agg(F.sum(F.col("all") * F.col("n1") * F.col("n2")).alias("part"))
    inside = via(members, "node").join(F.broadcast(used), ["era", "g", "k", "w"]).select("era", "node", "part")
    return first.unionByName(last).unionByName(only).unionByName(middle).unionByName(inside).groupBy("era", "node").agg(F.sum("part").alias("part"))
