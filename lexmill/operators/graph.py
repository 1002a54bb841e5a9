"""Semantic networks by era: weighted edges, degrees, PageRank, components, betweenness, comparison."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ratio
from lexmill.operators.hubs import hub_betweenness, hub_nodes
from lexmill.storage import discard, once, written


def edge_weights(frames: DataFrame, least: int = 1, by: tuple[str, ...] = ("era",)) -> DataFrame:
    """(era, src, dst, weight, relations): term to head, child to term, modifier to term.

    Relations are counted apart and must reach `least` each before they are summed. A
    child that is a modifier too counts twice.
    """
    at = list(by)
    term = F.col("target_lemma")
    edge = lambda src, dst, rel: F.struct(src.alias("src"), dst.alias("dst"), rel.alias("rel"))
    heads = F.array(edge(term, F.lower("dep_head_lemma"), F.col("dep_relation")))
    kids = F.transform("dep_children", lambda c: edge(F.lower(c["text"]), term, c["dep"]))
    mods = F.transform("modifiers", lambda m: edge(F.lower(m["lemma"]), term, m["dep"]))
    # one pass over the frames: a union of the three would find them three times
    links = F.concat(heads, F.coalesce(kids, F.array()), F.coalesce(mods, F.array()))
    rows = frames.select(*at, F.inline(links)).where("src != '' and dst != '' and src != dst")
    counts = rows.groupBy(*at, "src", "dst", "rel").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.groupBy(*at, "src", "dst").agg(F.sum("n").alias("weight"), F.array_join(F.array_sort(F.collect_set("rel")), "|").alias("relations"))


def degrees(edges: DataFrame, by: tuple[str, ...] = ("era",)) -> DataFrame:
    at = list(by)
    out = edges.select(*at, F.col("src").alias("node"), F.col("weight").alias("o"), F.lit(0).alias("i"))
    into = edges.select(*at, F.col("dst").alias("node"), F.lit(0).alias("o"), F.col("weight").alias("i"))
    return out.unionByName(into).groupBy(*at, "node").agg(
        F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), (F.sum("i") + F.sum("o")).alias("total_degree")
    )


def graph_stats(edges: DataFrame) -> DataFrame:
    """Nodes, edges and directed density by era; density is 0 with one node or none."""
    nodes = degrees(edges).groupBy("era").agg(F.count(F.lit(1)).alias("nodes"))
    out = edges.groupBy("era").agg(F.count(F.lit(1)).alias("edges")).join(nodes, "era")
    return out.withColumn("density", ratio(F.col("edges"), F.col("nodes") * (F.col("nodes") - 1), 0.0))


def pagerank(
    spark: SparkSession, edges: DataFrame, steps: int = 20, damping: float = 0.85, by: tuple[str, ...] = ("era",), every: int = 5, digits: int = 6,
    tolerance: float | None = None,
) -> DataFrame:
    """Weighted PageRank of each graph after a fixed number of steps; nodes without out-edges give to all.

    With a tolerance, steps go on, `steps` at most, until no graph's ranks change by more than it a node on average.

    Edges and nodes are in the shared folder; ranks are written there every few
    steps, so that a lost executor costs a few steps at most.
    """
    at = list(by)
    edges = once(spark, edges, "edges").select(*at, "src", "dst", "weight")
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("out")), F.struct(F.col("dst").alias("node"), F.lit(None).alias("out")))
    base = written(spark, edges.select(*at, F.inline(ends)).groupBy(*at, "node").agg(F.sum(F.when(F.col("node").isNotNull(), F.col("out"))).alias("out")), "nodes")
    size = base.groupBy(*at).agg(F.count(F.lit(1)).alias("size"))
    # a graph's own row is broadcast: a join by graph alone would put all of its nodes into one task
    ranks, held = base.join(F.broadcast(size), at).select(*at, "node", "size", "out", (1.0 / F.col("size")).alias("rank")), None
    for step in range(1, steps + 1):
        lost = ranks.groupBy(*at).agg(F.sum(F.when(F.col("out").isNull(), F.col("rank")).otherwise(0.0)).alias("lost"))
        given = edges.where("dst is not null").join(ranks.select(*at, F.col("node").alias("src"), "rank", "out"), [*at, "src"])
        given = given.select(*at, F.col("dst").alias("node"), (F.col("rank") * F.col("weight") / F.col("out")).alias("got"))
        kept = ranks.select(*at, "node", "size", "out", F.col("rank").alias("_before"))
        # every node has a row of its own, so what it is given meets it in the sum
        new = given.unionByName(kept, allowMissingColumns=True).groupBy(*at, "node")
        new = new.agg(F.sum("got").alias("got"), F.max("size").alias("size"), F.max("out").alias("out"), F.max("_before").alias("_before"))
        rank = (1 - damping) / F.col("size") + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("size"))
        ranks = new.join(F.broadcast(lost), at).select(*at, "node", "size", "out", rank.alias("rank"), "_before")
        if step < steps:  # a step reads the ranks three times, so they are a table at once
            last, held = held, written(spark, ranks, "ranks")
            discard(spark, last)
            ranks = held
            if tolerance is not None and step % every == 0:
                moved = ranks.groupBy(*at).agg((F.sum(F.abs(F.col("rank") - F.col("_before"))) / F.first("size")).alias("moved"))
                if not moved.where(F.col("moved") >= tolerance).limit(1).count():
                    break
    return ranks.select(*at, "node", F.round("rank", digits).alias("pagerank"))


def components(spark: SparkSession, edges: DataFrame, by: tuple[str, ...] = ("era",)) -> DataFrame:
    """(era, node, component): the least node name reachable over edges in either direction.

    Least labels spread along edges and along labels until none changes; each round's
    labels are a table in the shared folder.
    """
    at = list(by)
    pairs = edges.select(*at, F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = written(spark, pairs.unionByName(pairs.select(*at, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = pairs.groupBy(*at, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    table = labels = written(spark, labels, "labels")
    while True:
        near = pairs.join(labels.withColumnRenamed("node", "a"), [*at, "a"]).select(*at, F.col("b").alias("node"), "label", F.lit(None).cast("string").alias("old"))
        ahead = labels.select(*at, F.col("node").alias("label"), F.col("label").alias("_far"))
        far = labels.join(ahead, [*at, "label"]).select(*at, "node", F.col("_far").alias("label"), F.lit(None).cast("string").alias("old"))
        own = labels.select(*at, "node", "label", F.col("label").alias("old"))
        new = own.unionByName(near).unionByName(far).groupBy(*at, "node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        new = written(spark, new, "labels")
        done = new.where("label < old").limit(1).count() == 0
        discard(spark, table)
        table, labels = new, new.drop("old")
        if done:
            discard(spark, pairs)
            return labels.withColumnRenamed("label", "component")


def sources_betweenness(edges: list[tuple[str, str, float]], sources: list[str]) -> dict[str, float]:
    """Dependency of each node on shortest paths from the given sources (Brandes), weights as distances."""
    out = defaultdict(list)
    for a, b, w in edges:
        out[a].append((b, w))
    total: dict[str, float] = defaultdict(float)
    for s in sources:
        dist, paths, before, order = {s: 0.0}, defaultdict(float, {s: 1.0}), defaultdict(list), []
        heap, done = [(0.0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for u, w in out[v]:
                far = d + w
                if u not in dist or far < dist[u]:
                    dist[u] = far
                    paths[u], before[u] = paths[v], [v]
                    heapq.heappush(heap, (far, u))
                elif far == dist[u] and u not in done:
                    paths[u] += paths[v]
                    before[u].append(v)
        share: dict[str, float] = defaultdict(float)
        for v in reversed(order):
            for p in before[v]:
                share[p] += paths[p] / paths[v] * (1 + share[v])
            if v != s:
                total[v] += share[v]
    return total


def betweenness(spark: SparkSession, edges: DataFrame, blocks: int = 16, most_edges: int = 2_000_000, few_edges: int = 2_000) -> DataFrame:
    """(era, node, betweenness), normalised for directed graphs; a frequent relation is a longer way, as weights are distances.

    Graphs of more than few_edges edges that all touch one of a few hubs, as the networks of
    target terms do, are worked out by counts of like nodes, in hubs.hub_betweenness(). Of
    the others a task holds one graph of up to most_edges edges and a block of its sources;
    larger graphs are worked out in tables, by tables_betweenness(). All three are exact.
    """
    whole = edges = once(spark, edges, "edges").select("era", "src", "dst", "weight")
    many = edges.groupBy("era").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few_edges).select("era")
    hubs = written(spark, hub_nodes(edges.where("src != dst").join(F.broadcast(many), "era", "left_semi")), "hubs")
    parts = [hub_betweenness(spark, whole, hubs)] if hubs.limit(1).count() else []
    edges = edges.join(F.broadcast(hubs.select("era").distinct()), "era", "left_anti")
    if not parts or edges.limit(1).count():
        parts += walks_betweenness(spark, edges, blocks, most_edges)
    # every node has a row of its own, so that one sum holds the nodes on no path too
    rows = whole.select("era", F.explode(F.array("src", "dst")).alias("node"), F.lit(0.0).alias("part"))
    for part in parts:
        rows = rows.unionByName(part)
    sums = written(spark, rows.groupBy("era", "node").agg(F.sum("part").alias("s")), "sums")
    size = sums.groupBy("era").agg(F.count(F.lit(1)).alias("n"))
    scaled = ratio(F.col("s"), (F.col("n") - 1) * (F.col("n") - 2), 0.0)
    return sums.join(F.broadcast(size), "era").select("era", "node", F.round(scaled, 9).alias("betweenness"))


def walks_betweenness(spark: SparkSession, edges: DataFrame, blocks: int, most_edges: int) -> list[DataFrame]:
    """Tables of (era, node, part): sums of dependencies by walks from each node, in tasks or, for larger graphs, in tables."""
    sizes = edges.groupBy("era").agg(F.count(F.lit(1)).alias("n"))
    large = [r["era"] for r in sizes.where(F.col("n") > most_edges).select("era").toLocalIterator()]
    small = edges.where(~F.coalesce(F.col("era").isin(large), F.lit(False))) if large else edges
    dealt = small.select("era", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    graphs = small.groupBy("era").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("g"))
    work = dealt.groupBy("era", "block").agg(F.collect_list("node").alias("sources")).join(graphs, "era")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                found = sources_betweenness([(e["src"], e["dst"], float(e["weight"])) for e in r.g], list(r.sources))
                rows += [(r.era, n, v) for n, v in found.items()]
            yield pd.DataFrame(rows, columns=["era", "node", "part"])

    parts = [work.select("era", "sources", "g").mapInPandas(run, "era string, node string, part double")]
    return parts + [tables_betweenness(spark, edges.where(F.col("era") == era)) for era in large]


def tables_betweenness(spark: SparkSession, edges: DataFrame, pairs_each: int = 1_000_000_000) -> DataFrame:
    """(era, node, part): the sum of dependencies on each node, with all state in tables, for graphs that no task can hold.

    Sources are taken in blocks of about pairs_each pairs of source and node. Distances
    spread until none shrinks; numbers of shortest paths and dependencies are series over
    the number of steps, which end with the longest shortest path.
    """
    edges = edges.where(F.col("src") != F.col("dst"))
    nodes = edges.select("era", F.explode(F.array("src", "dst")).alias("s")).distinct()
    n = nodes.count()
    blocks = max(1, -(-n * n // pairs_each))
    total = None
    for block in range(blocks):
        start = nodes.where(F.pmod(F.xxhash64("s"), F.lit(blocks)) == block).select("era", "s", F.col("s").alias("v"))
        known = written(spark, start.withColumn("d", F.lit(0).cast("long")), "distances")
        front = known
        while front.limit(1).count():
            step = front.join(edges.withColumnRenamed("src", "v"), ["era", "v"]).select("era", "s", F.col("dst").alias("v"), (F.col("d") + F.col("weight")).alias("d"))
            both = known.withColumn("old", F.col("d")).unionByName(step.withColumn("old", F.lit(None).cast("long")))
            new = written(spark, both.groupBy("era", "s", "v").agg(F.min("d").alias("d"), F.min("old").alias("old")), "distances")
            known = new.select("era", "s", "v", "d")
            front = new.where("old is null or d < old").select("era", "s", "v", "d")
        ahead = known.select("era", "s", F.col("v").alias("u"), F.col("d").alias("_far"))
        tight = known.join(edges.select("era", F.col("src").alias("v"), F.col("dst").alias("u"), "weight"), ["era", "v"]).join(ahead, ["era", "s", "u"])
        tight = written(spark, tight.where("_far = d + weight").select("era", "s", "v", "u"), "steps")

        def series(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
            """(era, s, v, x): the sum of the terms that `step` makes until there are none."""
            terms = term = written(spark, first, "term")
            while term.limit(1).count():
                term = written(spark, step(term), "term")
                terms = terms.unionByName(term)
            return written(spark, terms.groupBy("era", "s", "v").agg(F.sum("x").alias("x")), "series")

        paths = series(
            start.withColumn("x", F.lit(1.0)), lambda t: t.join(tight, ["era", "s", "v"]).groupBy("era", "s", F.col("u").alias("v")).agg(F.sum("x").alias("x"))
        )
        to = paths.select("era", "s", F.col("v").alias("u"), F.col("x").alias("_to"))
        shares = tight.join(paths, ["era", "s", "v"]).join(to, ["era", "s", "u"]).select("era", "s", "v", "u", (F.col("x") / F.col("_to")).alias("share"))
        shares = written(spark, shares, "shares")
        back = lambda t: shares.join(t.select("era", "s", F.col("v").alias("u"), "x"), ["era", "s", "u"])  # noqa: B023, E731
        each = series(
            shares.groupBy("era", "s", "v").agg(F.sum("share").alias("x")),
            lambda t: back(t).groupBy("era", "s", "v").agg(F.sum(F.col("share") * F.col("x")).alias("x")),
        )
        part = each.where("s != v").groupBy("era", F.col("v").alias("node")).agg(F.sum("x").alias("part"))
        total = part if total is None else total.unionByName(part)
    return total.groupBy("era", "node").agg(F.sum("part").alias("part"))


def emerging_edges(edges: DataFrame, order: list[str], once: bool = False) -> DataFrame:
    """Edges of later eras that the first one lacks: once for each era, or with `once` for the first era that has them.

    order: eras by name gives what alphabetical comparison gives; by time, the chronological one.
    """
    first = edges.where(F.col("era") == order[0]).select("src", "dst")
    later = edges.where(F.col("era").isin(*order[1:])).select("era", "src", "dst", "weight").join(first, ["src", "dst"], "left_anti")
    if not once:
        return later
    place = F.create_map(*[F.lit(x) for i, e in enumerate(order) for x in (e, i)])[F.col("era")]
    seen = Window.partitionBy("src", "dst").orderBy(place)
    return later.withColumn("_r", F.row_number().over(seen)).where("_r = 1").drop("_r")


def centrality_fill(values: DataFrame, eras: list[str], value: str) -> DataFrame:
    """Every node of any era by every era, 0 where it is absent."""
    grid = values.select("node").distinct().select("node", F.explode(F.array(*[F.lit(e) for e in eras])).alias("era"))
    return grid.join(values.select("era", "node", value), ["era", "node"], "left").na.fill(0, [value])


def bridges(edges: DataFrame, scores: DataFrame, top: int = 15, score: str = "total_degree") -> DataFrame:
    """For two unconnected top nodes of an era, the neighbour of both (itself no top node) of the best score.

    Only pairs of the top nodes are formed, so a graph gives at most top * top / 2 of them.
    """
    rank = Window.partitionBy("era").orderBy(F.col(score).desc(), "node")
    tops = scores.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).select("era", "node")
    both = edges.select("era", F.col("src").alias("x"), F.col("dst").alias("y"))
    both = both.unionByName(both.select("era", F.col("y").alias("x"), F.col("x").alias("y"))).distinct()
    near = both.join(tops.withColumnRenamed("node", "x"), ["era", "x"])
    near = near.join(tops.withColumnRenamed("node", "y"), ["era", "y"], "left_anti")
    left, right = near.select("era", F.col("x").alias("a"), "y"), near.select("era", F.col("x").alias("b"), "y")
    pairs = left.join(right, ["era", "y"]).where("a < b")
    pairs = pairs.join(both.select("era", F.col("x").alias("a"), F.col("y").alias("b")), ["era", "a", "b"], "left_anti")
    ranked = pairs.join(scores.select("era", F.col("node").alias("y"), F.col(score).alias("score")), ["era", "y"])
    best = Window.partitionBy("era", "a", "b").orderBy(F.col("score").desc(), "y")
    return ranked.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("era", "a", "b", F.col("y").alias("bridge"), "score")


def named_nodes(scores: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Nodes that are words: no empty or symbol-only names, no function words (stopwords: lemma)."""
    words = scores.where(~F.col("node").rlike("(?U)\\A\\W*\\z"))
    return words.join(stopwords.select(F.col("lemma").alias("node")), "node", "left_anti")


def plot_network(edges: DataFrame, scores: DataFrame, stopwords: DataFrame, top: int = 15, score: str = "total_degree") -> DataFrame:
    """Edges among each era's top nodes, and the bridge edges that join two of them through a shared neighbour."""
    kept = named_nodes(scores, stopwords)
    rank = Window.partitionBy("era").orderBy(F.col(score).desc(), "node")
    tops = kept.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") <= top).select("era", "node")
    both = lambda e: e.join(tops.withColumnRenamed("node", "src"), ["era", "src"], "left_semi").join(tops.withColumnRenamed("node", "dst"), ["era", "dst"], "left_semi")
    plain = both(edges).select("era", "src", "dst", "weight", F.lit("relation").alias("kind"))
    crossing = bridges(edges, kept, top, score)
    left = crossing.select("era", F.col("a").alias("src"), F.col("bridge").alias("dst"))
    right = crossing.select("era", F.col("b").alias("src"), F.col("bridge").alias("dst"))
    links = left.unionByName(right).distinct().withColumns({"weight": F.lit(0).cast("long"), "kind": F.lit("bridge")})
    return plain.unionByName(links)


def virtual_edges(parts: DataFrame, scores: DataFrame, score: str = "total_degree") -> DataFrame:
    """For each era an edge from the hub of its largest component to the hub of every other one."""
    rows = parts.join(scores.select("era", "node", score), ["era", "node"])
    hub = F.max(F.struct(F.col(score).alias("s"), "node"))
    groups = rows.groupBy("era", "component").agg(F.count(F.lit(1)).alias("size"), hub.alias("h"))
    order = Window.partitionBy("era").orderBy(F.col("size").desc(), "component")
    groups = groups.withColumns({"_r": F.row_number().over(order), "main": F.first("h.node").over(order)})
    return groups.where("_r > 1").select("era", F.col("main").alias("src"), F.col("h.node").alias("dst"), F.lit("virtual").alias("kind"))


def growth(edges: DataFrame, ranks: DataFrame, between: DataFrame) -> DataFrame:
    """Per era: nodes, edges, density, highest PageRank and its node, mean betweenness, and how far the hub stands out."""
    pr = ranks.groupBy("era").agg(F.max("pagerank").alias("top_pagerank"), F.max_by("node", "pagerank").alias("top_node"), F.avg("pagerank").alias("_mean"))
    bt = between.groupBy("era").agg(F.round(F.avg("betweenness"), 9).alias("mean_betweenness"))
    out = graph_stats(edges).join(pr, "era").join(bt, "era")
    return out.withColumn("hub_dominance", ratio(F.col("top_pagerank"), F.col("_mean"), 0.0)).drop("_mean")


def centrality_table(edges: DataFrame, ranks: DataFrame) -> DataFrame:
    """Degrees and PageRank of every node, with its place by PageRank in its era, ties by name."""
    place = Window.partitionBy("era").orderBy(F.col("pagerank").desc(), "node")
    return degrees(edges).join(ranks, ["era", "node"]).withColumn("place", F.row_number().over(place))


def era_centrality_shift(values: DataFrame, order: list[str], value: str) -> DataFrame:
    """Each node's value by era, zero filled, with the change from the era before."""
    filled = centrality_fill(values, order, value)
    place = F.create_map(*[F.lit(x) for i, e in enumerate(order) for x in (e, i)])[F.col("era")]
    before = F.lag(value).over(Window.partitionBy("node").orderBy(place))
    return filled.withColumn("shift", F.col(value) - F.coalesce(before, F.lit(0)))
