"""A low-dimensional layout that keeps neighbourhoods: a fuzzy neighbour graph and its forces.

Every point's distances to its nearest neighbours become memberships that fall off from
1 at the nearest one, at a rate that makes their sum log2(k); a pair belongs together if
either point holds the other near. From the principal components on, linked points
attract each other by their membership, and all points are pushed away from a sample of
others (another one each epoch, chosen by a seeded hash of their ids). Positions are one
narrow table, written each epoch; what reaches the driver is the sample, of NEGATIVES
points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators.neighbours import neighbours, points
from lexmill.operators.topics import projection
from lexmill.storage import discard, written

#: Shape of the curve 1 / (1 + A * d ** (2 * B)) that says how near points of the layout belong together, for points that may touch.
A, B = 1.93, 0.79
#: Points that push, epochs' greatest move of a point along an axis, and pushes for each unit of attraction.
NEGATIVES, REACH, PUSHES = 128, 4.0, 5


def memberships(near: DataFrame, steps: int = 48) -> DataFrame:
    """(a, b, w), a < b: how much two points belong together, 0 to 1. near: (a, b, d) of nearest neighbours, k rows a point."""
    around = near.groupBy("a").agg(F.collect_list(F.struct("b", "d")).alias("n"))
    around = around.withColumns({"first": F.array_min(F.transform("n", lambda x: x["d"])), "want": F.log2(F.greatest(F.lit(2), F.size("n")))})
    fall = lambda d, s: F.exp(-F.greatest(F.lit(0.0), d - F.col("first")) / s)
    total = lambda s: F.aggregate(F.transform("n", lambda x: fall(x["d"], s)), F.lit(0.0), lambda t, x: t + x)
    # the rate by halving, between bounds of any scale of distances
    scale = F.greatest(F.array_max(F.transform("n", lambda x: x["d"])), F.lit(1e-12))
    bounds = F.struct((scale * 1e-6).alias("lo"), (scale * 1e3).alias("hi"))

    def halve(r: Column, _: Column) -> Column:
        middle = F.sqrt(r["lo"] * r["hi"])
        return F.when(total(middle) > F.col("want"), F.struct(r["lo"].alias("lo"), middle.alias("hi"))).otherwise(F.struct(middle.alias("lo"), r["hi"].alias("hi")))

    around = around.withColumn("rate", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), bounds, halve, lambda r: r["lo"]))
    one = around.select("a", F.explode("n").alias("x"), "first", "rate").select("a", F.col("x.b").alias("b"), fall(F.col("x.d"), F.col("rate")).alias("w"))
    pairs = one.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # p + q - pq, where only one point may hold the other near
    return pairs.agg((1 - F.product(1 - F.col("w"))).alias("w"))


def layout(
    spark: SparkSession, vectors: DataFrame, size: int = 2, k: int = 15, epochs: int = 30, seed: int = 42, key: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(key, x0, x1, ...): equal vectors have one place; vectors that can't be read have nulls."""
    pts = points(spark, vectors, vector)
    edges = written(spark, memberships(neighbours(spark, pts, k)), "memberships")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    both = written(spark, both, "links")
    weight = both.groupBy("a").agg(F.sum("w").alias("weight"))
    axes = [f"x{i}" for i in range(size)]
    dims = pts.agg(F.max(F.size("v"))).first()[0] or 0
    if not dims:
        return vectors.select(key, *[F.lit(None).cast("double").alias(x) for x in axes])
    start = projection(pts.select(F.col("point").alias("vec_id"), F.col("v").alias("embedding")), min(size, dims))
    start = start.select(F.col("vec_id").alias("point"), *[f"x{i}" if i < dims else F.lit(0.0).alias(f"x{i}") for i in range(size)])
    spread = start.agg(*[F.max(F.abs(x)) for x in axes]).first()
    scale = 10 / max(1e-12, *spread)
    # a little noise by id, so that points of one place can part
    noise = lambda i: (F.pmod(F.xxhash64("point", F.lit(seed + i)), F.lit(1 << 20)) / (1 << 20) - 0.5) * 1e-2
    here = start.join(weight.withColumnRenamed("a", "point"), "point", "left").na.fill(0.0, ["weight"])
    here = written(spark, here.select("point", "weight", *[(F.col(x) * scale + noise(i)).alias(x) for i, x in enumerate(axes)]), "places")
    square = lambda gaps: sum((g * g for g in gaps), F.lit(0.0))
    held = lambda c: F.greatest(F.lit(-REACH), F.least(F.lit(REACH), c))
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        far = here.select("point", *axes).orderBy(F.xxhash64("point", F.lit(seed + 1000 + epoch)), "point").limit(NEGATIVES).collect()
        ahead = here.select(F.col("point").alias("b"), *[F.col(x).alias(f"_{x}") for x in axes])
        linked = both.join(here.select(F.col("point").alias("a"), *axes), "a").join(ahead, "b")
        gaps = [F.col(x) - F.col(f"_{x}") for x in axes]
        d2 = square(gaps)
        pull = F.when(d2 > 0, -2 * A * B * F.pow(d2, B - 1) / (1 + A * F.pow(d2, B))).otherwise(0.0)
        drawn = linked.groupBy(F.col("a").alias("point")).agg(*[F.sum(F.col("w") * held(pull * g)).alias(f"_{x}") for x, g in zip(axes, gaps, strict=True)])
        # in a table of one row, not as literals, so that every epoch has the same plan and code
        step = spark.createDataFrame([(float(rate), [(r["point"], *[float(r[x]) for x in axes]) for r in far])], f"rate double, others array<struct<point:long,{','.join(f'{x}:double' for x in axes)}>>")

        def pushed(o: Column) -> Column:
            gaps = [F.col(x) - o[x] for x in axes]
            d2 = square(gaps)
            push = F.when(o["point"] == F.col("point"), 0.0).otherwise(2 * B / ((0.001 + d2) * (1 + A * F.pow(d2, B))))
            return F.struct(*[held(push * g).alias(x) for x, g in zip(axes, gaps, strict=True)])

        zero = F.struct(*[F.lit(0.0).alias(x) for x in axes])
        away = F.aggregate(F.transform("others", pushed), zero, lambda s, p: F.struct(*[(s[x] + p[x]).alias(x) for x in axes]))  # noqa: B023
        moved = here.join(drawn, "point", "left").crossJoin(F.broadcast(step)).withColumn("_away", away)
        # moves are means over a point's links, so that points of many links don't overshoot
        move = lambda x: F.col("rate") * held(F.coalesce(F.col(f"_{x}"), F.lit(0.0)) / F.greatest("weight", F.lit(1.0)) + PUSHES * F.col("_away")[x] / F.size("others"))  # noqa: B023, E731
        last, here = here, written(spark, moved.select("point", "weight", *[(F.col(x) + move(x)).alias(x) for x in axes]), "places")
        discard(spark, last)
    discard(spark, edges, both)
    rows = vectors.select(key, F.col(vector).cast("array<double>").alias("_v"))
    return rows.join(pts.join(here, "point").select(F.col("v").alias("_v"), *axes), "_v", "left").select(key, *axes)
