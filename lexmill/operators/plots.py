"""Tables behind figures; the drawing is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ratio


def topic_heatmap(frequency: DataFrame, words: DataFrame) -> DataFrame:
    """Topic by year frequencies with each topic's first two words (`Topic n` without any)."""
    first = words.where("rank <= 2").groupBy("topic_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("label"))
    out = frequency.join(first, "topic_id", "left")
    return out.withColumn("label", F.coalesce("label", F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))))


def streamgraph(counts: DataFrame, years: list[int], topoi: list[str]) -> DataFrame:
    """Proportion of each topos in each year, 0 where it is absent, with the baseline that centres a year's stack."""
    grid = counts.select("doc_year").distinct().where(F.col("doc_year").isin(*years)).select("doc_year", F.explode(F.array(*[F.lit(t) for t in topoi])).alias("topos"))
    rows = grid.join(counts.select("doc_year", "topos", "proportion"), ["doc_year", "topos"], "left").na.fill(0.0, ["proportion"])
    order = Window.partitionBy("doc_year").orderBy("topos").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("proportion").over(order), F.lit(0.0))
    total = F.sum("proportion").over(Window.partitionBy("doc_year"))
    return rows.withColumn("base", F.round(below - total / 2, 9))


def smooth_streamgraph(proportions: DataFrame, totals: DataFrame, points: int = 400, digits: int = 9) -> DataFrame:
    """(step, topos, place, height, base): smooth layers over `points` steps from the first year to the last, years evenly spaced.

    proportions: doc_year, topos, proportion, a row for each pair. totals: topos, n; layers
    are stacked by n, the largest first, ties by name. Heights are monotone cubic between
    years (straight with fewer than four of them), so they don't overshoot; the lowest
    line weighs every layer by its place, which keeps large layers level, and is centred.
    """
    at = Window.partitionBy("topos").orderBy("doc_year")
    ahead = F.lead("proportion").over(at) - F.col("proportion")
    rows = proportions.withColumns({"k": F.row_number().over(at) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy("topos")), "right": ahead})
    rows = rows.withColumn("left", F.lag("right").over(at))
    rows = rows.withColumns({"right2": F.lead("right").over(at), "left2": F.lag("left").over(at)})

    def end(near: Column, next_: Column) -> Column:
        slope = (3 * near - next_) / 2
        return F.when(F.signum(slope) != F.signum(near), 0.0).when((F.signum(near) != F.signum(next_)) & (F.abs(slope) > 3 * F.abs(near)), 3 * near).otherwise(slope)

    left, right = F.col("left"), F.col("right")
    slope = (
        F.when(left.isNull() & right.isNull(), 0.0)
        .when(left.isNull(), F.when(F.col("right2").isNull(), right).otherwise(end(right, F.col("right2"))))
        .when(right.isNull(), F.when(F.col("left2").isNull(), left).otherwise(end(left, F.col("left2"))))
        .when(left * right <= 0, 0.0)
        .otherwise(2 * left * right / (left + right))
    )
    rows = rows.withColumn("slope", slope)
    rows = rows.withColumns({"y1": F.lead("proportion").over(at), "slope1": F.lead("slope").over(at)})
    # every step lies after one year: the last step in the last interval
    rows = rows.where("k < n - 1 or n = 1")
    last = F.greatest(F.col("n") - 1, F.lit(1))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    rows = rows.withColumn("step", step).withColumn("x", F.col("step") * last / (points - 1))
    rows = rows.where(F.least(F.floor("x"), F.greatest(F.col("n") - 2, F.lit(0))) == F.col("k")).withColumn("t", F.col("x") - F.col("k"))
    t, y0, y1 = F.col("t"), F.col("proportion"), F.col("y1")
    cubic = (
        (2 * t * t * t - 3 * t * t + 1) * y0 + (t * t * t - 2 * t * t + t) * F.col("slope") + (3 * t * t - 2 * t * t * t) * y1 + (t * t * t - t * t) * F.col("slope1")
    )
    height = F.when(F.col("n") == 1, y0).when(F.col("n") < 4, y0 + t * (y1 - y0)).otherwise(F.greatest(F.lit(0.0), cubic))
    layers = rows.select("step", "topos", height.alias("height"))
    order = totals.select("topos", F.row_number().over(Window.orderBy(F.col("n").desc(), "topos")).alias("place"))  # one row a topos
    layers = layers.join(order, "topos")
    count = F.max("place").over(Window.partitionBy("step"))
    whole, below = Window.partitionBy("step"), Window.partitionBy("step").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    layers = layers.withColumn("_n", count)
    layers = layers.withColumn("low", -F.sum((F.col("_n") - F.col("place") + 1) * F.col("height")).over(whole) / F.col("_n"))
    layers = layers.withColumns({"total": F.sum("height").over(whole), "under": F.coalesce(F.sum("height").over(below), F.lit(0.0))})
    # the mean of the middle line goes to zero; moving all by the lowest point first would change nothing
    middle = layers.groupBy("step").agg(F.first("low").alias("low"), F.first("total").alias("total"))
    middle = middle.agg(F.avg(F.col("low") + F.col("total") / 2).alias("mean"))
    out = layers.join(F.broadcast(middle))  # one row
    return out.select("step", "topos", "place", F.round("height", digits).alias("height"), F.round(F.col("low") - F.col("mean") + F.col("under"), digits).alias("base"))


def diverging(targets: DataFrame) -> DataFrame:
    """English and minority counts of each strategy, the English ones negative, with their ratio."""
    eng = F.coalesce(F.sum(F.when(F.col("language") == "English", F.col("n"))), F.lit(0))
    rest = F.coalesce(F.sum(F.when(F.col("language").isin("Gaelic", "Scots"), F.col("n"))), F.lit(0))
    out = targets.groupBy("strategy").agg((-eng).alias("english"), rest.alias("minority"))
    return out.withColumn("ratio", ratio(F.col("minority"), -F.col("english"), float("inf")))


def spaced_labels(centroids: DataFrame, dx: float = 0.8, dy: float = 0.5) -> DataFrame:
    """Centroids with whether their label is drawn: not within (dx, dy) of one drawn before, larger groups first.

    A figure's centroids are few; the greedy choice is one fold over their array.
    """
    names = [c for c in centroids.columns if c not in ("x", "y", "n")]
    row = F.struct((-F.col("n")).alias("o"), *names, "x", "y", "n")
    all_of = centroids.agg(F.array_sort(F.collect_list(row)).alias("a"))
    fold = (
        "aggregate(a, cast(array() as array<struct<x:double,y:double>>), (kept, p) -> "
        f"if(exists(kept, k -> abs(k.x - p.x) < {dx} and abs(k.y - p.y) < {dy}), kept, concat(kept, array(struct(double(p.x) as x, double(p.y) as y)))))"
    )
    drawn = all_of.select("a", F.expr(fold).alias("kept")).select(F.explode("a").alias("p"), "kept")
    shown = F.exists("kept", lambda k: (k["x"] == F.col("p.x")) & (k["y"] == F.col("p.y")))
    return drawn.select(*[F.col(f"p.{c}").alias(c) for c in (*names, "x", "y", "n")], shown.alias("label"))
