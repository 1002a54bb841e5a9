"""Topics: frequencies and trajectories, class-based TF-IDF, clustering, centroids, plot tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions.text import let, ratio, words
from lexmill.operators.graph import components
from lexmill.storage import written


def topic_frequency(assigned: DataFrame) -> DataFrame:
    """Chunks by year and topic without outliers (topic -1)."""
    return assigned.where("topic_id != -1").groupBy("doc_year", "topic_id").agg(F.count(F.lit(1)).alias("frequency"))


def trajectories(frequency: DataFrame, emerging_from: int = 1992, persistent: int = 3, last_by: int = 1998, first_by: int = 1872) -> DataFrame:
    """First, last and peak year of each topic (the earliest peak on ties) and its course."""
    out = frequency.groupBy("topic_id").agg(
        F.min("doc_year").alias("first_year"),
        F.max("doc_year").alias("last_year"),
        F.count_distinct("doc_year").alias("n_periods"),
        F.sum("frequency").alias("total"),
        F.max(F.struct("frequency", (-F.col("doc_year")).alias("y"))).alias("_p"),
    )
    return out.withColumns(
        {
            "peak_year": -F.col("_p.y"),
            "emerging": F.col("first_year") >= emerging_from,
            "persistent": F.col("n_periods") >= persistent,
            "declining": (F.col("last_year") <= last_by) & (F.col("first_year") <= first_by),
        }
    ).drop("_p")


def terms_of(text: Column, stop: tuple[str, ...] = (), grams: int = 1) -> Column:
    """Words of a text in lower case without stop words, then runs of up to `grams` words, joined by spaces, that no stop word interrupts."""
    plain = words(F.lower(F.coalesce(text, F.lit(""))))
    if grams == 1:
        return F.filter(plain, lambda w: ~w.isin(*stop)) if stop else plain
    kept = F.transform(plain, lambda w: F.when(~w.isin(*stop), w)) if stop else plain

    def runs(w: Column) -> Column:
        # the word k places on is null beyond the end and for stop words, which makes the run null
        of = lambda n: F.transform(w, lambda x, i: F.concat(x, *[y for k in range(1, n) for y in (F.lit(" "), F.get(w, i + k))]))
        return F.filter(F.concat(*[of(n) for n in range(1, grams + 1)]), lambda t: t.isNotNull())

    return let(kept, runs)


def ctfidf(docs: DataFrame, most: int | None = 10, least_docs: int = 2, stop: tuple[str, ...] = (), grams: int = 1) -> DataFrame:
    """Terms of each class by tf * ln(1 + A / f): A the mean number of terms in a class, f the term's total.

    docs: topic_id, text. Counts are exact; a term must occur in least_docs documents.
    Terms are words and runs of up to `grams` words. most: None gives every term.
    """
    each = docs.select("topic_id", terms_of(F.col("text"), stop, grams).alias("_w"))
    # a row each for a word and for a document's distinct word, so both counts come from one aggregate without documents as keys
    marked = F.concat(
        F.transform("_w", lambda w: F.struct(w.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df"))),
        F.transform(F.array_distinct("_w"), lambda w: F.struct(w.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))),
    )
    rows = each.select("topic_id", F.explode(marked).alias("m")).select("topic_id", "m.*")
    per_class = rows.groupBy("topic_id", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    whole = Window.partitionBy("term")
    stats = per_class.withColumns({"f": F.sum("tf").over(whole), "docs": F.sum("df").over(whole)}).where(F.col("docs") >= least_docs)
    total = per_class.agg((F.sum("tf") / F.count_distinct("topic_id")).alias("a"))
    scored = stats.join(F.broadcast(total)).withColumn("score", F.round(F.col("tf") * F.log1p(F.col("a") / F.col("f")), 6))  # one row
    if most is None:
        return scored.select("topic_id", "term", "tf", "score")
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("score").desc(), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most).select("topic_id", "term", "tf", "score", "rank")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, 0 where one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return ratio(dot, norm(a) * norm(b), 0.0)


def mean_vectors(rows: DataFrame, by: str, vector: str, size: int) -> DataFrame:
    """(by, vector): the mean vector of each group, as one aggregate of `size` sums."""
    sums = rows.groupBy(by).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"_{i}") for i in range(size)])
    return sums.select(by, F.array(*[f"_{i}" for i in range(size)]).alias(vector))


def reranked(candidates: DataFrame, term_vectors: DataFrame, centroids: DataFrame, most: int = 10, digits: int = 6) -> DataFrame:
    """A topic's candidate terms by the cosine of the term's vector to the topic's centroid, ties by term.

    candidates: topic_id, term. term_vectors: term, v. centroids: topic_id, v. A term without a vector goes last, at 0.
    """
    rows = candidates.select("topic_id", "term").join(term_vectors.select("term", F.col("v").alias("_t")), "term", "left")
    rows = rows.join(centroids.select("topic_id", F.col("v").alias("_c")), "topic_id", "left")
    rows = rows.withColumn("similarity", F.round(F.coalesce(cosine(F.col("_t"), F.col("_c")), F.lit(0.0)), digits))
    rank = F.row_number().over(Window.partitionBy("topic_id").orderBy(F.col("similarity").desc(), "term"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= most).select("topic_id", "term", "similarity", "rank")


def merged_topics(spark: SparkSession, scores: DataFrame, wanted: int) -> DataFrame:
    """(topic_id, merged_id): the most alike topics merged until `wanted` are left, or no two share a term; named by the least id.

    Likeness is the mean cosine of the scores of all pairs across two groups (average
    linkage). Groups that are each other's nearest merge in the same round, which gives
    the merges of one-at-a-time order, as groups never come nearer by a merge elsewhere;
    the first ones by likeness are then kept. Pairs come from shared terms: a row for
    each pair of topics that share one, however many documents there are.
    """
    size = scores.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("n"))
    left = scores.join(size, "topic_id").select("term", F.col("topic_id").alias("a"), (F.col("score") / F.col("n")).alias("x"))
    right = left.select("term", F.col("a").alias("b"), F.col("x").alias("y"))
    alike = left.join(right, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    alike = written(spark, alike.where("s > 0"), "alike")
    groups = written(spark, size.select("topic_id", F.col("topic_id").alias("g")), "groups")
    merges = None
    while True:
        count = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
        of = lambda c, g: groups.select(F.col("topic_id").alias(c), F.col("g").alias(g))  # noqa: B023, E731
        pairs = alike.join(of("a", "ga"), "a").join(of("b", "gb"), "b").where("ga != gb")
        pairs = pairs.groupBy(F.least("ga", "gb").alias("a"), F.greatest("ga", "gb").alias("b")).agg(F.sum("s").alias("s"))
        pairs = pairs.join(count.select(F.col("g").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("g").alias("b"), F.col("n").alias("nb")), "b")
        pairs = pairs.select("a", "b", F.round(F.col("s") / (F.col("na") * F.col("nb")), 12).alias("s"))
        # one order of pairs for both sides, so the first pair of all is always chosen
        key = F.struct(F.col("s"), -F.col("a"), -F.col("b"))
        both = pairs.select(F.col("a").alias("g"), key.alias("k"), "a", "b").unionByName(pairs.select(F.col("b").alias("g"), key.alias("k"), "a", "b"))
        best = both.groupBy("g").agg(F.max_by(F.struct("a", "b", F.col("k.s").alias("s")), "k").alias("p")).select("g", "p.*")
        found = written(spark, best.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("s").alias("s")).where("n = 2").drop("n"), "merges")
        if not found.limit(1).count():
            break
        merges = found if merges is None else merges.unionByName(found)
        groups = written(spark, groups.join(found.select(F.col("b").alias("g"), F.col("a").alias("_to")), "g", "left").select("topic_id", F.coalesce("_to", "g").alias("g")), "groups")
    topics = size.count()
    if merges is None or wanted >= topics:
        return size.select("topic_id", F.col("topic_id").alias("merged_id"))
    kept = merges.orderBy(F.col("s").desc(), "a", "b").limit(topics - max(1, wanted))
    linked = components(spark, kept.select(F.lit("").alias("era"), F.format_string("%019d", "a").alias("src"), F.format_string("%019d", "b").alias("dst")))
    names = linked.select(F.col("node").cast("long").alias("topic_id"), F.col("component").cast("long").alias("merged_id"))
    return size.select("topic_id").join(names, "topic_id", "left").select("topic_id", F.coalesce("merged_id", "topic_id").alias("merged_id"))


def clusters(vectors: DataFrame, k: int = 10, seed: int = 42, noise: float = 0.95) -> DataFrame:
    """(vec_id, topic_id) by k-means on the vectors; those beyond the noise quantile of their distance get -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(rows)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    found = model.transform(rows).withColumn("_v", vector_to_array("features"))
    gap = F.zip_with("_v", F.get(centres, F.col("prediction")), lambda x, y: (x - y) * (x - y))
    found = found.withColumn("_d", F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))
    limit = found.agg(F.percentile_approx("_d", noise, 10000).alias("_l"))
    out = found.join(F.broadcast(limit))  # one row
    return out.select("vec_id", F.when(F.col("_d") > F.col("_l"), -1).otherwise(F.col("prediction")).alias("topic_id"))


def projection(vectors: DataFrame, size: int = 2) -> DataFrame:
    """(vec_id, x0, x1, ...) by principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out = PCA(k=size, inputCol="features", outputCol="_p").fit(rows).transform(rows).withColumn("_a", vector_to_array("_p"))
    return out.select("vec_id", *[F.col("_a")[i].alias(f"x{i}") for i in range(size)])


def centroids(points: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Mean point of each group of `least` points or more, outliers left out; points: x, y as exact decimals or doubles."""
    rows = points.where("topic_id != -1").groupBy(*by).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))
    return rows.where(F.col("n") >= least)


def pivot_sum(rows: DataFrame, by: str, over: str, values: list, amount: str) -> DataFrame:
    """Sums with a column for each value, 0 where there are none."""
    names = {v: f"{over}_{v}" for v in values}
    return rows.groupBy(by).agg(*[F.coalesce(F.sum(F.when(F.col(over) == v, F.col(amount))), F.lit(0)).alias(n) for v, n in names.items()])


def pivot_first(rows: DataFrame, by: str, over: str, values: list, amount: str, order: str) -> DataFrame:
    """The amount of the first row by `order` in each cell, 0.0 where there is none."""
    cell = lambda v: F.min(F.when(F.col(over) == v, F.struct(order, amount)))
    return rows.groupBy(by).agg(*[F.coalesce(cell(v)[amount], F.lit(0.0)).alias(str(v)) for v in values])


def norm(c: Column) -> Column:
    """Euclidean length of an array column."""
    return F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))


def corpus_summary(chunks: DataFrame, by: str = "doc_title") -> DataFrame:
    """Chunks and tokens by document; average 0 for none."""
    out = chunks.groupBy(by).agg(F.count(F.lit(1)).alias("chunks"), F.sum("tokens").alias("tokens"))
    return out.withColumn("avg_tokens", ratio(F.col("tokens"), F.col("chunks"), 0.0))
