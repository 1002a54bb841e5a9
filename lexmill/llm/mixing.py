"""Hierarchical token budgets: mix sources to target weights.

The corpus is a tree, by default domain, language, source. A token budget flows
from the root by weight. A node takes at most its capacity (tokens times
max_epochs); what it cannot take goes to its siblings by weight, and only when
all siblings are full back to the ancestors' siblings, because a node's capacity
is the sum of its children's. A leaf with A tokens to give out of T runs A div T
whole epochs, then the first A mod T tokens of the next epoch's seeded order: whole
documents, and of the one that crosses the end so many tokens as are left
(`taken`). Shares are rounded down, by less than one token a node.

The order of an epoch is the MD5 of seed, epoch and id. A leaf's prefix is found
from sums over 4096 slices of the digest, then inside one slice, so no leaf,
however hot, is sorted in one task; and it is kept as a cut-off digest, so texts
are never shuffled.

Nulls in a level count as the empty label, a null text has no tokens, and a null
id as the empty id. Rows with equal ids in a leaf are taken together and whole, or
not at all. Empty input gives an empty result; so does a budget of nothing, but
for documents without tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import materialize

LEVELS = ("domain", "lang", "source")
DIGITS = 3


def token_count(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = weights.get(level) or {}
    if not known:
        return F.lit(1).cast("long")
    pairs = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(pairs, F.col(level)), F.lit(1)).cast("long")


def fill(nodes: DataFrame, parents: list[str], node: str) -> DataFrame:
    """nodes(parents, node, cap, w, budget of the parent) with `got`: shares by weight, none above cap.

    By ascending cap / w a prefix of the children is full; the rest share what is left.
    """
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("cap") / F.col("w")).asc(), F.col(node).asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    staged = nodes.withColumns(
        {
            "_left": F.col("budget") - F.coalesce(F.sum("cap").over(before), zero),
            "_w": F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), zero),
        }
    ).withColumn("_full", F.col("cap") * F.col("_w") <= F.col("_left") * F.col("w"))
    staged = staged.withColumns(
        {
            "_rest": F.col("budget") - F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(zero)).over(by),
            "_restw": F.sum(F.when(F.col("_full"), zero).otherwise(F.col("w"))).over(by),
        }
    )
    got = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("(_rest * w) div _restw"))
    return staged.withColumn("got", got).drop("_left", "_w", "_full", "_rest", "_restw")


def plan(
    spark: SparkSession, leaves: DataFrame, levels: tuple[str, ...], weights: dict, budget_permille: int, max_epochs: int
) -> DataFrame:
    """(levels, total, got) for each leaf, from (levels, total); the budget is so many thousandths of all tokens."""
    caps = leaves.withColumns({f"w_{x}": weight_of(x, weights) for x in levels})
    usable = F.lit(True)
    for x in levels:
        usable = usable & (F.col(f"w_{x}") > 0)
    caps = caps.withColumn("cap", F.when(usable, F.col("total") * max_epochs).otherwise(0).cast("long")).where((F.col("cap") > 0))
    budget = leaves.agg(F.expr(f"sum(total) * {int(budget_permille)} div 1000").cast("long").alias("wanted"))
    total = caps.agg(F.sum("cap").alias("most"))
    above = budget.crossJoin(total).select(F.least("wanted", "most").alias("budget"))  # one row by one row
    for depth, level in enumerate(levels):
        parents, path = list(levels[:depth]), list(levels[: depth + 1])
        nodes = caps.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w_{level}").alias("w"))
        nodes = nodes.join(above, parents) if parents else nodes.crossJoin(F.broadcast(above))  # above is one row
        above = fill(nodes, parents, level).select(*path, F.col("got").alias("budget"))
    return leaves.join(above, list(levels)).select(*levels, "total", F.col("budget").alias("got"))


def order_digest(seed: int, epoch: Column, key: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def cutoffs(
    spark: SparkSession,
    narrow: DataFrame,
    levels: tuple[str, ...] = LEVELS,
    weights: dict | None = None,
    budget_permille: int = 500,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """(levels, epochs, cutoff, crossing, part) by leaf.

    epochs: whole epochs; cutoff: the last digest taken whole of the next one ('' for none); crossing: the digest of the
    document that is taken in part, and so many of its tokens.
    """
    at = list(levels)
    leaves = narrow.groupBy(*at).agg(F.sum("tokens").alias("total"))
    shares = materialize(spark, plan(spark, leaves, levels, weights or {}, budget_permille, max_epochs), "mix-plan")
    shares = shares.withColumns({"epochs": F.expr("got div total"), "part": F.expr("got % total")})
    keyed = narrow.join(shares, at).withColumn("digest", order_digest(seed, F.col("epochs"), "doc_id"))
    keyed = keyed.withColumn("slice", F.substring("digest", 1, DIGITS))
    slices = keyed.groupBy(*at, "slice").agg(F.sum("tokens").alias("t"), F.max("part").alias("part"), F.max("digest").alias("top"))
    run = Window.partitionBy(*at).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = slices.withColumn("upto", F.sum("t").over(run))
    # slices that fit whole, and the first that does not
    whole = slices.where(F.col("upto") <= F.col("part")).groupBy(*at).agg(F.max("top").alias("whole_top"))
    split = slices.where((F.col("upto") > F.col("part")) & (F.col("upto") - F.col("t") <= F.col("part")))
    split = split.groupBy(*at).agg(F.min(F.struct("slice", (F.col("part") - F.col("upto") + F.col("t")).alias("room"))).alias("s"))
    split = materialize(spark, split.select(*at, F.col("s.slice").alias("slice"), F.col("s.room").alias("room")), "mix-slices")
    fine = keyed.join(split, [*at, "slice"]).groupBy(*at, "digest").agg(
        F.sum("tokens").alias("t"), F.max("room").alias("room"), F.count(F.lit(1)).alias("rows")
    )
    run = Window.partitionBy(*at).orderBy("digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fine = fine.withColumn("upto", F.sum("t").over(run))
    over = (F.col("upto") > F.col("room")) & (F.col("upto") - F.col("t") < F.col("room")) & (F.col("rows") == 1)
    crossing = F.min(F.when(over, F.struct("digest", (F.col("room") - F.col("upto") + F.col("t")).alias("part"))))
    fine = fine.groupBy(*at).agg(F.max(F.when(F.col("upto") <= F.col("room"), F.col("digest"))).alias("fine_top"), crossing.alias("c"))
    out = shares.drop("part").join(whole, at, "left").join(fine, at, "left")
    cut = F.coalesce("fine_top", "whole_top", F.lit(""))
    columns = [F.col("epochs").cast("int").alias("epochs"), cut.alias("cutoff"), F.col("c.digest").alias("crossing"), F.col("c.part").alias("part")]
    return materialize(spark, out.select(*at, *columns), "mix-cutoffs")


def labelled(docs: DataFrame, levels: tuple[str, ...], domain: Column | None) -> DataFrame:
    """docs with the tree's levels as columns _0, _1, ..., nulls as ''."""
    for i, x in enumerate(levels):
        source = domain if x == "domain" and domain is not None else F.col(x)
        docs = docs.withColumn(f"_{i}", F.coalesce(source.cast("string"), F.lit("")))
    return docs


def mix(
    spark: SparkSession,
    docs: DataFrame,
    domain: Column | None = None,
    levels: tuple[str, ...] = LEVELS,
    weights: dict | None = None,
    budget_permille: int = 500,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """doc_id, the levels, tokens, epoch and taken: one row for each time that a document is taken, whole or in part."""
    rows = labelled(docs, levels, domain)
    narrow = rows.select("doc_id", *[F.col(f"_{i}").alias(x) for i, x in enumerate(levels)], token_count(F.col("text")).alias("tokens"))
    narrow = materialize(spark, narrow, "mix-rows")
    cut = cutoffs(spark, narrow, levels, weights, budget_permille, max_epochs, seed)
    rows = repeated(narrow.join(cut, list(levels)), seed, True)
    taken = F.when(F.col("_cut") & (F.col("epoch") == F.col("epochs")), F.col("part")).otherwise(F.col("tokens"))
    return rows.select("doc_id", *levels, "tokens", "epoch", taken.alias("taken"))


def repeated(joined: DataFrame, seed: int, parts: bool) -> DataFrame:
    """Rows once for each epoch that takes them; those that are taken in part in the last one only with `parts`."""
    rows = joined.withColumn("_digest", order_digest(seed, F.col("epochs"), "doc_id"))
    rows = rows.withColumn("_cut", F.coalesce(F.col("_digest") == F.col("crossing"), F.lit(False)) & F.lit(parts))
    times = rows.withColumn("_times", F.col("epochs") + ((F.col("_digest") <= F.col("cutoff")) | F.col("_cut")).cast("int")).where("_times > 0")
    return times.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("_times") - 1)))


def mix_documents(
    spark: SparkSession,
    docs: DataFrame,
    domain: Column | None = None,
    levels: tuple[str, ...] = LEVELS,
    weights: dict | None = None,
    budget_permille: int = 500,
    max_epochs: int = 4,
    seed: int = 0,
) -> DataFrame:
    """docs' own columns, a row for each time that a document is taken whole."""
    # the row travels as one struct, so none of its columns can clash with those of the plan
    rows = labelled(docs.withColumn("_row", F.struct(*docs.columns)), levels, domain)
    at = [F.col(f"_{i}").alias(x) for i, x in enumerate(levels)]
    narrow = materialize(spark, rows.select("doc_id", *at, token_count(F.col("text")).alias("tokens")), "mix-rows")
    cut = cutoffs(spark, narrow, levels, weights, budget_permille, max_epochs, seed)
    joined = rows.select("_row", "doc_id", *at).join(cut, list(levels))
    return repeated(joined, seed, False).select("_row.*")
