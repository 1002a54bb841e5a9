"""Mention asymmetry, strategies, topoi and their course over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import ratio
from lexmill.operators.frames import listed, ranked

NAMED = ("English", "Gaelic", "Scots")


def with_era(fact: DataFrame, eras: DataFrame, year: str = "doc_year") -> DataFrame:
    """fact with era and era_ord; 'unknown' for years outside the table of eras (ten rows, so broadcast)."""
    dim = F.broadcast(eras.select(F.col("year").alias("_y"), F.col("era").alias("_e"), F.col("era_ord").alias("_o")))
    out = fact.join(dim, F.col(year) == F.col("_y"), "left")
    return out.withColumns({"era": F.coalesce("_e", F.lit("unknown")), "era_ord": F.coalesce("_o", F.lit(99))}).drop("_y", "_e", "_o")


def with_era_range(fact: DataFrame, ranges: DataFrame, year: str = "doc_year") -> DataFrame:
    """fact with the era whose bounds hold the year, else 'Unknown' (four ranges, so broadcast)."""
    dim = F.broadcast(ranges.select(F.col("era").alias("_e"), "lo", "hi"))
    out = fact.join(dim, F.col(year).between(F.col("lo"), F.col("hi")), "left")
    return out.withColumn("era_range", F.coalesce("_e", F.lit("Unknown"))).drop("_e", "lo", "hi")


def mention_ratios(counts: DataFrame) -> DataFrame:
    """Ratio of minority to English mentions (infinite without English) and English invisibility (null without any)."""
    minority = F.col("gaelic_mentions") + F.col("scots_mentions")
    total = F.col("english_mentions") + minority
    return counts.withColumns(
        {
            "markedness_ratio": ratio(minority, F.col("english_mentions"), float("inf")),
            "english_invisibility_index": ratio(minority, total),
        }
    )


def mention_counts(mentions: DataFrame, by: list[str]) -> DataFrame:
    columns = [F.coalesce(F.sum((F.col("language") == x).cast("long")), F.lit(0)).alias(f"{x.lower()}_mentions") for x in NAMED]
    return (mentions.groupBy(*by) if by else mentions.groupBy()).agg(*columns)


def markedness(mentions: DataFrame, by: list[str]) -> DataFrame:
    """mentions: a row for each mention with its language and the grouping columns."""
    return mention_ratios(mention_counts(mentions, by))


def markedness_rollup(mentions: DataFrame, eras: DataFrame) -> DataFrame:
    """Documents, all eras (also those without mentions) and the grand total in one table.

    Mentions of unknown eras count in the total only.
    """
    docs = mention_counts(mentions, ["doc_title"]).select(F.lit("document").alias("level"), F.col("doc_title").alias("name"), "*").drop("doc_title")
    known = mention_counts(mentions, ["era"])
    every = eras.select("era").distinct().join(known, "era", "left").na.fill(0)
    every = every.select(F.lit("era").alias("level"), F.col("era").alias("name"), "*").drop("era")
    total = mention_counts(mentions, []).select(F.lit("total").alias("level"), F.lit("all").alias("name"), "*")
    return mention_ratios(docs.unionByName(every).unionByName(total))


def targeting(classified: DataFrame) -> DataFrame:
    """Counts of present strategies by target language and year; a language listed twice counts twice."""
    rows = classified.where(F.coalesce("present", F.lit(False))).select("strategy", "doc_year", F.explode("target_languages").alias("language"))
    return rows.groupBy("strategy", "language", "doc_year").agg(F.count(F.lit(1)).alias("n"))


def asymmetry(targets: DataFrame) -> DataFrame:
    """English and minority share of each strategy's targets, over the named languages."""
    rows = targets.where(F.col("language").isin(*NAMED))
    eng = F.coalesce(F.sum(F.when(F.col("language") == "English", F.col("n"))), F.lit(0))
    out = rows.groupBy("strategy").agg(eng.alias("english"), F.sum("n").alias("total"))
    out = out.withColumn("minority", F.col("total") - F.col("english"))
    return out.withColumns(
        {
            "english_share": ratio(F.col("english"), F.col("total"), 0.0),
            "minority_share": ratio(F.col("minority"), F.col("total"), 0.0),
            "asymmetry": ratio(F.col("minority"), F.col("english"), float("inf")),
        }
    )


def protection_density(mentions: DataFrame, classified: DataFrame) -> DataFrame:
    """By document and language: chunks that name it and predicate on it, chunks that only name it, and the density.

    Density is over all distinct classified chunks of the document; documents
    without any mention are absent.
    """
    named = mentions.select("doc_title", "chunk_id", "language").distinct()
    predicated = (
        classified.where((F.col("strategy") == "predication") & F.coalesce("present", F.lit(False)))
        .select("chunk_id", F.explode("target_languages").alias("language")).distinct().withColumn("both", F.lit(1))
    )
    totals = classified.groupBy("doc_title").agg(F.count_distinct("chunk_id").alias("total_chunks"))
    grid = named.select("doc_title").distinct().select("doc_title", F.explode(F.array(*[F.lit(x) for x in NAMED])).alias("language"))
    pairs = named.join(predicated, ["chunk_id", "language"], "left").groupBy("doc_title", "language").agg(
        F.count("both").alias("n_both"), F.count(F.when(F.col("both").isNull(), 1)).alias("n_only")
    )
    out = grid.join(pairs, ["doc_title", "language"], "left").join(totals, "doc_title", "left").na.fill(0)
    return out.withColumn("density", ratio(F.col("n_both"), F.col("total_chunks"), 0.0))


def markedness_density(mentions: DataFrame, classified: DataFrame) -> DataFrame:
    """Each document's mention ratios with its protection densities by language."""
    rows = protection_density(mentions, classified)
    wide = rows.groupBy("doc_title").agg(*[F.max(F.when(F.col("language") == x, F.col("density"))).alias(f"{x.lower()}_density") for x in NAMED])
    return markedness(mentions, ["doc_title"]).join(wide, "doc_title", "left").na.fill(0.0, [f"{x.lower()}_density" for x in NAMED])


def strategy_profiles(classified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """By document and strategy (or `by`): present and all chunks, prevalence, mean confidence of the present ones."""
    on = F.coalesce("present", F.lit(False))
    out = classified.groupBy(*(by or ["doc_title", "doc_year", "strategy"])).agg(
        F.sum(on.cast("long")).alias("present_count"),
        F.count(F.lit(1)).alias("total_chunks"),
        F.sum(F.when(on, F.round(F.col("confidence") * 1000000).cast("long"))).alias("_c"),
        F.count(F.when(on, F.col("confidence"))).alias("_n"),
    )
    return out.withColumns(
        {
            "prevalence": ratio(F.col("present_count"), F.col("total_chunks"), 0.0),
            # confidences are summed as millionths, so the mean does not depend on the order of rows
            "avg_confidence": ratio(F.coalesce("_c", F.lit(0)), F.col("_n") * 1000000, 0.0),
        }
    ).drop("_c", "_n")


def measures(rows: DataFrame, part: str, name: str | None, columns: list[str]) -> DataFrame:
    """(part, name, measure, value): the columns of each row below each other; name: a column, one name for all if None."""
    named = rows.select((F.lit("all") if name is None else F.col(name)).alias("name"), *[F.col(c).cast("double").alias(c) for c in columns])
    return named.unpivot("name", columns, "measure", "value").select(F.lit(part).alias("part"), "name", "measure", "value")


def markedness_profile(mentions: DataFrame, classified: DataFrame) -> DataFrame:
    """(part, name, measure, value): all measures of markedness in one table.

    total: mentions and ratios of the whole corpus. predication: how often each language
    is predicated, and the English share of that (0 without any). targeting: shares and
    asymmetry of each strategy. density: protection density by document and language.
    """
    targets = targeting(classified)
    counts = [F.coalesce(F.sum(F.when(F.col("language") == x, F.col("n"))), F.lit(0)).alias(f"{x.lower()}_count") for x in NAMED]
    predicated = targets.where("strategy = 'predication'").agg(*counts)
    every = sum((F.col(f"{x.lower()}_count") for x in NAMED[1:]), F.col(f"{NAMED[0].lower()}_count"))
    predicated = predicated.withColumn("english_share", ratio(F.col("english_count"), every, 0.0))
    density = protection_density(mentions, classified)
    wide = density.groupBy("doc_title").agg(*[F.max(F.when(F.col("language") == x, F.col("density"))).alias(f"{x.lower()}_density") for x in NAMED])
    low = [x.lower() for x in NAMED]
    total = measures(markedness(mentions, []), "total", None, [*[f"{x}_mentions" for x in low], "markedness_ratio", "english_invisibility_index"])
    out = total.unionByName(measures(predicated, "predication", None, [*[f"{x}_count" for x in low], "english_share"]))
    out = out.unionByName(measures(asymmetry(targets), "targeting", "strategy", ["english_share", "minority_share", "asymmetry"]))
    return out.unionByName(measures(wide, "density", "doc_title", [f"{x}_density" for x in low]))


def document_info(chunks: DataFrame) -> DataFrame:
    """(doc_title, doc_year, jurisdiction, num_chunks): year and jurisdiction of each title's first chunk."""
    first = F.min_by(F.struct("doc_year", "jurisdiction"), "chunk_id").alias("_i")
    return chunks.groupBy("doc_title").agg(first, F.count(F.lit(1)).alias("num_chunks")).select("doc_title", "_i.*", "num_chunks")


def titled_profiles(classified: DataFrame, info: DataFrame) -> DataFrame:
    """The whole profile of each title and strategy: counts, confidence, first devices and topoi, all target languages, and the document's info.

    Lists are value:count joined by |. A title without info keeps its row, with 0 chunks.
    """
    by = ["doc_title", "strategy"]
    on = classified.where(F.coalesce("present", F.lit(False)))
    out = strategy_profiles(classified, by)
    for column, name, most in (("linguistic_devices", "top_devices", 5), ("target_languages", "languages", None), ("topoi", "top_topoi", 5)):
        rows = on.where("strategy = 'argumentation'") if column == "topoi" else on
        out = out.join(listed(rows.select(*by, F.explode(column).alias("_v")), by, "_v", name, most), by, "left")
    return out.join(info, "doc_title", "left").withColumn("num_chunks", F.coalesce("num_chunks", F.lit(0).cast("long")))


def device_ranks(classified: DataFrame, most: int = 5) -> DataFrame:
    rows = classified.where(F.coalesce("present", F.lit(False))).select("doc_title", "doc_year", "strategy", F.explode("linguistic_devices").alias("device"))
    counts = rows.groupBy("doc_title", "doc_year", "strategy", "device").agg(F.count(F.lit(1)).alias("n"))
    return ranked(counts, ["doc_title", "doc_year", "strategy"], "device", most)


def strategy_summary(classified: DataFrame) -> DataFrame:
    """The profile with the first device and the most frequent target language."""
    by = ["doc_title", "doc_year", "strategy"]
    devices = device_ranks(classified, 1).select(*by, F.col("device").alias("top_device"))
    langs = classified.where(F.coalesce("present", F.lit(False))).select(*by, F.explode("target_languages").alias("language"))
    langs = ranked(langs.groupBy(*by, "language").agg(F.count(F.lit(1)).alias("n")), by, "language", 1)
    langs = langs.select(*by, F.col("language").alias("primary_target_language"))
    return strategy_profiles(classified).join(devices, by, "left").join(langs, by, "left")


def topos_counts(classified: DataFrame, by: list[str]) -> DataFrame:
    """Topos instances by group, with their proportion of the group's argumentation chunks (not a share)."""
    present = classified.where((F.col("strategy") == "argumentation") & F.coalesce("present", F.lit(False)))
    chunks = present.groupBy(*by).agg(F.count(F.lit(1)).alias("argumentation_chunks"))
    rows = present.select(*by, F.explode("topoi").alias("topos"))
    counts = rows.groupBy(*by, "topos").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(chunks, by).withColumn("proportion", ratio(F.col("n"), F.col("argumentation_chunks")))


def topos_trajectory(classified: DataFrame) -> DataFrame:
    """Counts by year and topos, with the year's dominant topos."""
    counts = topos_counts(classified, ["doc_year"])
    lead = ranked(counts, ["doc_year"], "topos", 1).select("doc_year", F.col("topos").alias("dominant"))
    return counts.join(lead, "doc_year")


def topos_levels(classified: DataFrame, eras: DataFrame) -> DataFrame:
    """Topoi by year, by era and in total: a row for each level, name and topos, with the name's dominant topos and sums.

    Years without topoi are absent; every era and the total have at least one row, without
    a topos if they have none. Years outside the table of eras count in their year and the total.
    """
    on = (F.col("strategy") == "argumentation") & F.coalesce("present", F.lit(False))
    fine = ["doc_year", "era"]
    sizes = classified.groupBy(*fine).agg(F.count_distinct("chunk_id").alias("total_chunks"), F.sum(on.cast("long")).alias("argumentation_present"))
    counts = classified.where(on).select(*fine, F.explode("topoi").alias("topos")).groupBy(*fine, "topos").agg(F.count(F.lit(1)).alias("n"))
    name = F.array(
        F.struct(F.lit("year").alias("level"), F.coalesce(F.col("doc_year").cast("string"), F.lit("unknown")).alias("name")),
        F.struct(F.lit("era").alias("level"), F.col("era").alias("name")), F.struct(F.lit("total").alias("level"), F.lit("all").alias("name")),
    )
    # rows of one year and era are few from here on
    by = ["level", "name"]
    sizes = sizes.withColumn("_l", F.explode(name)).groupBy("_l.level", "_l.name").agg(F.sum("total_chunks").alias("total_chunks"), F.sum("argumentation_present").alias("argumentation_present"))
    counts = counts.withColumn("_l", F.explode(name)).groupBy("_l.level", "_l.name", "topos").agg(F.sum("n").alias("n"))
    lead = ranked(counts, by, "topos", 1).select(*by, F.col("topos").alias("dominant"))
    sums = counts.groupBy(*by).agg(F.sum("n").alias("total_instances"))
    kept = eras.select(F.lit("era").alias("level"), F.col("era").alias("name")).distinct()
    kept = kept.unionByName(counts.where("level = 'year'").select(*by).distinct()).unionByName(eras.sparkSession.sql("select 'total' level, 'all' name"))
    out = kept.join(sizes, by, "left").join(counts, by, "left").join(lead, by, "left").join(sums, by, "left")
    return out.na.fill(0, ["total_chunks", "argumentation_present", "total_instances"]).withColumn("proportion", ratio(F.col("n"), F.col("argumentation_present")))


def identity_evidence(classified: DataFrame, most: int = 2, length: int = 200) -> DataFrame:
    """For each era's two first topoi the first quotes of the first `most` chunks that have any, cut to `length` characters."""
    lead = ranked(topos_counts(classified, ["era"]), ["era"], "topos", 2).select("era", "topos", F.col("rank").alias("frame"))
    on = (F.col("strategy") == "argumentation") & F.coalesce("present", F.lit(False)) & (F.size("evidence_quotes") > 0)
    rows = classified.where(on).select("era", "chunk_id", F.col("evidence_quotes")[0].alias("quote"), F.explode("topoi").alias("topos"))
    order = Window.partitionBy("era", "topos").orderBy("chunk_id")
    first = rows.join(F.broadcast(lead), ["era", "topos"]).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)  # two rows an era
    return first.select("era", "frame", "topos", "place", "chunk_id", F.substring("quote", 1, length).alias("quote"))


def turning_points(classified: DataFrame) -> DataFrame:
    """Years in which the dominant topos changes or topoi appear for the first time."""
    counts = topos_counts(classified, ["doc_year"])
    lead = ranked(counts, ["doc_year"], "topos", 1).select("doc_year", F.col("topos").alias("dominant"), F.col("n").alias("dominant_n"))
    # one row a year; years are few
    prior = Window.orderBy("doc_year")
    years = lead.withColumn("previous_dominant", F.lag("dominant").over(prior))
    first = counts.groupBy("topos").agg(F.min("doc_year").alias("doc_year"))
    new = first.groupBy("doc_year").agg(F.array_join(F.array_sort(F.collect_set("topos")), ",").alias("new_topoi"))
    back = counts.select("doc_year", F.col("topos").alias("previous_dominant"), F.col("n").alias("_old"))
    out = years.join(new, "doc_year", "left").join(back, ["doc_year", "previous_dominant"], "left")
    changed = F.col("previous_dominant").isNotNull() & (F.col("previous_dominant") != F.col("dominant"))
    fresh = F.coalesce("new_topoi", F.lit("")) != ""
    kind = F.when(changed & fresh, "dominant_change_and_new_topoi").when(changed, "dominant_topos_change").when(fresh, "new_topoi_emergence")
    size = ratio(F.col("dominant_n") - F.col("_old"), F.greatest("dominant_n", "_old", F.lit(1)))
    return (
        out.withColumns({"turning_point": kind, "magnitude": F.when(F.col("_old").isNotNull(), size)})
        .where("turning_point is not null")
        .select("doc_year", "dominant", "previous_dominant", "new_topoi", "turning_point", "magnitude")
    )


def entropy(n: Column, total: Column) -> Column:
    p = n.cast("double") / total
    return -F.sum(p * F.log2(p))


def identity_timeline(classified: DataFrame, law: str = "topos_of_law", culture: tuple[str, ...] = ("topos_of_culture", "topos_of_history", "topos_of_heritage")) -> DataFrame:
    """By era: the two first topoi, diversity in bits, law against culture, and how often arguments are made."""
    counts = topos_counts(classified, ["era"])
    order = Window.partitionBy("era").orderBy(F.col("n").desc(), "topos")
    whole = Window.partitionBy("era")
    rows = counts.withColumns({"rank": F.row_number().over(order), "total": F.sum("n").over(whole)})
    amount = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    out = rows.groupBy("era").agg(
        F.max(F.when(F.col("rank") == 1, F.col("topos"))).alias("dominant_topos"),
        F.max(F.when(F.col("rank") == 2, F.col("topos"))).alias("secondary_topos"),
        F.sum("n").alias("total_topoi_instances"),
        F.round(entropy(F.col("n"), F.col("total")), 6).alias("frame_diversity"),
        amount(F.col("topos") == law).alias("_law"),
        amount(F.col("topos").isin(*culture)).alias("_culture"),
    )
    args = classified.where(F.col("strategy") == "argumentation").groupBy("era").agg(
        F.sum(F.coalesce("present", F.lit(False)).cast("long")).alias("_on"), F.count(F.lit(1)).alias("_all")
    )
    out = out.join(args, "era")
    return out.select(
        "era",
        "dominant_topos",
        "secondary_topos",
        ratio(F.col("_law"), F.col("_law") + F.col("_culture")).alias("law_vs_culture_ratio"),
        "frame_diversity",
        ratio(F.col("_on"), F.col("_all"), 0.0).alias("argumentation_prevalence"),
        "total_topoi_instances",
    )


def topos_language_matrix(classified: DataFrame) -> DataFrame:
    """Topos by language counts of argumentation chunks, a row for each pair, with the topos's total."""
    present = classified.where((F.col("strategy") == "argumentation") & F.coalesce("present", F.lit(False)))
    pairs = present.select(F.explode("topoi").alias("topos"), "target_languages").select("topos", F.explode("target_languages").alias("language"))
    counts = pairs.groupBy("topos", "language").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("total", F.sum("n").over(Window.partitionBy("topos")))


def evidence(classified: DataFrame, texts: DataFrame) -> DataFrame:
    """Evidence quotes with whether they stand in their chunk's text (an unverified one is kept and flagged)."""
    rows = classified.select("chunk_id", "strategy", F.explode("evidence_quotes").alias("quote"))
    return rows.join(texts.select("chunk_id", "text"), "chunk_id", "left").select(
        "chunk_id", "strategy", "quote", F.coalesce(F.col("text").contains(F.col("quote")), F.lit(False)).alias("verified")
    )
