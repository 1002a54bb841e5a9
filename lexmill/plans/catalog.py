"""Catalogue of the engine's own queries, bound to the test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.dims import ERAS, OCR_PAIRS, STRATEGIES, era_table, strategy_table
from lexmill.functions import text as ft
from lexmill.operators import chunking, cleaning, density, discourse, frames, graph, layout, plots, providers, topics
from lexmill.plans import bindings as b
from lexmill.plans import oracle
from lexmill.storage import scratch_dir, ship, written

Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}
ERA_ORDER = list(ERAS)


def query(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    FOUND[f.__name__] = run
    return f


@query
def markedness_by_doc(s, d):
    return discourse.markedness(b.mentions(s, d), ["doc_title"])


@query
def markedness_rollup(s, d):
    return discourse.markedness_rollup(b.mentions(s, d), era_table(s))


@query
def strategy_targeting(s, d):
    return discourse.targeting(b.classified(s, d))


@query
def targeting_asymmetry(s, d):
    return discourse.asymmetry(discourse.targeting(b.classified(s, d)))


@query
def protection_density(s, d):
    named = written(s, b.mentions(s, d).select("doc_title", "chunk_id", "language").distinct(), "mentions")
    return discourse.protection_density(named, b.classified_once(s, d))


@query
def predicate_inventory_top(s, d):
    return frames.inventory_top(b.frames(s, d), ["target_term", "doc_year"])


@query
def agency_summary(s, d):
    return frames.agency_summary(b.frames(s, d))


@query
def agency_weighted_era(s, d):
    out = frames.weighted_agency(b.ranged(s, d), ["target_language", "era_range"])
    return out.withColumn("agency_ratio", F.round("agency_ratio", 6))


@query
def agency_weighted_year(s, d):
    out = frames.weighted_agency(b.frames(s, d), ["target_language", "doc_year"])
    return out.withColumn("agency_ratio", F.round("agency_ratio", 6))


@query
def markedness_profile(s, d):
    named = written(s, b.mentions(s, d).select("doc_title", "chunk_id", "language"), "mentions")
    return discourse.markedness_profile(named, b.classified_once(s, d))


@query
def strategy_profiles(s, d):
    return discourse.strategy_profiles(b.classified(s, d))


@query
def titled_profiles(s, d):
    return discourse.titled_profiles(b.classified_once(s, d), discourse.document_info(b.chunks(s, d)))


@query
def markedness_density(s, d):
    named = written(s, b.mentions(s, d).select("doc_title", "chunk_id", "language"), "mentions")
    return discourse.markedness_density(named, b.classified_once(s, d))


@query
def topos_levels(s, d):
    return discourse.topos_levels(b.classified_once(s, d), era_table(s))


@query
def identity_evidence(s, d):
    """Whole texts stand for the quotes of a model."""
    texts = b.chunks(s, d).select("chunk_id", F.when(F.length("text") > 0, F.array("text")).otherwise(F.array()).alias("evidence_quotes"))
    found = b.classified(s, d).where("strategy = 'argumentation' and present").join(texts, "chunk_id")
    out = discourse.identity_evidence(found)
    return out.select("era", "frame", "topos", "place", "chunk_id", F.md5("quote").alias("quote_md5"))


@query
def last_years(s, d):
    """Year and era that a title's last chunk gives."""
    return frames.last_rows(b.chunks(s, d).select("doc_title", "chunk_id", "doc_year", "era"), "doc_title", "chunk_id")


@query
def strategy_summary(s, d):
    return discourse.strategy_summary(b.classified_once(s, d))


@query
def device_ranks(s, d):
    return discourse.device_ranks(b.classified(s, d))


@query
def topos_trajectory(s, d):
    return discourse.topos_trajectory(b.classified_once(s, d))


@query
def turning_points(s, d):
    return discourse.turning_points(b.classified_once(s, d))


@query
def identity_timeline(s, d):
    return discourse.identity_timeline(b.classified_once(s, d))


@query
def topos_language_matrix(s, d):
    return discourse.topos_language_matrix(b.classified(s, d))


@query
def role_classification(s, d):
    return b.frames(s, d).groupBy("doc_title", "syntactic_role", "dep_relation").agg(F.count(F.lit(1)).alias("n"))


@query
def agent_taxonomy(s, d):
    part = b.table(s, d, "part").select(F.lower("p_name").alias("name"))
    nation = b.table(s, d, "nation").select(F.concat(F.lower("n_name"), F.lit(" council")).alias("name"))
    segment = b.table(s, d, "customer").select(F.lower("c_mktsegment").alias("name"))
    names = part.unionByName(nation).unionByName(segment).distinct()
    return names.select("name", frames.agent_category(F.col("name"), F.col("name")).alias("category"))


@query
def power_triangle(s, d):
    return frames.power_triangle(b.triples(s, d))


@query
def agent_backgrounding(s, d):
    found = b.triples(s, d)
    by_doc = frames.backgrounding(found, ["doc_title"]).withColumnRenamed("doc_title", "name").withColumn("level", F.lit("document"))
    known = found.where("era != 'unknown'")
    by_era = frames.backgrounding(known, ["era"]).withColumnRenamed("era", "name").withColumn("level", F.lit("era"))
    return by_doc.unionByName(by_era)


@query
def flow_counts(s, d):
    return frames.flow_counts(b.triples(s, d))


@query
def svo_triples(s, d):
    """Frames, governing verbs and agents from parsed tokens, by verb and agent."""
    by = ["target_lemma", "target_language", "dep_relation", "governing_verb", "agent_text", "agent_category", "voice", "by_phrase"]
    return b.triples(s, d).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(F.md5("sentence")).alias("first_md5"))


@query
def power_profiles(s, d):
    return frames.power_profiles(b.triples(s, d), era_table(s))


@query
def pos_stopwords(s, d):
    return frames.pos_stopwords(b.frames(s, d))


@query
def top_frames(s, d):
    rows = b.frames(s, d).withColumn("sentence", F.col("dep_head_lemma"))
    return frames.top_frames(rows).select("chunk_id", "rank", "token_idx", "target_term", "syntactic_role")


@query
def topic_frequency(s, d):
    return topics.topic_frequency(b.assigned(s, d))


@query
def topic_trajectories(s, d):
    return topics.trajectories(topics.topic_frequency(b.assigned(s, d)))


@query
def topic_pivot(s, d):
    return topics.pivot_sum(topics.topic_frequency(b.assigned(s, d)), "doc_year", "topic_id", list(range(1, 10)), "frequency")


@query
def topic_ctfidf(s, d):
    docs = b.chunks(s, d).select(F.col("jurisdiction").alias("topic_id"), "text")
    return topics.ctfidf(docs).select("topic_id", "term", "tf", "rank")


@query
def centroids(s, d):
    return topics.centroids(b.assigned(s, d), ["doc_year", "topic_id"])


@query
def embedding_norm(s, d):
    rows = b.table(s, d, "embeddings")
    return rows.select("vec_id", F.round(topics.norm(F.col("embedding")), 4).alias("norm"))


@query
def strategy_pivot(s, d):
    rows = discourse.strategy_profiles(b.classified(s, d))
    return topics.pivot_first(rows, "doc_year", "strategy", list(STRATEGIES), "prevalence", "doc_title")


@query
def edge_weights(s, d):
    return graph.edge_weights(b.frames(s, d))


@query
def weighted_degree(s, d):
    return graph.degrees(graph.edge_weights(b.frames(s, d)))


@query
def graph_density(s, d):
    return graph.graph_stats(graph.edge_weights(b.frames(s, d)))


@query
def emerging_edges(s, d):
    return graph.emerging_edges(graph.edge_weights(b.frames(s, d)), sorted(ERA_ORDER))


@query
def emerging_edges_chronological(s, d):
    return graph.emerging_edges(graph.edge_weights(b.frames(s, d)), ERA_ORDER, once=True)


@query
def centrality_fill(s, d):
    return graph.centrality_fill(graph.degrees(graph.edge_weights(b.frames(s, d))), ERA_ORDER, "total_degree")


def supply(s, d):
    """Suppliers linked to the parts they ship, by return flag: hubs that are not linked to each other share neighbours."""
    rows = b.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("era"), F.concat(F.lit("S"), "l_suppkey").alias("src"), F.concat(F.lit("P"), "l_partkey").alias("dst")
    )
    return written(s, rows.groupBy("era", "src", "dst").agg(F.count(F.lit(1)).alias("weight")), "supply")


@query
def bridge_nodes(s, d):
    edges = supply(s, d)
    return graph.bridges(edges, graph.degrees(edges))


#: Market segments of the test tables.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def trade(s, d):
    """Nations linked by their customers' largest orders: a small graph by market segment."""
    c, o = b.table(s, d, "customer"), b.table(s, d, "orders")
    n = b.table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    to = F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1))
    return rows.groupBy(F.col("c_mktsegment").alias("era"), F.col("n_name").alias("src"), to.alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


@query
def connected_components(s, d):
    edges = graph.edge_weights(b.frames(s, d))
    return graph.components(s, edges)


@query
def pagerank_k(s, d):
    return graph.pagerank(s, trade(s, d), 10, digits=5)


@query
def centrality_table(s, d):
    edges = trade(s, d)
    return graph.centrality_table(edges, graph.pagerank(s, edges, 10, digits=5))


@query
def pagerank_shift(s, d):
    """Change of PageRank from one market segment to the next by name."""
    ranks = graph.pagerank(s, trade(s, d), 10, digits=5)
    out = graph.era_centrality_shift(ranks, SEGMENTS, "pagerank")
    return out.withColumn("shift", F.round("shift", 5))


@query
def betweenness(s, d):
    return graph.betweenness(s, graph.edge_weights(b.frames(s, d)))


@query
def clean_lines(s, d):
    lines = cleaning.lines_of(b.table(s, d, "documents"))
    lines = cleaning.drop_contents(cleaning.drop_boilerplate(lines, ["The\\s", "Copyright"]), 1)
    lines = cleaning.drop_publisher_tail(lines, ("[A-Z][a-z]+\\.\\s*$",))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.md5(text).alias("text_md5")
    )


@query
def blank_collapse(s, d):
    text = F.regexp_replace("text", "([.]) ", "$1\n\n\n")
    return b.table(s, d, "documents").select("doc_id", F.md5(ft.normalize_space(text)).alias("text_md5"))


@query
def ocr_fix(s, d):
    fixed = ft.fix_ocr(F.regexp_replace("text", "that", "tbat"), OCR_PAIRS)
    return b.table(s, d, "documents").select("doc_id", F.md5(fixed).alias("text_md5"))


@query
def hyphen_rejoin(s, d):
    text = F.regexp_replace("text", "(th)([a-z])", "$1-\n$2")
    return b.table(s, d, "documents").select("doc_id", F.length(ft.rejoin_hyphens(text)).cast("long").alias("n"), F.md5(ft.rejoin_hyphens(text)).alias("text_md5"))


@query
def sections(s, d):
    lines = cleaning.lines_of(b.table(s, d, "documents"))
    found = chunking.sections(lines, "[A-Z][a-z]{1,3}\\s").withColumn("text_md5", F.md5("text"))
    return found.select("doc_id", "section_seq", "section_id", "section_title", "start_line", "end_line", "text_md5")


@query
def sentence_chunks(s, d):
    found = chunking.sections(cleaning.lines_of(b.table(s, d, "documents")), "[A-Z]{2,}\\b")
    return chunking.chunk_sections(found, 120, 20)


@query
def chunk_counts(s, d):
    docs = b.table(s, d, "documents")
    found = chunking.sections(cleaning.lines_of(docs), "[A-Z]{2,}\\b")
    meta = docs.select("doc_id", (F.col("doc_id") % 10 + 1).alias("doc_no"), F.col("source").alias("doc_title"), F.lit(2005).alias("doc_year"))
    out = chunking.assemble(chunking.chunk_sections(found, 120, 20), meta)
    return out.select("chunk_id", "chunk_key", "doc_id", "section_id", "chunk_index", "total_chunks_in_section", "token_count")


@query
def corpus_summary(s, d):
    rows = b.chunks(s, d).withColumn("tokens", F.size(ft.words(F.col("text"))).cast("long"))
    return topics.corpus_summary(rows)


@query
def prompt_hash(s, d):
    text = F.concat(F.lit("["), "doc_title", F.lit("] "), "text")
    return b.chunks(s, d).select("chunk_id", providers.prompt_key(text).alias("prompt_sha"))


@query
def prompt_cache_antijoin(s, d):
    prompts = b.chunks(s, d).select("chunk_id", providers.prompt_key(F.col("text")).alias("prompt_sha"))
    known = prompts.where("chunk_id % 3 = 0").select("prompt_sha").distinct()
    misses = prompts.join(known, "prompt_sha", "left_anti")
    return misses.groupBy("prompt_sha").agg(F.count(F.lit(1)).alias("rows"), F.min("chunk_id").alias("first_chunk"))


@query
def prompt_texts(s, d):
    rows = b.frames(s, d).withColumn("sentence", F.col("dep_head_lemma"))
    lines = frames.frame_lines(frames.top_frames(rows))
    joined = b.chunks(s, d).join(lines, "chunk_id", "left")
    text = providers.prompt(F.lit("Which strategies occur?"), F.col("doc_title"), F.col("doc_year"), F.col("frames"), F.col("text"), "Reply with JSON.")
    return joined.select("chunk_id", providers.prompt_key(text).alias("prompt_sha"), F.length("frames").alias("frames_chars"))


@query
def strategy_classification(s, d):
    """Prompts past a cache to a client and back as records: every third chunk's prompts stand in the cache as absent."""
    chunks = b.chunks(s, d)
    known = F.from_json(F.lit('{"present": false, "confidence": 0.25, "notes": "cached"}'), ft.CLASSIFICATION)
    path = f"{scratch_dir(s)}/lexmill-cache-{uuid.uuid4().hex}"
    providers.prompt_keys(chunks.where("chunk_id % 3 = 0")).select("prompt_sha").distinct().withColumn("result", known).write.parquet(path)
    found = providers.classify_chunks(s, chunks, path, b.echo_client, commit_rows=1 << 20)
    return found.select("chunk_id", "strategy", "present", "confidence", "error", "repaired", F.size("evidence_quotes").alias("quotes"), F.size("target_languages").alias("languages"), "notes")


@query
def chunk_strategy_cross(s, d):
    rows = b.chunks(s, d).select("chunk_id", "doc_title").crossJoin(F.broadcast(strategy_table(s)))  # five strategies
    return rows.groupBy("doc_title", "strategy").agg(F.count(F.lit(1)).alias("n"))


@query
def distinct_map_join(s, d):
    """Distinct sentences are mapped once and joined back to every frame."""
    rows = b.frames(s, d).where("syntactic_role = 'patient'").select("chunk_id", "token_idx", F.col("dep_head_lemma").alias("sentence"))
    mapped = rows.select("sentence").distinct().withColumn("mapped", F.upper("sentence"))
    return rows.join(mapped, "sentence").groupBy("sentence", "mapped").agg(F.count(F.lit(1)).alias("n"))


@query
def json_props(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    rows = b.table(s, d, "events").withColumn("k", k)
    return rows.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@query
def tolerant_json_repair(s, d):
    """Replies in four states of repair, made from chunks: whole, fenced, truncated, lost."""
    body = F.concat(
        F.lit('{"strategy_name": "nomination", "present": true, "confidence": 0.8, "evidence_quotes": ["'),
        F.substring(F.regexp_replace("text", "[^a-z ]", ""), 1, 30), F.lit('", "tiny"], "linguistic_devices": [], "target_languages": ["Gaelic"], "notes": "n"}'),
    )
    which = F.pmod(F.col("chunk_id"), F.lit(4))
    reply = (
        F.when(which == 0, body).when(which == 1, F.concat(F.lit("So:\n```json\n"), body, F.lit("\n```")))
        .when(which == 2, F.expr("substring(_b, 1, instr(_b, '\"tiny\"') + 5)")).otherwise(F.lit("no answer"))
    )
    rows = b.chunks(s, d).withColumn("_b", body).withColumn("r", ft.parse_reply(reply))
    return rows.select(
        "chunk_id", F.col("r").isNotNull().alias("parsed"), "r.present", "r.confidence", F.coalesce("r.repaired", F.lit(False)).alias("repaired"),
        F.size("r.evidence_quotes").alias("quotes"),
    )


@query
def topic_clusters(s, d):
    return topics.clusters(b.table(s, d, "embeddings"))


@query
def density_topics(s, d):
    """Vectors by density cluster, -1 for noise."""
    return density.density_clusters(s, b.table(s, d, "embeddings"))


#: Stop words of the topics' terms.
STOP = ("the", "of", "and", "in", "to", "a")


def labelled(s, d):
    """Chunks whose vector has a label other than that of outliers, with label and vector."""
    vectors = b.table(s, d, "embeddings").where("label != 0")
    vectors = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("long").alias("topic_id"), "embedding")
    return b.chunks(s, d).select("chunk_id", "text").join(vectors, "chunk_id")


@query
def topic_terms(s, d):
    """Words and pairs of words of each labelled topic."""
    return topics.ctfidf(labelled(s, d), stop=STOP, grams=2).select("topic_id", "term", "tf", "rank")


@query
def topic_terms_reranked(s, d):
    """The first thirty terms of each labelled topic by likeness to the topic; a term's vector is the mean of the chunks that hold it."""
    docs = written(s, labelled(s, d).withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 1000000).cast("long"))), "labelled")
    found = written(s, topics.ctfidf(docs, 30, stop=STOP, grams=2).select("topic_id", "term"), "terms")
    held = docs.select(F.explode(F.array_distinct(topics.terms_of(F.col("text"), STOP, 2))).alias("term"), F.col("embedding").alias("v"))
    held = held.join(found.select("term").distinct(), "term", "left_semi")
    centre = topics.mean_vectors(docs.select("topic_id", F.col("embedding").alias("v")), "topic_id", "v", 64)
    return topics.reranked(found, topics.mean_vectors(held, "term", "v", 64), centre)


@query
def topic_merges(s, d):
    """Labelled topics merged to four by the likeness of their terms."""
    return topics.merged_topics(s, topics.ctfidf(labelled(s, d), None, stop=STOP), 4)


@query
def vector_projection(s, d):
    return topics.projection(b.table(s, d, "embeddings"))


@query
def hashed_embeddings(s, d):
    rows = providers.hashed_vectors(b.chunks(s, d), 256)
    return rows.select("chunk_id", F.round(topics.norm(F.col("embedding")), 4).alias("norm"))


@query
def event_turning_points(s, d):
    """Days on which the dominant event type changes."""
    days = b.table(s, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    lead = frames.ranked(days, ["day"], "event_type", 1).select("day", F.col("event_type").alias("dominant"), "n")
    from pyspark.sql import Window

    back = F.lag("dominant").over(Window.orderBy("day"))  # one row a day
    out = lead.withColumn("previous", back).where("previous is null or previous != dominant")
    return out.select(F.col("day").cast("string").alias("day"), "dominant", "previous", "n")


@query
def flagged_sentences(s, d):
    """Agentless passives whose sentence holds a term; function words stand for institutions, which the test tables lack."""
    found = frames.flagged_sentences(b.triples(s, d), ["doc_title"], terms=("and", "in"))
    return found.withColumn("terms", F.array_join("terms", ","))


@query
def terms_in_context(s, d):
    """Terms inside each whole text; substrings count."""
    found = frames.terms_in_context(F.col("text"), ("then", "thin", "and", "ore"))
    return b.table(s, d, "documents").select("doc_id", F.array_join(found, ",").alias("terms"))


@query
def topos_ranks(s, d):
    rows = b.classified(s, d).where("present").select("doc_title", "doc_year", "strategy", F.explode("topoi").alias("topos"))
    counts = rows.groupBy("doc_title", "doc_year", "strategy", "topos").agg(F.count(F.lit(1)).alias("n"))
    return frames.ranked(counts, ["doc_title", "doc_year", "strategy"], "topos", 5)


@query
def role_histogram(s, d):
    return frames.histogram(b.frames(s, d), "syntactic_role")


@query
def topic_summary(s, d):
    course = topics.trajectories(topics.topic_frequency(b.assigned(s, d)))
    flag = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    return course.agg(F.count(F.lit(1)).alias("topics"), flag("emerging"), flag("persistent"), flag("declining"))


@query
def targeting_rollup(s, d):
    rows = b.classified(s, d).where("present").select("strategy", "doc_year", F.explode("target_languages").alias("language"))
    return rows.rollup("strategy", "language", "doc_year").agg(F.count(F.lit(1)).alias("n"))


@query
def first_titles(s, d):
    return frames.first_rows(b.chunks(s, d), "doc_year", "chunk_id").select("doc_year", "chunk_id", "doc_title")


@query
def diverging(s, d):
    return plots.diverging(discourse.targeting(b.classified(s, d)))


@query
def streamgraph(s, d):
    counts = discourse.topos_counts(b.classified(s, d), ["doc_year"])
    return plots.streamgraph(counts, list(b.YEARS), [f"topos_of_{t}" for t in b.CUES.topoi]).select("doc_year", "topos", "proportion")


@query
def streamgraph_layers(s, d):
    """The streamgraph's smooth layers with their lowest line."""
    counts = written(s, discourse.topos_counts(b.classified(s, d), ["doc_year"]), "counts")
    names = [f"topos_of_{t}" for t in b.CUES.topoi]
    shares = plots.streamgraph(counts, list(b.YEARS), names).select("doc_year", "topos", "proportion")
    totals = shares.select("topos").distinct().join(counts.groupBy("topos").agg(F.sum("n").alias("n")), "topos", "left").na.fill(0, ["n"])
    return plots.smooth_streamgraph(shares, totals)


@query
def detected_sections(s, d):
    """Sections from a detector of windows that marks short first lines, and fails on windows of a certain length."""
    lines = cleaning.lines_of(b.table(s, d, "documents"))
    found = chunking.detected_sections(s, lines, b.short_lines, "[A-Z][a-z]{1,3}\\s").withColumn("text_md5", F.md5("text"))
    return found.select("doc_id", "section_seq", "section_id", "section_title", "start_line", "end_line", "text_md5")


@query
def vector_layout(s, d):
    return layout.layout(s, b.table(s, d, "embeddings"), epochs=20)


@query
def centrality_shift(s, d):
    values = graph.degrees(graph.edge_weights(b.frames(s, d)))
    return graph.era_centrality_shift(values, ERA_ORDER, "total_degree")


@query
def plot_network(s, d):
    edges = b.edges_once(s, d)
    # the test tables' target terms are function words, so only auxiliaries are stop words here
    stop = frames.pos_stopwords(b.frames(s, d), ("NOUN", "VERB", "ADJ", "ADV", "PROPN", "ADP", "DET"))
    return graph.plot_network(edges, graph.degrees(edges), stop)


@query
def virtual_edges(s, d):
    """Nations with their regions: a component for each region."""
    n, r = b.table(s, d, "nation"), b.table(s, d, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    edges = pairs.select(F.lit("all").alias("era"), F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return graph.virtual_edges(graph.components(s, edges), graph.degrees(edges))


@query
def network_growth(s, d):
    edges = b.edges_once(s, d)
    return graph.growth(edges, graph.pagerank(s, edges, 100, every=2, tolerance=1e-6), graph.betweenness(s, edges))


@query
def topic_heatmap(s, d):
    words = s.createDataFrame([(1, 1, "law"), (1, 2, "act"), (2, 1, "tongue")], "topic_id int, rank int, term string")
    return plots.topic_heatmap(topics.topic_frequency(b.assigned(s, d)), words)


@query
def spaced_labels(s, d):
    return plots.spaced_labels(topics.centroids(b.assigned(s, d), ["topic_id"]), 6.0, 6.0)


@query
def boundary_sections(s, d):
    """Sections from a detector's boundaries: here every line that ends in a full stop after one short word."""
    lines = cleaning.lines_of(b.table(s, d, "documents"))
    found = lines.where(F.col("line").rlike("^[A-Z][a-z]{0,5}[.]")).select("doc_id", "line_no", F.substring("line", 1, 20).alias("title"))
    out = chunking.sections_at(lines, chunking.kept_boundaries(found))
    return out.select("doc_id", "section_seq", "section_id", "start_line", "end_line")


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.sql().items() if k in FOUND}
