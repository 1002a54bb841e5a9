"""The analysis phases as functions: each reads tables, writes tables below an output folder, and returns a summary.

A stage is skipped if its table exists and was made from the same input under the
same settings: a fingerprint of both stands beside it. `force` makes it anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.dims import ERAS, TARGET_TERMS, era_table, strategy_table
from lexmill.operators import chunking, cleaning, density, discourse, frames, graph, layout, plots, providers, topics
from lexmill.operators.providers import Cues, Lexicon
from lexmill.sources import writers
from lexmill.storage import written


def fingerprint(df: DataFrame, **settings) -> str:
    """Of a table's rows, whatever their order, and of settings."""
    row = F.xxhash64(F.to_json(F.struct(*df.columns)))
    total = df.agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return hashlib.sha256(json.dumps([str(x) for x in total] + [settings], sort_keys=True, default=str).encode()).hexdigest()


def stage(spark: SparkSession, out_dir: str, name: str, mark: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table `name`, made anew unless it stands there with the same fingerprint."""
    path, note = f"{out_dir}/{name}", f"{out_dir}/{name}.mark"
    if not force:
        try:
            if spark.read.text(note).first()[0] == mark:
                return spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    make().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(note)
    return spark.read.parquet(path)


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at path; None where there is none."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


#: Titles up to which a summary names each; the table beside it always holds all.
SHOWN = 1000


def index_of(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a vector stands for: its chunk's place in the corpus, its length and whether it is all zero."""
    sizes = vectors.select("chunk_id", F.size("embedding").alias("dimensions"), (topics.norm(F.col("embedding")) == 0).alias("is_zero"))
    return chunks.select("chunk_id", "doc_title", "doc_year", "section_id", "chunk_index", "token_count").join(sizes, "chunk_id")


def write_artefacts(spark: SparkSession, out_dir: str, names: list[str]) -> None:
    """Tables of a phase as JSON lines (out_dir/json) and, with lists as value|value and structures as JSON, as CSV (out_dir/csv)."""
    for name in names:
        df = spark.read.parquet(f"{out_dir}/{name}")
        writers.json_lines(df, f"{out_dir}/json/{name}")
        flat = []
        for field in df.schema:
            c, kind = F.col(field.name), field.dataType.simpleString()
            flat.append((F.array_join(c, "|") if kind == "array<string>" else F.to_json(c) if kind.startswith(("array", "struct", "map")) else c).alias(field.name))
        writers.csv_table(df.select(*flat), f"{out_dir}/csv/{name}")


def run_phase1(
    spark: SparkSession, docs: DataFrame, meta: DataFrame, out_dir: str, section_pattern: str = "\\d+\\.\\s", boilerplate: tuple[str, ...] = (),
    contents_lines: int | None = None, force: bool = False, encoder: Callable | None = None, detector: Callable[[str], str | None] | None = None,
    count: Callable[[str], int] | None = None, skip_embeddings: bool = False, artefacts: bool = False, model: str = "",
) -> dict:
    """Texts to cleaned texts, chunks and vectors. docs: doc_id, text; meta: doc_id, doc_no, doc_title, doc_year.

    encoder: see providers.encoded(); hashed term counts without one. detector: see
    chunking.detected_sections(); the pattern alone without one. count: tokens of a text.
    `model` names the three, so that tables are made anew when they change. With
    `artefacts` chunks and the vectors' index are written as JSON lines too.
    """
    hooks = [model, *(x is not None for x in (encoder, detector, count))] if model or encoder or detector or count else None
    mark = fingerprint(docs, pattern=section_pattern, boilerplate=boilerplate, contents=contents_lines, meta=fingerprint(meta), hooks=hooks)
    cleaned = stage(spark, out_dir, "cleaned", mark, lambda: cleaning.clean_documents(docs, boilerplate, contents_lines), force)

    def chunked() -> DataFrame:
        lines = cleaning.lines_of(cleaned)
        found = chunking.sections(lines, section_pattern) if detector is None else chunking.detected_sections(spark, lines, detector, section_pattern)
        return chunking.assemble(chunking.chunk_sections(found, count=count), meta)

    chunks = stage(spark, out_dir, "chunks", mark, chunked, force)
    by_doc = stage(spark, out_dir, "chunks_per_doc", mark, lambda: chunks.groupBy("doc_title").agg(F.count(F.lit(1)).alias("chunks")), force)
    keyed = chunks.drop("chunk_id").withColumnRenamed("chunk_key", "chunk_id")

    def vectors_of() -> DataFrame:
        return providers.hashed_vectors(keyed.select("chunk_id", "text")) if encoder is None else providers.encoded(keyed, encoder)

    n_vectors = 0
    if not skip_embeddings:
        vectors = stage(spark, out_dir, "embeddings", mark, vectors_of, force)
        index = stage(spark, out_dir, "embeddings_index", mark, lambda: index_of(vectors, keyed), force)
        n_vectors = index.count()
        if artefacts:
            write_artefacts(spark, out_dir, ["embeddings_index"])
    if artefacts:
        write_artefacts(spark, out_dir, ["chunks", "chunks_per_doc"])
    total = chunks.agg(F.count(F.lit(1)), F.sum("token_count")).first()
    n, tokens = total[0], total[1] or 0
    # the table chunks_per_doc holds every title; a summary shows those of a small corpus
    shown = {r[0]: r[1] for r in by_doc.collect()} if by_doc.limit(SHOWN + 1).count() <= SHOWN else {}
    return {"chunks": n, "tokens": tokens, "avg_tokens": tokens / n if n else 0, "chunks_per_doc": shown, "vectors": n_vectors}


def run_phase2(
    spark: SparkSession, chunks: DataFrame, vectors: DataFrame, out_dir: str, lexicon: Lexicon | None = None, topics_k: int = 10, skip_topics: bool = False,
    skip_frames: bool = False, skip_networks: bool = False, force: bool = False, by_density: bool = False, merge_to: int | None = None, stop: tuple[str, ...] = (),
    grams: int = 1, artefacts: bool = False, between: bool = False,
) -> dict:
    """Topics, frames and networks by era. chunks: chunk_id, doc_title, doc_year, era, text.

    With `by_density` topics are density clusters of a five-dimensional layout, with noise;
    merge_to: topics left after like ones are merged. `artefacts`: tables as JSON lines and
    CSV too, and networks as GraphML. `between`: betweenness, and how networks grow.
    """
    lexicon = lexicon or Lexicon({t.lower(): t for t in TARGET_TERMS})
    mark = fingerprint(chunks, terms=sorted(lexicon.languages.items()), k=topics_k, vectors=fingerprint(vectors), **({"density": by_density, "merge": merge_to} if by_density or merge_to else {}))
    out: dict = {}
    made: list[str] = []
    if not skip_topics:
        found = stage(spark, out_dir, "topics", mark, lambda: topics_of(spark, chunks, vectors, topics_k, by_density, merge_to, stop, grams), force)
        assigned = chunks.join(found.withColumnRenamed("vec_id", "chunk_id"), "chunk_id")
        made += ["topics", "topics_over_time", "topic_trajectories", "topic_words", "topic_terms_reranked"]
        frequency = stage(spark, out_dir, "topics_over_time", mark, lambda: topics.topic_frequency(assigned), force)
        course = stage(spark, out_dir, "topic_trajectories", mark, lambda: topics.trajectories(frequency), force)
        stage(spark, out_dir, "topic_words", mark, lambda: topics.ctfidf(assigned.where("topic_id != -1"), stop=stop, grams=grams), force)
        stage(spark, out_dir, "topic_terms_reranked", mark, lambda: reranked_terms(spark, assigned, vectors, stop, grams), force)
        flags = course.agg(F.count(F.lit(1)), F.sum(F.col("emerging").cast("int")), F.sum(F.col("persistent").cast("int"))).first()
        out |= {"topics": flags[0], "emerging": flags[1] or 0, "persistent": flags[2] or 0}
    if not skip_frames:
        got = stage(spark, out_dir, "frames", mark, lambda: providers.lexical_frames(chunks, lexicon), force)
        stage(spark, out_dir, "agency_summary", mark, lambda: frames.agency_summary(got), force)
        stage(spark, out_dir, "predicate_inventory", mark, lambda: frames.inventory_top(got, ["target_term", "doc_year"]), force)
        out["frames"] = got.count()
        if not skip_networks:
            edges = stage(spark, out_dir, "edges", mark, lambda: graph.edge_weights(got), force)
            stage(spark, out_dir, "degrees", mark, lambda: graph.degrees(edges), force)
            stage(spark, out_dir, "pagerank", mark, lambda: graph.pagerank(spark, edges, 100, every=2, tolerance=1e-6), force)
            stage(spark, out_dir, "emerging_edges", mark, lambda: graph.emerging_edges(edges, sorted(ERAS)), force)
            ranks = spark.read.parquet(f"{out_dir}/pagerank")
            places = stage(spark, out_dir, "centrality_table", mark, lambda: graph.centrality_table(edges, ranks), force)
            stage(spark, out_dir, "network_comparison", mark, lambda: graph.era_centrality_shift(ranks, list(ERAS), "pagerank"), force)
            out["edges"] = edges.count()
            made += ["edges", "degrees", "pagerank", "emerging_edges", "centrality_table", "network_comparison"]
            if between:
                middle = stage(spark, out_dir, "betweenness", mark, lambda: graph.betweenness(spark, edges), force)
                stage(spark, out_dir, "network_growth", mark, lambda: graph.growth(edges, ranks, middle), force)
                made += ["betweenness", "network_growth"]
            if artefacts:
                writers.graphml_files(edges, f"{out_dir}/graphml", places.select("era", "node", "total_degree", "pagerank"))
        made += ["agency_summary", "predicate_inventory"]
    if artefacts:
        write_artefacts(spark, out_dir, made)
    return out


def topics_of(
    spark: SparkSession, chunks: DataFrame, vectors: DataFrame, k: int, by_density: bool, merge_to: int | None, stop: tuple[str, ...], grams: int
) -> DataFrame:
    """(vec_id, topic_id) of every vector."""
    rows = vectors.withColumnRenamed("chunk_id", "vec_id")
    if by_density:
        flat = layout.layout(spark, rows, size=5)
        flat = written(spark, flat.select("vec_id", F.when(F.col("x0").isNotNull(), F.array(*[f"x{i}" for i in range(5)])).alias("embedding")), "layout")
        found = written(spark, density.density_clusters(spark, flat), "topics")
    else:
        found = topics.clusters(rows, k)
    if merge_to is None:
        return found
    found = written(spark, found.select("vec_id", F.col("topic_id").cast("long").alias("topic_id")), "topics")
    texts = chunks.select(F.col("chunk_id").alias("vec_id"), "text").join(found.where("topic_id != -1"), "vec_id")
    merged = topics.merged_topics(spark, topics.ctfidf(texts, None, stop=stop, grams=grams), merge_to)
    out = found.join(merged, "topic_id", "left").select("vec_id", F.coalesce("merged_id", "topic_id").cast("int").alias("topic_id"))
    return out


def reranked_terms(spark: SparkSession, assigned: DataFrame, vectors: DataFrame, stop: tuple[str, ...], grams: int) -> DataFrame:
    """Each topic's first thirty terms by likeness to the topic; a term's vector is the mean of the chunks that hold it."""
    rows = assigned.where("topic_id != -1").select("chunk_id", "topic_id", "text").join(vectors, "chunk_id")
    size = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    found = written(spark, topics.ctfidf(rows, 30, stop=stop, grams=grams).select("topic_id", "term"), "terms")
    held = rows.select(F.explode(F.array_distinct(topics.terms_of(F.col("text"), stop, grams))).alias("term"), F.col("embedding").alias("v"))
    means = topics.mean_vectors(held.join(found.select("term").distinct(), "term", "left_semi"), "term", "v", size)
    return topics.reranked(found, means, topics.mean_vectors(rows.select("topic_id", F.col("embedding").alias("v")), "topic_id", "v", size))


def run_phase3(
    spark: SparkSession, chunks: DataFrame, out_dir: str, cues: Cues, lexicon: Lexicon, sample: int | None = None, skip_classification: bool = False,
    skip_aggregation: bool = False, force: bool = False, client: Callable[[str], str | None] | None = None, lines: DataFrame | None = None, pause: float = 1.0,
) -> dict:
    """Strategies of every chunk, and their profiles; `sample`: so many chunks of the least id.

    Without a client the default classifier counts cues. A client is asked for each chunk
    and strategy, with the frames of `lines` (chunk_id, frames) in the prompt, behind the
    cache in out_dir/api_cache, which `force` empties; records with errors are asked again by the next run.
    """
    rows = chunks if sample is None else chunks.orderBy("chunk_id").limit(sample)
    mark = fingerprint(rows, strategies=cues.strategies, topoi=cues.topoi, least=cues.least)
    if client is not None and not skip_classification:
        path = f"{out_dir}/api_cache"
        asked = fingerprint(providers.prompt_keys(rows, lines).select("chunk_id", "strategy", "prompt_sha"))
        old = existing(spark, f"{out_dir}/classifications")
        failed = old is not None and "error" in old.columns and old.where("error").limit(1).count() > 0

        def answers() -> DataFrame:
            if force:
                providers.cached(spark, path).limit(0).write.mode("overwrite").parquet(path)
            return providers.classify_chunks(spark, rows, path, client, lines, pause=pause)

        found = stage(spark, out_dir, "classifications", asked, answers, force or failed)
        mark = fingerprint(found)
    elif skip_classification:
        found = spark.read.parquet(f"{out_dir}/classifications")
    else:
        found = stage(spark, out_dir, "classifications", mark, lambda: providers.cue_classifications(rows, cues, lexicon), force)
    if not skip_aggregation:
        stage(spark, out_dir, "strategy_summary", mark, lambda: discourse.strategy_summary(found), force)
        stage(spark, out_dir, "strategy_devices", mark, lambda: discourse.device_ranks(found), force)
    counts = {r[0]: r[1] for r in found.where("present").groupBy("strategy").count().toLocalIterator()}
    return {"rows": found.count(), "present": counts, "strategies": strategy_table(spark).count()}


def run_deep_analysis(
    spark: SparkSession, found: DataFrame, classified: DataFrame, triples: DataFrame | None, out_dir: str, skip_svo: bool = False, skip_identity: bool = False,
    skip_markedness: bool = False, force: bool = False,
) -> dict:
    """Identity, markedness and agent analyses from frames, classifications and triples."""
    mark = fingerprint(classified, frames=fingerprint(found), triples=None if triples is None else fingerprint(triples))
    done = []
    if not skip_identity:
        for name, make in (
            ("topos_trajectory", discourse.topos_trajectory), ("turning_points", discourse.turning_points), ("identity_timeline", discourse.identity_timeline),
            ("topos_language_matrix", discourse.topos_language_matrix),
        ):
            stage(spark, out_dir, name, mark, lambda make=make: make(classified), force)
            done.append(name)
    if not skip_markedness:
        mentions = found.withColumnRenamed("target_language", "language").where("language is not null")
        targets = discourse.targeting(classified)
        for name, df in (
            ("markedness", discourse.markedness_rollup(mentions, era_table(spark))), ("targeting", targets), ("asymmetry", discourse.asymmetry(targets)),
            ("protection_density", discourse.protection_density(mentions, classified)), ("diverging", plots.diverging(targets)),
        ):
            stage(spark, out_dir, name, mark, lambda df=df: df, force)
            done.append(name)
    if not skip_svo:
        if triples is None:
            raise ValueError("triples are needed unless they are skipped")
        for name, df in (
            ("power_triangle", frames.power_triangle(triples)), ("backgrounding", frames.backgrounding(triples, ["doc_title"])), ("flows", frames.flow_counts(triples)),
        ):
            stage(spark, out_dir, name, mark, lambda df=df: df, force)
            done.append(name)
    return {"tables": done}


def run_profiles(
    spark: SparkSession, chunks: DataFrame, found: DataFrame, classified: DataFrame, out_dir: str, triples: DataFrame | None = None, force: bool = False,
    artefacts: bool = False,
) -> dict:
    """Profiles beside the analyses: of titles, topoi by level, evidence, markedness and, with triples, power.

    found: frames with target_language; chunks: chunk_id, doc_title, doc_year, jurisdiction, text.
    Evidence needs quotes, so it is written only where classified has evidence_quotes.
    """
    mark = fingerprint(classified, frames=fingerprint(found), chunks=fingerprint(chunks), triples=None if triples is None else fingerprint(triples))
    mentions = found.withColumnRenamed("target_language", "language").where("language is not null").select("doc_title", "chunk_id", "era", "language")
    make = {
        "titled_profiles": lambda: discourse.titled_profiles(classified, discourse.document_info(chunks)),
        "topos_levels": lambda: discourse.topos_levels(classified, era_table(spark)),
        "markedness_density": lambda: discourse.markedness_density(mentions, classified),
        "markedness_profile": lambda: discourse.markedness_profile(mentions, classified),
    }
    if "evidence_quotes" in classified.columns:
        make["identity_evidence"] = lambda: discourse.identity_evidence(classified)
    if triples is not None:
        make["power_profiles"] = lambda: frames.power_profiles(triples, era_table(spark))
        make["agency_flags"] = lambda: frames.flagged_sentences(triples, ["doc_title"])
    for name, of in make.items():
        stage(spark, out_dir, name, mark, of, force)
    if artefacts:
        write_artefacts(spark, out_dir, list(make))
    return {"tables": list(make)}


def run_phase4(spark: SparkSession, phase2_dir: str, out_dir: str, force: bool = False) -> dict:
    """Tables behind the figures, from phase 2's tables."""
    read = lambda name: spark.read.parquet(f"{phase2_dir}/{name}")
    edges = read("edges")
    mark = fingerprint(edges, **{name: fingerprint(read(name)) for name in ("frames", "degrees", "pagerank", "topics_over_time", "topic_words")})
    scores = read("degrees")
    stop = frames.pos_stopwords(read("frames"))
    heat = stage(spark, out_dir, "topic_heatmap", mark, lambda: plots.topic_heatmap(read("topics_over_time"), read("topic_words")), force)
    net = stage(spark, out_dir, "network", mark, lambda: graph.plot_network(edges, scores, stop), force)
    grown = stage(spark, out_dir, "network_growth", mark, lambda: graph.growth(edges, read("pagerank"), graph.betweenness(spark, edges)), force)
    agency = stage(spark, out_dir, "agency", mark, lambda: frames.weighted_agency(read("frames"), ["target_language", "era"]), force)
    return {"topic_heatmap": heat.count(), "network": net.count(), "network_growth": grown.count(), "agency": agency.count()}
