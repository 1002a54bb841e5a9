"""The operators bound to the test tables, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import chunkstore, dualtree, huffman, merkle, mixing, multiset, packing, partenum, secrets, sharding, sql, toxicity, url_rules, wrapper
from lexmill.llm.common import table

#: Domains of the mixing tree: sources are dealt to four by their number.
DOMAINS = ("web", "books", "code", "news")
WEIGHTS = {"domain": {"web": 4, "books": 3, "code": 2, "news": 1}, "lang": {"en": 4, "fr": 2, "de": 2, "es": 1}}
BUDGET_PERMILLE, MAX_EPOCHS, SEED = 600, 4, 17


def domain() -> Column:
    number = F.try_to_number(F.regexp_extract("source", "([0-9]{1,6})$", 1), F.lit("999999")).cast("int")
    names = F.array(*[F.lit(x) for x in DOMAINS])
    return F.when(number.isNull(), F.lit("other")).otherwise(F.element_at(names, F.pmod(number, F.lit(len(DOMAINS))) + 1))


def op1_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkstore.media_columns(spark, table(spark, sf_dir, "documents"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(spark, table(spark, sf_dir, "pages"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8, SEED)


def op4_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.components(spark, table(spark, sf_dir, "documents"))


def op5_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(spark, docs, domain(), weights=WEIGHTS, budget_permille=BUDGET_PERMILLE, max_epochs=MAX_EPOCHS, seed=SEED)


def op6_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset.document_fingerprints(spark, table(spark, sf_dir, "documents"))


def op7_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(spark, docs, toxicity.learn(spark, docs, table(spark, sf_dir, "labels")))


def op8_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(spark, table(spark, sf_dir, "pages"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(spark, table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.cluster(spark, table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, table(spark, sf_dir, "documents"))


def op13_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.round_trip(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_media_chunks,
        op2_url_rules,
        op3_feistel_shards,
        op4_partenum_join,
        op5_hierarchical_mix,
        op6_multiset_fingerprints,
        op7_toxicity_fm,
        op8_wrapper_text,
        op9_secret_ledger,
        op10_best_fit,
        op11_dual_tree,
        op12_merkle_manifest,
        op13_huffman_ids,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; the others are tested against brute force."""
    return {
        "op2_url_rules": sql.url_rules(0.01, 0.6, "allow"),
        "op3_feistel_shards": sql.sharding(8, SEED),
        "op4_partenum_join": sql.jaccard(4, 85, 100),
        "op5_hierarchical_mix": sql.mixing(DOMAINS, WEIGHTS, BUDGET_PERMILLE, MAX_EPOCHS, SEED),
        "op9_secret_ledger": sql.secrets(),
        "op11_dual_tree": sql.lloyd(dualtree.DIMS, dualtree.SCALE, dualtree.K, dualtree.ROUNDS),
        "op12_merkle_manifest": sql.manifest(merkle.COLUMNS, merkle.TAMPERED),
    }
