"""A pipeline from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet to the shared folder and read again as the next stage's docs.
All stages but the last return the columns of documents.

1. toxicity: documents that the factorization machine rejects go.
2. near_duplicates: of each group of documents whose five-word shingle sets reach a
   similarity of 0.8, linked in chains too, that of the least id stays, in one row.
3. secrets: spans that the rules find are replaced by a mark; no document goes.
4. mixing: documents are taken to target weights by domain, language and source; a
   document is repeated once for each epoch that takes it.
5. packing: the documents' words are packed into sequences of permitted lengths.

Nulls: a null text is empty, a null id an id of its own; rows without words are no copies
of anything, have no secrets and are never cut by mixing, and packing gives them no
sequence. Labels of null ids or null marks are not learned from; without labels of both
kinds nothing is rejected unless all are toxic. Repeated rows are copies, of which one
stays. Extra columns, also of names that the operators use, are kept up to packing.
An empty table gives an empty result at every stage. Texts are worked on whole.

A factorization machine cannot be expressed in SQL, so there is no SQL for the
whole; the stages are tested one by one against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexmill.llm import mixing, packing, partenum, queries, secrets, toxicity
from lexmill.llm.common import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.learn(spark, docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(spark, docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_one_row(spark, docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(
        spark,
        docs,
        queries.domain(),
        weights=queries.WEIGHTS,
        budget_permille=queries.BUDGET_PERMILLE,
        max_epochs=queries.MAX_EPOCHS,
        seed=queries.SEED,
    )


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
