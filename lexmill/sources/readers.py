"""Readers of the interchange formats: whole texts, JSON lines, CSV, JSON, GraphML, scanned pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text), one row a file."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_lines_grouped(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """(key, rows) with the key's rows as an array."""
    rows = json_lines(spark, path, schema)
    return rows.groupBy(key).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != key])).alias("rows"))


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def embeddings(spark: SparkSession, vectors: str, chunks: str) -> DataFrame:
    """Chunks with their vectors, joined by id rather than by position."""
    return spark.read.parquet(chunks).join(spark.read.parquet(vectors).select("chunk_id", "embedding"), "chunk_id")


def with_meta(docs: DataFrame, meta: DataFrame) -> DataFrame:
    """docs with their metadata by filename; fails on a file that has none."""
    out = docs.join(meta, "filename", "left")
    known = F.col("doc_no").isNotNull()
    return out.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no metadata for "), "filename")).cast("boolean")))


def scanned_pages(spark: SparkSession, path: str, ocr: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, text, error) of PDF files through an OCR provider; pages are joined by a blank line, a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((name, "\n\n".join(ocr(content)), None))
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows.append((name, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string, error string")


PAGE = "path string, page int, pages int, text string, error string"


def ocr_pages(
    spark: SparkSession, path: str, out: str, split: Callable[[bytes], list[bytes]], ocr: Callable[[bytes], str], again: bool = False, glob: str = "*.pdf"
) -> DataFrame:
    """(path, page, pages, text, error) of scanned documents, a row a page, kept in the table `out` and made page by page.

    split: a document to its pages; ocr: a page to its text. Pages of a document are dealt
    to all tasks. Documents whose pages all stand in `out` are not opened again, and of
    others only missing pages are read; with `again` pages that failed are tried anew. A
    document that can't be split is a row of page 0, a page that can't be read one with an error.
    """
    try:
        done = spark.read.parquet(out)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], PAGE)
    kept = done.where("error is null") if again else done
    whole = kept.groupBy("path").agg(F.count_distinct("page").alias("n"), F.max("pages").alias("pages")).where("n >= pages")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    parts = split(content)
                    rows = [(name, i + 1, len(parts), p, None) for i, p in enumerate(parts)] or [(name, 0, 1, None, "no pages")]
                except Exception as e:  # noqa: BLE001  one bad file must not end the job
                    rows = [(name, 0, 1, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "page", "pages", "content", "error"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                text, why = None, r.error
                if why is None:
                    try:
                        text = ocr(r.content)
                    except Exception as e:  # noqa: BLE001
                        why = f"{type(e).__name__}: {e}"
                rows.append((r.path, r.page, r.pages, text, why))
            yield pd.DataFrame(rows, columns=["path", "page", "pages", "text", "error"])

    pages = files.join(whole.select("path"), "path", "left_anti").mapInPandas(opened, "path string, page int, pages int, content binary, error string")
    todo = pages.join(kept.select("path", "page"), ["path", "page"], "left_anti").repartition("path", "page")
    todo.mapInPandas(read, PAGE).write.mode("append").parquet(out)
    every = spark.read.schema(PAGE).parquet(out)
    # the last try of a page counts: a text before an error
    return every.groupBy("path", "page").agg(F.max("pages").alias("pages"), F.max("text").alias("text"), F.max("error").alias("error")).withColumn(
        "error", F.when(F.col("text").isNull(), F.col("error"))
    )


def whole_documents(pages: DataFrame) -> DataFrame:
    """(path, text, errors) of ocr_pages(): pages in order, joined by a blank line; errors counts the pages without a text."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("page", "text"))))
    joined = F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    return pages.groupBy("path").agg(joined.alias("text"), F.count_if(F.col("text").isNull()).alias("errors"))


#: A start tag without its end, as far as attributes go.
INSIDE_TAG = """(?:[^>"']|"[^"]*"|'[^']*')*"""


def elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """(file, e): every element of a tag in XML files, by Spark's splits: a large file is read by many tasks.

    The text is cut where the tag starts; a piece is one element and what follows up to
    the next. The tag must not stand in comments or CDATA sections. Elements may not be nested.
    """
    # a folder file=NAME names the part files in it
    folder, name = F.regexp_extract(F.input_file_name(), "/file=([^/]*)/[^/]*$", 1), F.element_at(F.split(F.input_file_name(), "/"), -1)
    rows = spark.read.text(path, lineSep=f"<{tag}").select(F.when(folder != "", folder).otherwise(name).alias("file"), "value")
    # attributes follow white space; a piece that starts otherwise is the file's head, or a longer tag's
    whole = F.regexp_extract("value", f"(?s)\\A(\\s(?:{INSIDE_TAG}/>|{INSIDE_TAG}>.*?</{tag}>))", 1)
    rows = rows.select("file", whole.alias("_x")).where("_x != ''")
    return rows.select("file", F.from_xml(F.concat(F.lit(f"<{tag}"), "_x"), schema, {"ignoreSurroundingSpaces": "false"}).alias("e"))


#: Files whose keys are sent to every task; those of more files are joined by a shuffle.
BROADCAST_FILES = 10_000
DATA = "data array<struct<_VALUE: string, _key: string>>"


def graphml_keys(spark: SparkSession, path: str) -> DataFrame:
    """(file, names): names of the data keys of each GraphML file by their ids."""
    rows = elements(spark, path, "key", "`_id` string, `_attr.name` string")
    return rows.groupBy("file").agg(F.map_from_entries(F.collect_set(F.struct("e._id", F.col("e")["_attr.name"]))).alias("names"))


def with_data(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows with `data`, a map of their data elements by name (by id where the file names none)."""
    named = F.transform(F.coalesce("e.data", F.array()), lambda d: F.struct(F.coalesce(F.try_element_at("names", d["_key"]), d["_key"]), d["_VALUE"]))
    # one row a file: joined where rows are read, unless there are very many files
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_FILES else keys
    return rows.join(keys, "file", "left").withColumn("data", F.map_from_entries(named)).drop("names")


def graphml_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(file, node, data) of GraphML files, data by name."""
    rows = with_data(elements(spark, path, "node", f"_id string, {DATA}"), graphml_keys(spark, path))
    return rows.select("file", F.col("e._id").alias("node"), "data")


def graphml(spark: SparkSession, path: str) -> DataFrame:
    """(file, src, dst, weight, relations) of GraphML files; an edge without a weight weighs 1."""
    rows = with_data(elements(spark, path, "edge", f"_source string, _target string, {DATA}"), graphml_keys(spark, path))
    weight = F.coalesce(F.try_element_at("data", F.lit("weight")).try_cast("double"), F.lit(1.0))
    return rows.select("file", F.col("e._source").alias("src"), F.col("e._target").alias("dst"), weight.alias("weight"), F.try_element_at("data", F.lit("relations")).alias("relations"))
