"""Sections and token-budgeted chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.dims import MAX_CHUNK_TOKENS, OVERLAP_TOKENS, PREFIX_TOKENS
from lexmill.functions.text import sentences, strip
from lexmill.storage import ship, written

BUDGET = MAX_CHUNK_TOKENS - PREFIX_TOKENS


def section_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """lines with section_seq, section_id and whether the line opens the section.

    A line whose stripped form matches at its start opens a section; non-blank text
    before the first one opens a preamble.
    """
    stripped = strip(F.col("line"))
    mark = F.regexp_extract(stripped, "\\A(?:" + pattern + ")", 0)
    opens = stripped.rlike("\\A(?:" + pattern + ")")
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    staged = lines.withColumns({"_s": stripped, "_hit": opens, "_mark": strip(mark)})
    nothing = (F.coalesce(F.max((F.col("_hit") | (F.col("_s") != "")).cast("int")).over(before), F.lit(0)) == 0)
    staged = staged.withColumn("_open", F.col("_hit") | ((F.col("_s") != "") & nothing))
    staged = staged.withColumn("section_seq", F.sum(F.col("_open").cast("int")).over(upto))
    staged = staged.withColumn("_next", F.lead("_s").over(Window.partitionBy("doc_id").orderBy("line_no")))
    return staged.where("section_seq > 0")


def sections(lines: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, section_seq, section_id, section_title, start_line, end_line, text).

    Texts are stripped, and sections without any left out; a document without sections is one section, full.
    """
    staged = section_lines(lines, pattern)
    rest = strip(F.substring(F.col("_s"), F.length("_mark") + 1, F.length("_s")))
    title = F.when(F.col("_hit"), F.coalesce(F.nullif(rest, F.lit("")), F.nullif(F.col("_next"), F.lit("")), F.col("_mark")))
    title = F.substring(F.coalesce(title, F.lit("Preamble")), 1, 100)
    name = F.when(F.col("_hit"), F.col("_mark")).otherwise(F.lit("preamble"))
    head = staged.withColumns({"_title": F.when(F.col("_open"), title), "_name": F.when(F.col("_open"), name)})
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    found = head.groupBy("doc_id", "section_seq").agg(
        F.max("_name").alias("section_id"),
        F.max("_title").alias("section_title"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        strip(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).alias("text"),
    )
    found = found.where("text != ''")
    # a document without a line that opens a section is blank throughout
    opened = F.max((strip(F.col("line")) != "").cast("int")).alias("_any")
    blank = lines.groupBy("doc_id").agg(opened, F.max("line_no").alias("end_line")).where("_any = 0")
    full = blank.select(
        "doc_id", F.lit(1).cast("long").alias("section_seq"), F.lit("full").alias("section_id"), F.lit("Full Document").alias("section_title"),
        F.lit(0).alias("start_line"), "end_line", F.lit("").alias("text"),
    )
    return found.unionByName(full)


def token_count(text: Column) -> Column:
    """The default tokeniser: words and single punctuation marks."""
    return F.size(F.regexp_extract_all(text, F.lit("(?U)\\w+|[^\\w\\s]"), F.lit(0)))


def pack(units: list[tuple[str, int]], most: int, overlap: int) -> list[list[tuple[str, int]]]:
    """Greedy packing in order; each pack starts with the longest suffix of the last that fits in overlap."""
    out: list[list[tuple[str, int]]] = []
    held: list[tuple[str, int]] = []
    size = 0
    for unit in units:
        if held and size + unit[1] > most:
            out.append(held)
            kept, kept_size = [], 0
            for back in reversed(held):
                if kept_size + back[1] > overlap:
                    break
                kept.insert(0, back)
                kept_size += back[1]
            held, size = kept, kept_size
        held = [*held, unit]
        size += unit[1]
    if held:
        out.append(held)
    return out


def chunk_texts(parts: list[tuple[str, int]], most: int, overlap: int, count) -> list[str]:
    """Chunks of a section from its (sentence, tokens); a sentence beyond the budget is packed by words, alone."""
    out: list[str] = []
    run: list[tuple[str, int]] = []
    for sentence in parts:
        if sentence[1] <= most:
            run.append(sentence)
            continue
        out += [" ".join(s for s, _ in p) for p in pack(run, most, overlap)]
        run = []
        out += [" ".join(w for w, _ in p) for p in pack([(w, count(w)) for w in sentence[0].split()], most, overlap)]
    return out + [" ".join(s for s, _ in p) for p in pack(run, most, overlap)]


def chunk_sections(found: DataFrame, most: int = BUDGET, overlap: int = OVERLAP_TOKENS, count: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, section_seq, section_id, chunk_no, text, token_count); a section within the budget stays whole.

    A section is a row, so chunks are cut row by row in Arrow batches without a shuffle.
    count: tokens of a text, such as subwords.counter() of a vocabulary; words and
    punctuation marks without it, whose first counts stay in expressions.
    """
    kind = found.schema["doc_id"].dataType.simpleString()
    counted = (lambda c: F.lit(0)) if count is not None else token_count
    staged = found.withColumn("_whole", counted(F.col("text"))).withColumn(
        "_parts", F.transform(sentences(F.col("text")), lambda s: F.struct(s.alias("s"), counted(s).alias("n")))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        token = re.compile(r"\w+|[^\w\s]")
        tokens = count or (lambda t: len(token.findall(t)))
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if (r[4] if count is None else count(r[3])) <= most:
                    texts = [r[3]]
                else:
                    texts = chunk_texts([(p["s"], p["n"] if count is None else count(p["s"])) for p in r[5]], most, overlap, tokens)
                rows += [(r[0], r[1], r[2], i, t, tokens(t)) for i, t in enumerate(texts)]
            yield pd.DataFrame(rows, columns=["doc_id", "section_seq", "section_id", "chunk_no", "text", "token_count"])

    staged = staged.select("doc_id", "section_seq", "section_id", "text", "_whole", "_parts")
    return staged.mapInPandas(run, f"doc_id {kind}, section_seq long, section_id string, chunk_no int, text string, token_count int")


def assemble(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Chunks with their label, a unique key, prefix, and the number of chunks that share (document, section id).

    meta: doc_id, doc_no, doc_title, doc_year; a document that is not in it has the number 0 and no title.
    """
    inside = Window.partitionBy("doc_id", "section_id")
    label = F.concat(
        F.lit("doc"),
        F.format_string("%02d", F.coalesce("doc_no", F.lit(0)).cast("long")),
        F.lit("_"),
        F.regexp_replace("section_id", "[^a-zA-Z0-9_.-]", "_"),
        F.lit("_"),
        F.format_string("%03d", F.col("chunk_no").cast("long")),
    )
    prefix = F.concat(
        F.lit("[DOC: "), F.coalesce("doc_title", F.lit("")), F.lit(" ("), F.coalesce(F.col("doc_year").cast("string"), F.lit("")), F.lit(") | SEC: "), F.col("section_id"), F.lit("] ")
    )
    return chunks.join(meta, "doc_id", "left").select(
        label.alias("chunk_id"),
        F.concat_ws(":", F.col("doc_id").cast("string"), "section_seq", "chunk_no").alias("chunk_key"),
        "doc_id",
        "doc_title",
        "doc_year",
        "section_id",
        F.col("chunk_no").alias("chunk_index"),
        F.count(F.lit(1)).over(inside).alias("total_chunks_in_section"),
        "text",
        F.concat(prefix, "text").alias("text_with_prefix"),
        "token_count",
    )


def window_texts(lines: DataFrame, size: int = 60) -> DataFrame:
    """(doc_id, window, text): tumbling windows of lines, each line with its number, for a section detector."""
    rows = lines.withColumn("window", F.floor(F.col("line_no") / size))
    numbered = F.struct("line_no", F.concat(F.col("line_no").cast("string"), F.lit(": "), "line").alias("l"))
    ordered = F.transform(F.array_sort(F.collect_list(numbered)), lambda x: x["l"])
    return rows.groupBy("doc_id", "window").agg(F.array_join(ordered, "\n").alias("text"))


def kept_boundaries(found: DataFrame, apart: int = 3) -> DataFrame:
    """A detector's boundaries (doc_id, line_no, title) without those less than `apart` lines after the last one kept."""
    rows = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("line_no", "title"))).alias("b"))
    fold = (
        f"aggregate(b, cast(array() as array<struct<line_no:int,title:string>>), (kept, x) -> "
        f"if(size(kept) = 0 or x.line_no - element_at(kept, -1).line_no >= {apart}, concat(kept, array(x)), kept))"
    )
    return rows.select("doc_id", F.explode(F.expr(fold)).alias("k")).select("doc_id", "k.line_no", "k.title")


def sections_at(lines: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Sections between boundaries; lines before the first one are left out."""
    marked = lines.join(boundaries.select("doc_id", "line_no", F.col("title").alias("_t")), ["doc_id", "line_no"], "left")
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section_seq", F.count("_t").over(upto)).where("section_seq > 0")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return marked.groupBy("doc_id", "section_seq").agg(
        F.max("_t").alias("section_id"),
        F.substring(F.max("_t"), 1, 100).alias("section_title"),
        F.min("line_no").alias("start_line"),
        F.max("line_no").alias("end_line"),
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"),
    )


def reply_boundaries(replies: DataFrame) -> DataFrame:
    """(doc_id, line_no, section_id, title) that a detector names in its replies (doc_id, reply): JSON objects, one a line; other lines are passed over."""
    line = replies.select("doc_id", F.explode(F.split("reply", "\n")).alias("_l")).withColumn("_l", strip(F.col("_l"))).where(F.col("_l").startswith("{"))
    found = line.select("doc_id", F.from_json("_l", "line_num string, section_id string, title string").alias("b"))
    number = F.col("b.line_num").try_cast("double").try_cast("int")
    return found.where(number.isNotNull()).select("doc_id", number.alias("line_no"), F.col("b.section_id").alias("section_id"), F.col("b.title").alias("title"))


def detected_sections(spark: SparkSession, lines: DataFrame, detector: Callable[[str], str | None], pattern: str, size: int = 60, apart: int = 3) -> DataFrame:
    """Sections as sections() gives them, at the boundaries that a detector finds in windows of `size` numbered lines.

    The detector is asked once for each window, in the tasks that hold them; its replies
    are written. A document goes by the pattern instead if the detector fails on one of
    its windows (raises, or answers null) or finds no boundary in any.
    """
    ship(spark)
    kind = lines.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for text in batch["text"]:
                try:
                    replies.append(detector(text))
                except Exception:  # noqa: BLE001  a failure sends the document to the patterns
                    replies.append(None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "reply": pd.Series(replies, dtype=object, index=batch.index)})

    replies = written(spark, window_texts(lines, size).select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, reply string"), "replies")
    found = reply_boundaries(replies).join(replies.where("reply is null").select("doc_id").distinct(), "doc_id", "left_anti")
    last = lines.groupBy("doc_id").agg(F.max("line_no").alias("_last"))
    found = found.join(last, "doc_id").where("line_no between 0 and _last").drop("_last")
    # the first of several on one line; names of their own travel as the kept boundary's title
    named = F.to_json(F.struct(F.col("section_id").alias("i"), F.col("title").alias("t")))
    first = found.groupBy("doc_id", "line_no").agg(F.min(named).alias("title"))
    kept = written(spark, kept_boundaries(first, apart), "boundaries")
    at = sections_at(lines, kept).withColumn("_n", F.from_json("section_id", "i string, t string")).withColumn("text", strip(F.col("text")))
    number = F.col("section_seq").cast("string")
    at = at.where("text != ''").select(
        "doc_id", "section_seq", F.coalesce("_n.i", F.concat(F.lit("sec_"), number)).alias("section_id"),
        F.coalesce("_n.t", F.concat(F.lit("Section "), number)).alias("section_title"), "start_line", "end_line", "text",
    )
    rest = lines.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
    return at.unionByName(sections(rest, pattern))
