"""Line-level cleaning of documents: filters and slices over (doc_id, line_no, line).

Every operator keeps line_no as an order key, not as a gapless number; positional
operators number the lines that are left. All of a document's lines meet only in
windows over the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.dims import AMENDMENT_LINES, AMENDMENT_NOTES, AMENDMENT_OPENER, GOVERNMENT_HEADERS, GOVERNMENT_STARTS, PUBLISHER_LINES
from lexmill.functions.text import fix_ocr, normalize_space, rejoin_hyphens, strip

TAIL_LINES = 40


def any_match(c: Column, patterns: tuple[str, ...] | list[str]) -> Column:
    """True where a pattern matches at the start."""
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike("\\A(?:" + p + ")")
    return out


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n", -1)).alias("line_no", "line"))


def drop_boilerplate(lines: DataFrame, patterns: list[str] | tuple[str, ...]) -> DataFrame:
    return lines.where(~any_match(F.col("line"), patterns)) if patterns else lines


def drop_contents(lines: DataFrame, first_lines: Column | int | None) -> DataFrame:
    """Without the first lines of each document, counted over the lines that are left."""
    if first_lines is None:
        return lines
    n = first_lines if isinstance(first_lines, Column) else F.lit(first_lines)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.withColumn("_place", place).where(F.col("_place") > F.coalesce(n, F.lit(0))).drop("_place")


def drop_publisher_tail(lines: DataFrame, patterns: tuple[str, ...] = PUBLISHER_LINES) -> DataFrame:
    """Cut each document at the earliest publisher line among its last ones, with the blanks before it.

    The first line of a document is never tested.
    """
    doc = Window.partitionBy("doc_id")
    staged = lines.withColumns(
        {
            "_at": F.row_number().over(doc.orderBy("line_no")) - 1,
            "_n": F.count(F.lit(1)).over(doc),
        }
    )
    hit = any_match(strip(F.col("line")), patterns) & (F.col("_at") > F.greatest(F.col("_n") - TAIL_LINES, F.lit(0)))
    staged = staged.withColumn("_cut", F.coalesce(F.min(F.when(hit, F.col("_at"))).over(doc), F.col("_n")))
    filled = F.when((strip(F.col("line")) != "") & (F.col("_at") < F.col("_cut")), F.col("_at"))
    staged = staged.withColumn("_last", F.max(filled).over(doc))
    cut = F.col("_cut") < F.col("_n")
    return staged.where(~cut | (F.col("_at") <= F.coalesce("_last", F.lit(-1)))).select(*lines.columns)


def drop_government_headers(lines: DataFrame, literals: tuple[str, ...] = ()) -> DataFrame:
    stripped = strip(F.col("line"))
    out = any_match(stripped, GOVERNMENT_HEADERS)
    for prefix, inside in (*GOVERNMENT_STARTS, *((x, "") for x in literals)):
        out = out | (stripped.startswith(prefix) & stripped.contains(inside))
    return lines.where(~out)


def drop_amendments(lines: DataFrame) -> DataFrame:
    """Blocks that a "Textual Amendments" line opens, up to the first line that can't continue one."""
    stripped = strip(F.col("line"))
    first = F.substring(stripped, 1, 1)
    lower_start = (stripped != "") & ~first.rlike("(?U)[\\p{Lu}\\d(]")
    continues = any_match(stripped, AMENDMENT_LINES) | any_match(stripped, AMENDMENT_NOTES) | lower_start
    opens = any_match(stripped, (AMENDMENT_OPENER,))
    upto = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    staged = lines.withColumns({"_opens": opens, "_goes": continues})
    staged = staged.withColumn("_block", F.sum(F.col("_opens").cast("int")).over(upto))
    inside = Window.partitionBy("doc_id", "_block").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    staged = staged.withColumn("_closed", F.max((~F.col("_goes")).cast("int")).over(inside))
    return staged.where((F.col("_block") == 0) | (F.col("_closed") == 1)).select(*lines.columns)


def rebuild(lines: DataFrame) -> DataFrame:
    """(doc_id, text) from lines in order."""
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def clean_documents(
    docs: DataFrame, boilerplate: tuple[str, ...] = (), contents_lines: int | None = None, legislation: bool = False
) -> DataFrame:
    """The whole chain, in its fixed order; boilerplate goes before lines are counted for the table of contents."""
    lines = drop_publisher_tail(drop_contents(drop_boilerplate(lines_of(docs), boilerplate), contents_lines))
    if legislation:
        lines = drop_amendments(drop_government_headers(lines))
    lines = lines.withColumn("line", fix_ocr(F.col("line")))
    return rebuild(lines).withColumn("text", normalize_space(rejoin_hyphens(F.col("text"))))
