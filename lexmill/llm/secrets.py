"""Secret scanning with an incremental ledger of content-addressed blobs.

Every text is addressed by its SHA-256. The ledger holds one row for each pair of
blob and rule version that has been scanned, findings or none. A run scans the
blobs whose pairs the ledger lacks, once each however many paths carry them, and
joins the ledger back to all paths. A later run with more files, or with a new
version of one rule, scans only what is new.

Spans are code-point offsets, end exclusive, of the leftmost non-overlapping
matches of each kind; matches shorter than the kind's least length are dropped
after matching. Regular expressions yield no offsets in SQL, so positions are
summed from the lengths of the pieces between matches.

Nulls: a null text is the empty text. Repeated rows each get the blob's findings.
Very long texts are scanned whole. Empty input gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import free_shuffles, materialize


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length that is kept.
    group: int
    least: int
    version: int = 1
    #: A cheaper pattern that any text with a kept match contains.
    hint: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, hint="AKIA[A-Z0-9]{16}"),
    # whole runs only, so a run's least length can stand in the pattern
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)

SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, ord, end, kind) of the rule's kept matches in text."""
    regex = F.lit(rule.pattern)
    whole, part = F.regexp_extract_all(text, regex, F.lit(0)), F.regexp_extract_all(text, regex, F.lit(rule.group))
    pieces = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x).cast("long"))
    found = F.zip_with(
        F.zip_with(F.transform(whole, lambda x: F.length(x).cast("long")), F.transform(part, F.length), lambda w, p: F.struct(w.alias("w"), p.alias("p"))),
        F.slice(pieces, F.lit(1), F.size(whole)),
        lambda m, gap: F.struct(gap.alias("gap"), m["w"].alias("w"), m["p"].alias("p")),
    )
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + m["gap"]
        span = F.struct(at.alias("start"), F.lit(order).alias("ord"), (at + m["w"]).alias("end"), F.lit(rule.kind).alias("kind"))
        kept = F.when(m["p"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct((at + m["w"]).alias("at"), kept.alias("out"))

    summed = F.aggregate(found, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(rule.hint or rule.pattern), summed).otherwise(none)


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(docs: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None, text: str = "text") -> DataFrame:
    """Ledger rows (blob, rule, spans) for the pairs that the ledger lacks."""
    blobs = docs.select(blob_id(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    blobs = blobs.dropDuplicates(["blob"])
    if ledger is None:
        todo = blobs.withColumn("rules", F.array(*[F.lit(r.key) for r in rules]))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = blobs.join(seen, "blob", "left").withColumn(
            "rules", F.array_except(F.array(*[F.lit(r.key) for r in rules]), F.coalesce("seen", F.array().cast("array<string>")))
        )
        todo = todo.where(F.size("rules") > 0)
    none = F.array().cast(SPAN)
    by_rule = [
        F.struct(
            F.lit(r.key).alias("rule"),
            F.when(F.array_contains("rules", r.key), spans_of(F.col("text"), r, i)).otherwise(none).alias("spans"),
        )
        for i, r in enumerate(rules)
    ]
    found = todo.select("blob", "rules", F.array(*by_rule).alias("r"))
    return found.select("blob", "rules", F.explode("r").alias("r")).where(F.array_contains("rules", F.col("r.rule"))).select("blob", "r.rule", "r.spans")


def update_ledger(
    spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, text: str = "text"
) -> DataFrame:
    """The ledger with all of docs' blobs under all rules, written to the shared folder."""
    free_shuffles(spark)
    new = scan_unseen(docs, rules, ledger, text)
    return materialize(spark, new if ledger is None else ledger.unionByName(new), "ledger")


def findings(spark: SparkSession, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, found) of the blobs with spans under the rules: spans by start, then the rules' order; written out."""
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    return materialize(spark, hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found")), "findings")


def written(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def report(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, a count for each kind, base_sha256 and spans for every row of docs."""
    full = update_ledger(spark, docs.select("doc_id", "text"), rules, ledger)
    by_blob = findings(spark, full, rules)
    paths = docs.select("doc_id", blob_id(F.col("text")).alias("blob"))
    out = paths.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", F.array().cast(SPAN)))
    counts = [counted(F.col("found"), r.kind).alias(f"n_{r.kind}") for r in rules]
    spans = written(F.col("found"))
    return out.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def redact(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by mark (overlapping spans by one) and n_chars counted anew; no row goes."""
    full = update_ledger(spark, docs.select("text"), rules)
    hits = findings(spark, full, rules)
    # the row travels as one struct, so none of its columns can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), blob_id(F.col("text")).alias("blob"))
    text = F.col("row.text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(inside)

    def rest(acc: Column) -> Column:
        return F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))

    joined = rows.join(hits, "blob", "left")
    joined = joined.withColumn("clean", F.when(F.col("found").isNull(), text).otherwise(F.aggregate("found", start, step, rest)))

    def column(name: str) -> Column:
        if name == "text":
            return F.col("clean").alias(name)
        if name == "n_chars":
            return F.length("clean").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.`{name}`").alias(name)

    return joined.select(*[column(c) for c in docs.columns])
