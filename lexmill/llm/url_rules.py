"""URL filtering by listed rules and mined association rules.

Listed rules come first: a rule of a host and a path prefix fits that host and
its subdomains; the longest fitting rule decides. The URLs so decided are the
labels from which FP-growth mines: every URL is a set of tokens (host labels,
path segments, extension, query keys), the label is one more token, and token
sets that imply a label with enough confidence and support become rules. A rule is
dropped if one of fewer tokens implies the same label at least as surely. URLs
without a listed rule are judged by the mined rule of the highest confidence, then
support, fewest tokens, and name; without any, by the default.

Matching uses an inverted index: each rule is posted under its rarest token, a
URL's tokens meet the postings in a join, and the rest of the rule is tested on
the URL's token array. Distinct URLs are judged once and joined back.

Nulls: a null URL, or one without ``://``, has an empty host and path and no
tokens. Repeated rows each get their URL's verdict. Empty input gives an empty
result; without labels all URLs without a listed rule get the default.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHAPE = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SHAPE, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SHAPE, 2), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: host labels h:, path segments p: (p:# for numbers), extension x:, query keys q:."""
    labels = F.transform(F.filter(F.split(host, "[.]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    segments = F.transform(parts, lambda x: F.concat(F.lit("p:"), F.when(x.rlike("^[0-9]"), F.lit("#")).otherwise(x)))
    ext = F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1)
    exts = F.when(ext != "", F.array(F.concat(F.lit("x:"), ext))).otherwise(F.array().cast("array<string>"))
    query = F.coalesce(F.regexp_extract(url, "(?s)^[^?#]*[?]([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "(?s)^([^=]*)", 1)))
    return F.array_distinct(F.concat(labels, segments, exts, keys))


def mine(
    spark: SparkSession, labelled: DataFrame, min_support: float, min_confidence: float, max_tokens: int
) -> DataFrame:
    """(tokens, verdict, confidence, support, posting) of the pruned rules, from (tokens, verdict)."""
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    sets = model.freqItemsets
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("posting"), F.col("freq").alias("posting_freq"))
    rules = model.associationRules.where(
        F.col("consequent")[0].startswith("=") & (F.size("antecedent") <= max_tokens) & ~F.exists("antecedent", lambda x: x.startswith("="))
    ).select(
        F.array_sort("antecedent").alias("rule_tokens"), F.expr("substr(consequent[0], 2)").alias("mined"), "confidence", "support"
    )
    rules = materialize(spark, rules, "url-rules")
    general = rules.select(F.col("rule_tokens").alias("_t"), F.col("mined").alias("_v"), F.col("confidence").alias("_c"))
    narrower = (F.size("_t") < F.size("rule_tokens")) & (F.size(F.array_except("_t", "rule_tokens")) == 0)
    # a more general rule's first token is among the narrower one's
    beaten = (
        rules.withColumn("_one", F.explode("rule_tokens"))
        .join(general.withColumn("_one", F.col("_t")[0]), "_one")
        .where((F.col("_v") == F.col("mined")) & (F.col("_c") >= F.col("confidence")) & narrower)
    )
    kept = rules.join(beaten.select("rule_tokens", "mined").distinct(), ["rule_tokens", "mined"], "left_anti")
    posted = kept.withColumn("posting", F.explode("rule_tokens")).join(single, "posting")
    rarest = posted.groupBy("rule_tokens", "mined", "confidence", "support").agg(F.min(F.struct("posting_freq", "posting")).alias("p"))
    return materialize(spark, rarest.select("rule_tokens", "mined", "confidence", "support", F.col("p.posting").alias("posting")), "url-index")


def judge(
    spark: SparkSession,
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    min_support: float = 0.01,
    min_confidence: float = 0.6,
    max_tokens: int = 3,
    default: str = "allow",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rows = rows.withColumn("_l", listed(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "url", "host", "path", F.col("_l.rule").alias("rule"), F.col("_l.verdict").alias("listed"))
    tokens = tokens_of(F.col("url"), F.col("host"), F.col("path"))
    known = rows.where("listed is not null").select(tokens.alias("tokens"), F.col("listed").alias("verdict"))
    index = mine(spark, known, min_support, min_confidence, max_tokens)
    open_urls = rows.where("listed is null and url is not null").select("url", "host", "path").distinct().withColumn("tokens", tokens)
    met = open_urls.select("url", "tokens", F.explode("tokens").alias("posting")).join(index, "posting")
    met = met.where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    rank = F.struct(
        F.col("confidence"), F.col("support"), -F.size("rule_tokens"), F.array_join("rule_tokens", " ").alias("mined_rule"), F.col("mined")
    )
    best = met.groupBy("url").agg(F.max(rank).alias("b")).select("url", "b.mined_rule", "b.mined")
    best = materialize(spark, best, "url-verdicts")
    out = rows.join(best, "url", "left")
    verdict = F.coalesce("listed", "mined", F.lit(default))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("listed").isNull(), F.col("mined_rule")).alias("mined_rule"))
