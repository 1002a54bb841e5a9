"""Incremental counterparts of batch stages, beyond what batch parity needs.

A stream of documents gives running mention counts, and windowed event counts close
once the watermark has passed them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import words


def mention_stream(docs: DataFrame, languages: dict[str, str], title: str = "source") -> DataFrame:
    """Running counts of mentions by title and language, for a streaming or a batch docs."""
    of = F.create_map(*[F.lit(x) for kv in languages.items() for x in kv])
    each = docs.select(F.col(title).alias("doc_title"), F.explode(words(F.lower("text"))).alias("word"))
    named = each.withColumn("language", F.try_element_at(of, F.col("word"))).where("language is not null")
    return named.groupBy("doc_title", "language").agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by event type in tumbling windows; rows later than `late` are dropped once a window is closed."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n")
