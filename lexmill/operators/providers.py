"""Column producers that stand in for external models, and the cache in front of a remote one.

A provider adds columns to a table. The defaults are deterministic and need no
network: a lexical parser, cue-word classification and hashed term vectors. They
keep the shape and the meaning of the columns, not a model's quality; a real parser,
encoder or chat client is plugged in as a function on batches.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.dims import STRATEGIES
from lexmill.functions.text import CLASSIFICATION, parse_reply, words
from lexmill.storage import ship, written

#: Instructions by strategy; others can be handed to strategy_prompts().
TASKS = {
    "nomination": "How does the text name languages, their speakers and the institutions around them?",
    "predication": "Which qualities does the text give to languages and to those who speak or govern them?",
    "argumentation": "With which topoi does the text argue for or against claims about languages? Name each topos as topos_of_...",
    "perspectivization": "From whose point of view does the text speak about languages, and at what distance?",
    "intensification_mitigation": "Which claims about languages does the text strengthen or weaken, and by what means? A legal shall strengthens, may weakens.",
}


@dataclass(frozen=True)
class Lexicon:
    """Target terms by lower-case spelling with their language, and the neighbours that give a term its role."""

    languages: dict[str, str]
    after_agent: tuple[str, ...] = ("is", "was", "are", "be")
    before_patient: tuple[str, ...] = ("of", "to", "in", "for", "on")
    before_oblique: tuple[str, ...] = ("with", "by", "at", "from")


@dataclass(frozen=True)
class Cues:
    """Cue words by strategy, and by topos for argumentation; a strategy is present from `least` cues on."""

    strategies: dict[str, tuple[str, ...]]
    topoi: dict[str, tuple[str, ...]] = field(default_factory=dict)
    least: int = 3


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


#: What a parser gives for each token of a sentence, in order; `left` and `right` are the first and last token of its subtree.
TOKEN = pa.struct(
    [
        ("i", pa.int32()), ("text", pa.string()), ("lemma", pa.string()), ("pos", pa.string()), ("tag", pa.string()), ("dep", pa.string()),
        ("head_i", pa.int32()), ("left", pa.int32()), ("right", pa.int32()), ("voice", pa.string()),
    ]
)
TOKENS = "array<struct<i:int,text:string,lemma:string,pos:string,tag:string,dep:string,head_i:int,left:int,right:int,voice:string>>"


def parsed_sentences(sentences: DataFrame, parser: Callable[[pa.Array], pa.Array], text: str = "sentence", once: bool = False) -> DataFrame:
    """sentences with `tokens`, an array of TOKEN for each, from a parser of batches of texts.

    parser: an array of distinct texts to an array of lists of TOKEN; it is called on the
    workers, so a model is best loaded on its first call. Equal sentences of a batch are
    asked once and nothing is shuffled. With `once` a sentence is asked once in the whole
    table: distinct texts are parsed and written, and joined back by digest (a cost of two
    shuffles, for parsers dearer than that). A null text has null tokens.
    """
    ship(sentences.sparkSession)
    if once:
        keyed = sentences.withColumn("_key", F.sha2(F.col(text), 256))
        # equal texts are combined before the shuffle
        distinct = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias(text))
        known = written(sentences.sparkSession, parsed_sentences(distinct, parser, text).select("_key", "tokens"), "parsed")
        return keyed.join(known, "_key", "left").drop("_key")
    schema = f"{sentences._jdf.schema().toDDL()}, tokens {TOKENS}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b[text].dictionary_encode()
            found = parser(asked.dictionary).cast(pa.list_(TOKEN))
            yield pa.RecordBatch.from_arrays([*b.columns, found.take(asked.indices)], [*b.schema.names, "tokens"])

    return sentences.mapInArrow(run, schema)


def lexical_frames(chunks: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each target term in a chunk: its neighbours, role, head, children, modifiers and verb.

    The head is the next word, the only child the word before; a word before of over
    three letters modifies the term. All of it stays inside the chunk's row until the
    last step, so nothing is shuffled.
    """
    w = chunks.withColumn("_w", words(F.coalesce("text", F.lit(""))))
    # one pass over the words; null where a word is no target term
    hits = (
        f"filter(transform(_w, (x, i) -> if(lower(x) in ({quoted(lexicon.languages)}), "
        "struct(i as token_idx, x as target_term, lower(x) as target_lemma, lower(get(_w, i - 1)) as prev, lower(get(_w, i + 1)) as next), null)), f -> f is not null)"
    )
    rows = w.withColumn("_f", F.explode(F.expr(hits))).select("*", "_f.*").drop("_f", "_w", "text")
    terms = list(lexicon.languages)
    role = (
        F.when(F.col("next").isin(*lexicon.after_agent), "agent")
        .when(F.col("prev").isin(*lexicon.before_patient), "patient")
        .when(F.col("prev").isin(*lexicon.before_oblique), "oblique")
        .when(F.col("next").isin(*terms), "modifier")
        .otherwise("other")
    )
    of_role = F.create_map(*[F.lit(x) for x in ("agent", "nsubj", "patient", "pobj", "oblique", "obl", "modifier", "compound", "other", "dep")])
    long = F.length("prev") > 3
    pos = F.when(long, "ADJ").otherwise("DET")
    language = F.create_map(*[F.lit(x) for kv in lexicon.languages.items() for x in kv])
    rows = rows.withColumns({"syntactic_role": role, "target_language": language[F.col("target_lemma")]})
    child = F.struct(F.col("prev").alias("text"), F.when(long, "amod").otherwise("det").alias("dep"), pos.alias("pos"))
    modifier = F.struct(F.col("prev").alias("text"), F.col("prev").alias("lemma"), F.lit("ADJ").alias("pos"), F.lit("amod").alias("dep"))
    return rows.withColumns(
        {
            "dep_relation": of_role[F.col("syntactic_role")],
            "dep_head_lemma": F.coalesce("next", F.lit("")),
            "dep_head_pos": F.when(F.col("next").isin(*lexicon.after_agent), "AUX").when(F.length("next") > 3, "NOUN").otherwise("ADP"),
            "dep_children": F.when(F.col("prev").isNotNull(), F.array(child)).otherwise(F.array()),
            "modifiers": F.when(long, F.array(modifier)).otherwise(F.array()),
            "governing_verb": F.when(F.col("syntactic_role").isin("agent", "patient"), F.col("next")),
        }
    ).drop("prev", "next")


def cue_classifications(chunks: DataFrame, cues: Cues, lexicon: Lexicon) -> DataFrame:
    """Five classification rows for each chunk, from cue counts; no shuffle."""
    named = {x for found in (*cues.strategies.values(), *cues.topoi.values()) for x in found} | set(lexicon.languages)
    some = quoted(sorted(named)) or "null"
    # one pass keeps the words that any cue or term names; the rest looks at those only
    w = chunks.withColumn("_w", F.expr(f"filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+', 0), x -> x in ({some}))"))
    languages = {}
    for term, language in lexicon.languages.items():
        languages.setdefault(language, []).append(term)
    holds = lambda found: F.arrays_overlap("_w", F.array(*[F.lit(x) for x in found]).cast("array<string>"))
    present = [F.when(holds(t), F.lit(name)) for name, t in sorted(languages.items())]
    none = F.array().cast("array<string>")
    w = w.withColumn("_langs", F.filter(F.array(*present), lambda x: x.isNotNull()) if present else none)
    topoi = [F.when(holds(t), F.lit(f"topos_of_{name}")) for name, t in sorted(cues.topoi.items())]
    w = w.withColumn("_topoi", F.filter(F.array(*topoi), lambda x: x.isNotNull()) if topoi else none)
    each = []
    for i, (name, found) in enumerate(cues.strategies.items()):
        n = F.expr(f"size(filter(_w, x -> x in ({quoted(found) or 'null'})))")
        devices = F.array_sort(F.array_intersect("_w", F.array(*[F.lit(x) for x in found]).cast("array<string>")))
        each.append(F.struct(F.lit(i).alias("strategy_ord"), F.lit(name).alias("strategy"), n.alias("cues"), devices.alias("devices")))
    rows = w.withColumn("_s", F.explode(F.array(*each))).select("*", "_s.*").drop("_s", "_w", "text")
    on = F.col("cues") >= cues.least
    return rows.withColumns(
        {
            "present": on,
            "confidence": F.when(on, F.least(F.lit(1.0), F.col("cues") / F.lit(2 * cues.least))).otherwise(F.lit(0.0)),
            "linguistic_devices": F.when(on, F.col("devices")).otherwise(none),
            "target_languages": F.when(on, F.col("_langs")).otherwise(none),
            "topoi": F.when(on & (F.col("strategy") == "argumentation"), F.col("_topoi")).otherwise(none),
        }
    ).drop("cues", "devices", "_langs", "_topoi")


def prompt(instruction: Column, title: Column, year: Column, frames: Column, text: Column, schema: str | Column) -> Column:
    """A classification prompt: document, frames where there are any, task, text and reply format."""
    context = F.concat(F.lit("Document: "), title, F.lit(" ("), year.cast("string"), F.lit(")"))
    shown = F.when(F.length(frames) > 0, F.concat(F.lit("Dependency frames:\n"), frames))
    form = schema if isinstance(schema, Column) else F.lit(schema)
    return F.concat_ws("\n\n", context, shown, instruction, F.concat(F.lit("Text:\n"), text), form)


def prompt_key(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_misses(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """One row for each distinct prompt that the cache lacks: equal prompts are asked once."""
    return prompts.join(cache.select("prompt_sha"), "prompt_sha", "left_anti").dropDuplicates(["prompt_sha"])


def answered(prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """Every prompt row with its own columns and the cached result; the error sentinel where there is none."""
    out = prompts.join(cache, "prompt_sha", "left")
    return out.withColumns({"error": F.col("result").isNull(), "present": F.coalesce(F.col("result.present"), F.lit(False))})


class Refused(Exception):
    """What a client raises where asking again can't help."""


def ask(misses: DataFrame, client: Callable[[str], str | None], retries: int = 3, pause: float = 1.0, workers: int = 5, failures: bool = False) -> DataFrame:
    """(prompt_sha, reply) from a client, `workers` calls at a time in each task; failures give no row, so they are never cached.

    Lost connections and time-outs are tried again after pause, 2 pause, 4 pause ... seconds,
    `retries` times in all. A client that raises Refused or answers nothing is not asked again.
    With `failures` there is a row for each of them too: reply null and `failure` telling why.
    Any other exception is an error in the client and ends the query.
    """

    def once(text: str) -> tuple[str | None, str | None]:
        for attempt in range(retries):
            try:
                reply = client(text)
            except (ConnectionError, TimeoutError) as e:
                why = f"{type(e).__name__}: {e}"
                if attempt + 1 < retries:
                    time.sleep(pause * 2**attempt)
            except Refused as e:
                return None, f"refused: {e}"
            else:
                return reply, None if reply is not None else "no answer"
        return None, why

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                found = list(pool.map(once, batch["prompt"]))
                yield pd.DataFrame([(k, *f) for k, f in zip(batch["prompt_sha"], found, strict=True)], columns=["prompt_sha", "reply", "failure"])

    out = misses.select("prompt_sha", "prompt").mapInPandas(run, "prompt_sha string, reply string, failure string")
    return out if failures else out.where("reply is not null").drop("failure")


def asked_strategies(strategies: tuple[str, ...], tasks: dict[str, str] | None) -> Column:
    """Each strategy with its instruction, its reply format (only arguments are asked for topoi) and a digest of both."""
    tasks = TASKS if tasks is None else tasks
    unknown = [x for x in strategies if x not in tasks]
    if unknown:
        raise ValueError(f"unknown strategies {unknown}; known are {sorted(tasks)}")
    mark = lambda x: hashlib.sha256(json.dumps([x, tasks[x], reply_format(x)]).encode()).hexdigest()
    return F.array(*[
        F.struct(F.lit(i).alias("strategy_ord"), F.lit(x).alias("strategy"), F.lit(tasks[x]).alias("_task"), F.lit(reply_format(x)).alias("_format"), F.lit(mark(x)).alias("_mark"))
        for i, x in enumerate(strategies)
    ])


def shown_chunks(chunks: DataFrame, lines: DataFrame | None) -> DataFrame:
    """chunks with _title, _year, _frames and _text as prompts show them, and _base, the digest of these four."""
    joined = chunks.withColumn("_frames", F.lit(None).cast("string")) if lines is None else chunks.join(lines.withColumnRenamed("frames", "_frames"), "chunk_id", "left")
    unknown = F.lit("Unknown")
    rows = joined.withColumns({"_title": F.coalesce("doc_title", unknown), "_year": F.coalesce(F.col("doc_year").cast("string"), unknown), "_text": F.coalesce("text", F.lit(""))})
    sized = lambda c: F.concat(F.length(c).cast("string"), F.lit(":"), c)
    return rows.withColumn("_base", F.sha2(F.concat(sized(F.col("_title")), sized(F.col("_year")), sized(F.coalesce("_frames", F.lit(""))), F.col("_text")), 256))


SHOWN = ("_title", "_year", "_frames", "_text")


def with_prompt_key(rows: DataFrame, strategies: tuple[str, ...], tasks: dict[str, str] | None) -> DataFrame:
    out = rows.withColumn("_s", F.explode(asked_strategies(strategies, tasks))).select("*", "_s.*").drop("_s")
    return out.withColumn("prompt_sha", F.sha2(F.concat("_base", "_mark"), 256))


def prompt_of() -> Column:
    return prompt(F.col("_task"), F.col("_title"), F.col("_year"), F.col("_frames"), F.col("_text"), F.col("_format"))


def prompt_keys(chunks: DataFrame, lines: DataFrame | None = None, strategies: tuple[str, ...] = STRATEGIES, tasks: dict[str, str] | None = None) -> DataFrame:
    """A row for each chunk and strategy with prompt_sha, the key of its prompt: equal for equal prompts, and made without them.

    chunks: chunk_id, doc_title, doc_year, text, ...; columns but the text stay. lines:
    (chunk_id, frames) of frame_lines(). tasks: instructions by strategy; a strategy
    without one is unknown. Null texts count as empty.
    """
    narrow = shown_chunks(chunks, lines).drop(*SHOWN, "text")
    return with_prompt_key(narrow, strategies, tasks).drop("_base", "_task", "_format", "_mark")


def strategy_prompts(chunks: DataFrame, lines: DataFrame | None = None, strategies: tuple[str, ...] = STRATEGIES, tasks: dict[str, str] | None = None) -> DataFrame:
    """prompt_keys() with the whole prompts, for small tables: a text stands in each of its prompts."""
    rows = with_prompt_key(shown_chunks(chunks, lines).drop("text"), strategies, tasks)
    return rows.withColumn("prompt", prompt_of()).drop("_base", "_task", "_format", "_mark", *SHOWN)


def reply_format(strategy: str) -> str:
    topoi = ', "topoi": [names of topoi]' if strategy == "argumentation" else ""
    return (
        f'Reply with one JSON object: {{"strategy_name": "{strategy}", "present": true or false, "confidence": 0.0 to 1.0, '
        '"evidence_quotes": [exact quotes], "linguistic_devices": [{"device": name, "example": words, "function": effect}], '
        f'"target_languages": [languages]{topoi}, "notes": short note}}'
    )


def classify(
    spark: SparkSession, prompts: DataFrame, cache: DataFrame | None, client: Callable[[str], str | None], retries: int = 3, pause: float = 1.0, workers: int = 5
) -> tuple[DataFrame, DataFrame]:
    """(classifications, what is new in the cache) of strategy_prompts().

    Only prompts that the cache (prompt_sha, result) lacks are asked, equal ones once;
    replies are written before they are read, so none is asked for twice. Failures
    and replies that can't be parsed become records with `error`, absent and without confidence, and stay out of the cache.
    """
    result = spark.createDataFrame([], f"prompt_sha string, result struct<{CLASSIFICATION}>")
    cache = result if cache is None else cache
    replies = written(spark, ask(cache_misses(prompts, cache), client, retries, pause, workers, failures=True), "replies")
    parsed = replies.select("prompt_sha", "reply").withColumn("result", parse_reply(F.col("reply")))
    fresh = written(spark, parsed.where("result is not null").select("prompt_sha", "result"), "parsed")
    return records(prompts.drop("prompt"), cache.select("prompt_sha", "result").unionByName(fresh), replies.select("prompt_sha", "failure")), fresh


def records(keys: DataFrame, cache: DataFrame, failures: DataFrame) -> DataFrame:
    """keys (prompt_sha, ...) with the fields of their results; those without one with `error`, and why."""
    rows = answered(keys, cache).join(failures, "prompt_sha", "left")
    strings = lambda c: F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array().cast("array<string>"))
    out = rows.withColumns(
        {
            "confidence": F.coalesce("result.confidence", F.lit(0.0)), "evidence_quotes": strings(F.col("result.evidence_quotes")),
            "linguistic_devices": strings(F.col("result.linguistic_devices.device")), "target_languages": strings(F.col("result.target_languages")),
            "topoi": strings(F.col("result.topoi")), "repaired": F.coalesce("result.repaired", F.lit(False)),
            "notes": F.when(F.col("error"), F.coalesce("failure", F.lit("reply can't be parsed"))).otherwise(F.col("result.notes")),
        }
    )
    return out.drop("result", "failure")


def cached(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_sha, result) of a cache, one row a prompt; empty where there is none."""
    try:
        rows = spark.read.parquet(path).select("prompt_sha", "result")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"prompt_sha string, result struct<{CLASSIFICATION}>")
    return rows.dropDuplicates(["prompt_sha"])


def classify_chunks(
    spark: SparkSession, chunks: DataFrame, path: str, client: Callable[[str], str | None], lines: DataFrame | None = None,
    strategies: tuple[str, ...] = STRATEGIES, tasks: dict[str, str] | None = None, retries: int = 3, pause: float = 1.0, workers: int = 5,
    commit_rows: int = 2000, most_commits: int = 256,
) -> DataFrame:
    """Classifications of chunks through a client, behind a cache at `path` that outlives a run that ends half way.

    Keys of prompts are compared with the cache first. Only chunks that some prompt is
    missing for are written, once, with their text; their prompts are put together in
    the task that asks. They are asked in lots of about commit_rows chunks (more where
    that would make over most_commits lots), and each lot's replies are in the cache
    before the next one is asked, so a run that is killed or fails has at most one lot to
    ask again. Failures and replies that can't be parsed become records with `error`
    and are not cached.
    """
    keys = written(spark, prompt_keys(chunks, lines, strategies, tasks), "keys")
    shown = shown_chunks(chunks, lines).select("_base", *SHOWN)
    narrow = with_prompt_key(shown.select("_base"), strategies, tasks).select("_base", "prompt_sha").distinct()
    missing = narrow.join(cached(spark, path), "prompt_sha", "left_anti").groupBy("_base").agg(F.collect_set("prompt_sha").alias("_asked"))
    # join and grouping share one shuffle of the texts
    todo = written(spark, shown.join(missing, "_base").dropDuplicates(["_base"]), "asked")
    count = todo.count()
    lots = min(most_commits, -(-count // commit_rows))
    failures = None
    for lot in range(lots):
        some = todo.where(F.pmod(F.xxhash64("_base"), F.lit(lots)) == lot)
        prompts = with_prompt_key(some, strategies, tasks).where(F.array_contains("_asked", F.col("prompt_sha"))).select("prompt_sha", prompt_of().alias("prompt"))
        replies = written(spark, ask(prompts, client, retries, pause, workers, failures=True), "replies")
        fresh = replies.withColumn("result", parse_reply(F.col("reply"))).where("result is not null").select("prompt_sha", "result")
        fresh.write.mode("append").parquet(path)
        failed = replies.select("prompt_sha", "failure").where("failure is not null")
        failures = failed if failures is None else failures.unionByName(failed)
    if failures is None:
        failures = spark.createDataFrame([], "prompt_sha string, failure string")
    return records(keys, cached(spark, path), failures)


def encoded(chunks: DataFrame, encoder: Callable[[pa.Array], pa.Array], text: str = "text_with_prefix", key: str = "chunk_id") -> DataFrame:
    """(chunk_id, embedding) from an encoder of batches of texts, an array of strings to an array of lists of floats.

    The encoder is called on the workers, so a model is best loaded on its first call. Equal
    texts of a batch are encoded once; a null text is the empty text. A batch of other length is an error.
    """
    ship(chunks.sparkSession)
    kind = dict(chunks.dtypes)[key]
    vector = pa.list_(pa.float32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = b.column(1).dictionary_encode()
            found = encoder(asked.dictionary)
            if len(found) != len(asked.dictionary):
                raise ValueError(f"the encoder gave {len(found)} vectors for {len(asked.dictionary)} texts")
            yield pa.RecordBatch.from_arrays([b.column(0), found.cast(vector).take(asked.indices)], ["chunk_id", "embedding"])

    return chunks.select(F.col(key), F.coalesce(text, F.lit(""))).mapInArrow(run, f"chunk_id {kind}, embedding array<float>")


def hashed_vectors(chunks: DataFrame, size: int = 768) -> DataFrame:
    """(chunk_id, embedding): unit-length hashed term counts, JVM-side."""
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = RegexTokenizer(inputCol="text", outputCol="_w", pattern="\\W+").transform(rows)
    rows = HashingTF(inputCol="_w", outputCol="_v", numFeatures=size).transform(rows)
    rows = Normalizer(inputCol="_v", outputCol="_u", p=2.0).transform(rows)
    return rows.select("chunk_id", vector_to_array("_u", "float32").alias("embedding"))
