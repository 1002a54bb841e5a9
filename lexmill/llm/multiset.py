"""Homomorphic multiset fingerprints of documents.

A fingerprint is a pair of vectors that are sums over a document's paragraphs, its
non-empty lines: EQUAL_LANES lanes of a BLAKE2b hash of the paragraph modulo 2**64,
and LIKE_LANES lanes modulo 2**32 in which every three-word run of the paragraph
adds plus or minus one to a lane of its own. Sums make the fingerprint
independent of the paragraphs' order, and inserting or deleting a paragraph is
adding or subtracting its vectors (``insert``, ``delete``). The first part tells
equal multisets of paragraphs apart from different ones; the second is a count
sketch, so the cosine of two of them estimates that of the run counts, with an
error near 1 / sqrt(LIKE_LANES). A lane is read as a signed number, so likeness
holds for texts of fewer than 2**31 runs.

``neighbours`` pairs every document with the next one in descending id order:
value ranges of the id are sorted apart, and each range also gets the first
document of the next, so nothing is gathered in one place.

Nulls: a null text is the empty text, whose fingerprint is all zeros; null ids
come last. Equal ids are ordered by text. A single document is its own next one.
Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import bucket_of, order_bounds, prepare
from lexmill.llm.textfeat import EXACT, Words, slices

EQUAL_LANES, LIKE_LANES, RUN = 8, 256, 3
#: Buckets are joined with the ids that head them; as many at most are broadcast.
MOST_BUCKETS = 65536

OUT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
OUT_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two parts for each text: uint64 (n, EQUAL_LANES) and uint32 (n, LIKE_LANES)."""
    n = len(texts)
    equal, like = np.zeros((n, EQUAL_LANES), np.uint64), np.zeros((n, LIKE_LANES), np.int64)
    for at, to in slices(texts):
        words = Words(texts[at:to], EXACT, split_lines=True)
        runs, owner = words.grams(RUN)
        lane = (runs % np.uint64(LIKE_LANES)).astype(np.int64)
        sign = 1 - 2 * ((runs >> np.uint64(32)) & np.uint64(1)).astype(np.int64)
        flat = np.bincount(owner * LIKE_LANES + lane, weights=sign, minlength=(to - at) * LIKE_LANES)
        like[at:to] = flat.reshape(to - at, LIKE_LANES)
    for i, text in enumerate(texts):
        lines = [hashlib.blake2b(p, digest_size=8 * EQUAL_LANES).digest() for p in text.split(b"\n") if p]
        if lines:
            equal[i] = np.frombuffer(b"".join(lines), dtype="<u8").reshape(-1, EQUAL_LANES).sum(axis=0, dtype=np.uint64)
    return equal, (like & 0xFFFFFFFF).astype(np.uint32)


def insert(fingerprint: str, paragraph: str) -> str:
    return shift(fingerprint, paragraph, 1)


def delete(fingerprint: str, paragraph: str) -> str:
    return shift(fingerprint, paragraph, -1)


def shift(fingerprint: str, paragraph: str, by: int) -> str:
    if "\n" in paragraph:
        raise ValueError("a paragraph is one line")
    equal, like = read(fingerprint)
    e, k = vectors([paragraph.encode()])
    return (write(equal + e[0], like + k[0])) if by > 0 else write(equal - e[0], like - k[0])


def write(equal: np.ndarray, like: np.ndarray) -> str:
    return equal.astype(">u8").tobytes().hex() + ":" + like.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    equal, like = map(bytes.fromhex, fingerprint.split(":"))
    return np.frombuffer(equal, ">u8").astype(np.uint64), np.frombuffer(like, ">u4").astype(np.uint32)


def fingerprints(texts: list[str]) -> list[str]:
    return [write(e, k) for e, k in zip(*vectors([t.encode() for t in texts]), strict=True)]


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each pair of rows; 1 for equal fingerprints."""
    x, y = a[1].astype(np.int32).astype(np.float64), b[1].astype(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    same = (a[0] == b[0]).all(1) & (a[1] == b[1]).all(1)
    # only equal multisets reach 1
    return np.where(same, 1.0, np.clip(cosine, 0.0, 0.999999))


def edited(text: str, following: str) -> str:
    """text with its last third replaced by as many code points from the start of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def compared(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
    """Result rows for (id, text, next text)."""
    ids, texts, nexts = ([r[i] for r in rows] for i in range(3))
    changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
    raw = [t.encode() for t in changed]
    # neighbours follow each other, so most next texts are rows themselves
    known = vectors([t.encode() for t in texts] + [nexts[-1].encode()])
    own = known[0][:-1], known[1][:-1]
    after = known[0][1:], known[1][1:]
    new = vectors(raw)
    columns = [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(b).hexdigest() for b in raw],
        [write(e, k) for e, k in zip(*own, strict=True)],
        [write(e, k) for e, k in zip(*new, strict=True)],
        likeness(own, new),
        likeness(own, after),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, OUT, strict=True)], schema=OUT)


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the one after it; rows are sorted by bucket, own rows first, then the next bucket's head."""
    held = None  # (bucket, id, text) whose next text is not known yet
    pairs: list[tuple[int | None, str, str]] = []
    size = 0
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, is_head, doc_id, text = (batch.column(k)[i].as_py() for k in range(4))
            if held is not None and held[0] == bucket:
                # a chain is cut where a row's next text is not the following row's
                pairs.append((held[1], held[2], text))
                size += len(text)
                held = None
            if not is_head:
                held = (bucket, doc_id, text)
            if pairs and (is_head or size > 1 << 21):
                yield compared(pairs)
                pairs, size = [], 0


def neighbours(docs: DataFrame, rows_per_bucket: int = 2048) -> DataFrame:
    """(bucket, is_head, doc_id, text), dealt and sorted so that a row's next text follows it."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = order_bounds(rows, "doc_id", rows_per_bucket, MOST_BUCKETS)
    rows = rows.withColumn("bucket", -bucket_of(F.col("doc_id"), bounds))
    tops = rows.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    order = Window.orderBy("bucket")
    # a bucket's head follows the bucket before it; the first bucket's follows the last
    whole = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = tops.select(F.col("bucket").alias("b"), "top", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(whole)).alias("to"))
    heads = rows.join(F.broadcast(tops), (rows["bucket"] == F.col("b")) & rows["doc_id"].eqNullSafe(F.col("top")))
    every = rows.select("bucket", F.lit(0).alias("is_head"), "doc_id", "text")
    every = every.unionByName(heads.select(F.col("to").alias("bucket"), F.lit(1).alias("is_head"), "doc_id", "text"))
    return every.repartition("bucket").sortWithinPartitions("bucket", "is_head", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def document_fingerprints(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next for every row of docs."""
    prepare(spark)
    return neighbours(docs).mapInArrow(walk, OUT_SQL)
