"""Content-defined chunking of payloads into a deduplicated chunk store.

A text's payload is its UTF-8 bytes, zero-padded to a positive multiple of 64. A
rolling gear hash over the last 32 bytes cuts it where its top bits are zero,
between a least and a greatest chunk size, so an edit moves only the cuts near it.
A chunk is named by its SHA-256. The store has one row for each digest, found by a
Spark aggregation however many payloads hold the chunk; a recipe row says which
digest stands where in which payload. Payloads are rebuilt by joining the recipes
with the store and reading the chunks in order, and are checked against the digest
they are filed under; features come from the bytes so read back.

The stored form of a payload is its manifest (each chunk's size and digest) and
the chunks' bytes in order. In the store, chunks are compressed with a dictionary
fitted to DICTIONARY_ROWS texts; that changes what is moved, not what is returned.

Digests that very many payloads share are joined under salted keys. Nulls: a null
text is the empty text, a null id stays null. Repeated rows share everything but
their rows in the result. Very long texts give many chunks and are rebuilt as a
stream. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import hashed_sample, materialize, prepare, utf8_len
from lexmill.llm.textfeat import mix

UNIT = 64
LEAST, MEAN_BITS, MOST = 2048, 12, 65536
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)
DICTIONARY_ROWS, DICTIONARY_START, DICTIONARY_BYTES, LEVEL = 256, 65536, 65536, 9
#: Payloads that share a digest beyond this number are split over salted keys.
HOT = 4096

ROWS = pa.schema([("media", pa.binary()), ("seq", pa.int32()), ("size", pa.int32()), ("digest", pa.binary()), ("data", pa.binary())])
FEATURES = pa.schema(
    [
        ("media", pa.binary()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
    ]
)


def sql_schema(schema: pa.Schema) -> str:
    kinds = {pa.binary(): "binary", pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with zeros up to a positive multiple of UNIT."""
    n = utf8_len(text)
    short = F.when(n == 0, UNIT).otherwise(F.pmod(-n, F.lit(UNIT))).cast("int")
    return F.concat(F.coalesce(text, F.lit("")).cast("binary"), F.unhex(F.repeat(F.lit("00"), short)))


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash of the 32 bytes that end at each position, by doubling the window."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        prior = np.zeros_like(h)
        prior[width:] = h[:-width] << np.uint32(width)
        h = h + prior
    return h


def cuts(payload: bytes) -> list[int]:
    """Ends of the payload's chunks."""
    n = len(payload)
    if n <= LEAST:
        return [n]
    at = np.flatnonzero(gear(np.frombuffer(payload, dtype=np.uint8)) >> np.uint32(32 - MEAN_BITS) == 0) + 1
    ends, last = [], 0
    for c in at.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunker(dictionary: bytes, with_data: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            size = 0
            for i in range(batch.num_rows):
                payload = batch.column(0)[i].as_py()
                media, last = hashlib.sha256(payload).digest(), 0
                for seq, end in enumerate(cuts(payload)):
                    piece = payload[last:end]
                    row = (media, seq, end - last, hashlib.sha256(piece).digest(), tool.compress(piece) if with_data else None)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    size += end - last
                    last = end
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ROWS, strict=True)], schema=ROWS)
                    out, size = ([], [], [], [], []), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ROWS, strict=True)], schema=ROWS)

    return run


def fit_dictionary(docs: DataFrame, text: str) -> bytes:
    """A compression dictionary from the starts of DICTIONARY_ROWS texts, those of the least hashes; none if they are too few.

    At most DICTIONARY_START characters of a text come to the driver; the dictionary changes what is moved, not what is returned.
    """
    starts = docs.where(F.length(text) > 64).select(F.xxhash64(text).alias("hash"), F.substring(text, 1, DICTIONARY_START).alias("start"))
    rows = hashed_sample(starts, "hash", DICTIONARY_ROWS).collect()
    samples = [b[i : i + 4096] for b in (r["start"].encode() for r in rows) for i in range(0, len(b), 4096)]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def feature(payload: bytes, sizes: list[int]) -> str:
    """Byte statistics of a payload: chunks, mean, deviation, and shares of eight bands of values."""
    data = np.frombuffer(payload, dtype=np.uint8)
    bands = np.bincount(data >> 5, minlength=8)
    return f"chunks={len(sizes)};mean={data.mean():.4f};std={data.std():.4f};bands=" + ",".join(map(str, bands.tolist()))


def rebuilder(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
        media, sizes, digests, pieces = None, [], [], []

        def done() -> tuple:
            payload = b"".join(pieces)
            if hashlib.sha256(payload).digest() != media:
                raise ValueError(f"payload {media.hex()} was not rebuilt")
            manifest = b"LXCH" + struct.pack("<I", len(sizes)) + b"".join(struct.pack("<I", s) + d for s, d in zip(sizes, digests, strict=True))
            stored = hashlib.sha256(manifest)
            stored.update(payload)
            return media, len(payload), media.hex(), zlib.crc32(payload[-UNIT:]), len(manifest) + len(payload), stored.hexdigest(), feature(payload, sizes)

        for batch in batches:
            out = []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != media:
                    if media is not None:
                        out.append(done())
                    media, sizes, digests, pieces = key, [], [], []
                piece = tool.decompress(data)
                sizes.append(len(piece))
                digests.append(hashlib.sha256(piece).digest())
                pieces.append(piece)
            yield rows_of(out, FEATURES)
        if media is not None:
            yield rows_of([done()], FEATURES)

    return run


def rows_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def store_and_recipes(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, bytes]:
    """The chunk store (digest, data), the recipes (media, seq, size, digest), and the dictionary."""
    dictionary = fit_dictionary(docs, text)
    payloads = docs.select(payload_of(F.col(text)).alias("payload"))
    schema = sql_schema(ROWS)
    store = payloads.mapInArrow(chunker(dictionary, True), schema).groupBy("digest").agg(F.first("data").alias("data"))
    recipes = payloads.mapInArrow(chunker(dictionary, False), schema).drop("data").distinct()
    return store, materialize(spark, recipes, "recipes"), dictionary


def rebuilt(recipes: DataFrame, store: DataFrame, dictionary: bytes) -> DataFrame:
    """Features of each distinct payload, from its chunks as they stand in the store."""
    refs = recipes.groupBy("digest").count().where(F.col("count") > HOT)
    cold = recipes
    if refs.limit(1).count():
        spread = refs.select("digest", F.ceil(F.col("count") / HOT).cast("int").alias("copies"))
        hot = recipes.join(spread, "digest").withColumn("salt", F.pmod(F.xxhash64("media"), F.col("copies")).cast("int"))
        copies = store.join(spread, "digest").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        cold = recipes.join(refs, "digest", "left_anti")
        met = cold.join(store, "digest").select("media", "seq", "data")
        met = met.unionByName(hot.join(copies.drop("copies"), ["digest", "salt"]).select("media", "seq", "data"))
    else:
        met = cold.join(store, "digest").select("media", "seq", "data")
    # sizes and digests are taken from the chunks again, so they need not move
    return met.repartition("media").sortWithinPartitions("media", "seq").mapInArrow(rebuilder(dictionary), sql_schema(FEATURES))


def media_columns(spark: SparkSession, docs: DataFrame, text: str = "text") -> DataFrame:
    """Payload and stored-form columns for every row of docs, read back from the store."""
    prepare(spark)
    store, recipes, dictionary = store_and_recipes(spark, docs, text)
    features = materialize(spark, rebuilt(recipes, store, dictionary), "media")
    keys = docs.select("doc_id", utf8_len(F.col(text)).alias("n_bytes"), F.unhex(F.sha2(payload_of(F.col(text)), 256)).alias("media"))
    names = [f.name for f in FEATURES][1:]
    return keys.join(features, "media").select("doc_id", "n_bytes", *names)
