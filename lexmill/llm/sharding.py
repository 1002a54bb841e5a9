"""Feistel shuffle of global row numbers into shards.

Rows are numbered 0..N-1 by ascending key; a keyed Feistel network over the
smallest power of two that holds N permutes the numbers, walking the cycle until
the value falls below N again. The permuted number p gives shard p mod S and slot
p div S, so shard sizes differ by one row at most, slots have no gaps, and both
are computable from a row number alone (``place``).

Nulls: a null key sorts first; a null text has no bytes. Rows with equal keys are
ordered by size, then checksum, and keep their own numbers; ranks come from digit
histograms (``radix``), so a hot key or many null keys are not in one task. Empty input gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm import radix
from lexmill.llm.common import bucket_of, materialize, order_bounds, prepare, utf8_len

PRIME = 2147483647
#: (multiplier, increment) of each round; any integers below PRIME do.
ROUND_KEYS = ((48271, 11), (69621, 23), (40692, 37), (62089, 53), (39373, 71), (45742, 97))
#: A value leaves the range with a chance of less than one half at each step.
MAX_WALK = 128


def widths(n: int) -> tuple[int, int]:
    """Bits of the left and right half of the smallest power of two that holds n values."""
    bits = max(2, (max(n, 1) - 1).bit_length())
    return bits // 2, bits - bits // 2


def round_value(x: int, mul: int, add: int, seed: int, mod: int) -> int:
    """Round function; products stay below 2**62."""
    a = (x * mul + add + seed % 1000003) % PRIME
    return a * a % PRIME * 16807 % PRIME % mod


def rounds(n: int) -> list[tuple[int, int, int, int]]:
    """(multiplier, increment, 2**left, 2**right) by round: the halves swap widths, so odd bit counts work."""
    left, right = widths(n)
    return [(m, a, *((1 << left, 1 << right) if i % 2 == 0 else (1 << right, 1 << left))) for i, (m, a) in enumerate(ROUND_KEYS)]


def feistel_int(x: int, n: int, seed: int) -> int:
    for mul, add, left, right in rounds(n):
        hi, lo = divmod(x, right)
        x = lo * left + (hi + round_value(lo, mul, add, seed, left)) % left
    return x


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of one row number, without any table."""
    x = feistel_int(row, n, seed)
    while x >= n:
        x = feistel_int(x, n, seed)
    return x % shards, x // shards


def feistel_sql(x: str, n: int, seed: int) -> str:
    keys = ", ".join(f"named_struct('m', {m}L, 'a', {a + seed % 1000003}L, 'l', {left}L, 'r', {right}L)" for m, a, left, right in rounds(n))
    a = f"(((x % k.r) * k.m + k.a) % {PRIME}L)"
    return f"aggregate(array({keys}), {x}, (x, k) -> (x % k.r) * k.l + (x div k.r + ({a} * {a}) % {PRIME}L * 16807L % {PRIME}L % k.l) % k.l)"


def permuted(row: str, n: int, seed: int) -> Column:
    """The row number's place under the permutation of 0..n-1."""
    walk = f"aggregate(sequence(1, {MAX_WALK}), {feistel_sql(row, n, seed)}, (w, i) -> if(w < {n}L, w, {feistel_sql('w', n, seed)}))"
    out = F.expr(walk)
    return F.when(out < n, out).otherwise(F.raise_error(F.lit("cycle walk did not end; use another seed")).cast("long"))


def numbered(rows: DataFrame, key: str, ties: list[str], rows_per_bucket: int = 200_000) -> tuple[DataFrame, int]:
    """rows with `row`, its number from 0 by key (nulls first), then ties; and the count.

    Value ranges of the key are counted and sorted apart; only counts by range
    meet in one place.
    """
    n = rows.count()
    bounds = order_bounds(rows, key, max(256, min(rows_per_bucket, n // 256 + 1)))
    dealt = rows.withColumn("_bucket", bucket_of(F.col(key), bounds))
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_bucket").orderBy(F.col(key).asc_nulls_first(), *ties)
    out = dealt.withColumn("_in", F.row_number().over(inside)).join(offsets, "_bucket")
    return out.withColumn("row", F.col("_before") + F.col("_in") - 1).drop("_bucket", "_in", "_before"), n


def shard(docs: DataFrame, shards: int = 8, seed: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs."""
    prepare(docs.sparkSession)
    narrow = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (utf8_len(F.col(text)) + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    # rows of equal id, size and checksum may change places, so a hot id is dealt to many cells by size, checksum and place
    ties = F.shiftleft(F.col("size"), 32).bitwiseOR(F.col("text_crc32"))
    rows = materialize(docs.sparkSession, narrow.withColumns({"ties": ties, "place": F.monotonically_increasing_id()}), "numbered")
    n = rows.count()
    rows = radix.ranked(rows, "doc_id", "ties", "place", [], 0)
    return rows.withColumn("_p", permuted("rank", n, seed)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.expr(f"_p div {shards}L").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
