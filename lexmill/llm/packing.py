"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. A document longer than the longest is cut
into pieces of that length and a rest. Pieces, longest first, go into the open
sequence with the least room that still holds them; where none does, a sequence
of the least cost for each token it can hope to hold is opened. The opening
lengths are optimised jointly: each block is packed once for every ceiling on the
opening length, every sequence is downsized to the shortest permitted length that
holds its contents, and the packing of least total cost stays.

Blocks of about block_rows documents, dealt by a hash of the id, are packed
independently, so the work is spread however large the corpus is; a block leaves
few sequences partly filled.

Nulls: a null text is empty; a null id is an id of its own. Documents without
tokens give one row with no sequence. Rows with equal ids and lengths are counted
first and told apart by `copy`, so that they too are dealt to blocks. Empty input gives an empty result. Only ids and lengths move.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import prepare
from lexmill.llm.mixing import token_count

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its length, a fixed overhead, and attention in proportion to the square.
OVERHEAD = 16
QUADRATIC = 1 / 65536
#: Copies of one row that one task makes.
COPIES_EACH = 65536


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + QUADRATIC * capacity * capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], ceiling: int) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: each piece's bin and offset, and each bin's contents.

    Bins are opened at capacities up to ceiling, or at the least that holds the piece.
    """
    rooms: dict[int, list[int]] = {}  # room -> bins with so much room
    mask = 0  # bit r is set if a bin has room r
    size: list[int] = []
    used: list[int] = []
    bins: list[int] = []
    offsets: list[int] = []
    rest = sum(lengths)
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            able = [c for c in capacities if c >= n]
            able = [c for c in able if c <= ceiling] or able[:1]
            room = min(able, key=lambda c: (cost(c) / min(c, rest), c))
            b = len(size)
            size.append(room)
            used.append(0)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        rest -= n
        room -= n
        if room:
            if not rooms.setdefault(room, []):
                mask |= 1 << room
            rooms[room].append(b)
    return bins, offsets, used


def pack_block(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int], list[int]]:
    """The cheapest packing over all ceilings: bins, offsets, contents and downsized capacities."""
    best = None
    for ceiling in capacities:
        bins, offsets, used = best_fit(lengths, capacities, ceiling)
        final = [next(c for c in capacities if c >= u) for u in used]
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = total, (bins, offsets, used, final)
    return best[1]


def pieces_of(n: int, most: int) -> list[int]:
    return [most] * (n // most) + ([n % most] if n % most else [])


SCHEMA = (
    "doc_id long, copy long, piece int, piece_start long, n_tokens long, sequence_id long, sequence_offset int, "
    "sequence_capacity int, sequence_tokens int"
)


def packer(capacities: tuple[int, ...]):
    most = capacities[-1]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["tokens", "doc_id", "copy"], ascending=[False, True, True], na_position="last", kind="stable")
        rows = []
        for i, n, copy in zip(block["doc_id"].tolist(), block["tokens"].tolist(), block["copy"].tolist(), strict=True):
            for k, m in enumerate(pieces_of(n, most) or [0]):
                rows.append((None if i is None or i != i else i, copy, k, k * most, m))
        rows.sort(key=lambda r: -r[4])
        full = [r for r in rows if r[4]]
        bins, offsets, used, final = pack_block([r[4] for r in full], capacities) if full else ([], [], [], [])
        base = int(block["block"].iloc[0]) << 24
        out = [(*r, base + b, o, final[b], used[b]) for r, b, o in zip(full, bins, offsets, strict=True)]
        out += [(*r, None, None, None, None) for r in rows if not r[4]]
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])
        for c in ("doc_id", "sequence_id", "sequence_offset", "sequence_capacity", "sequence_tokens"):
            frame[c] = frame[c].astype("Int64")
        return frame

    return run


def pack(
    docs: DataFrame,
    capacities: tuple[int, ...] = CAPACITIES,
    block_rows: int = 2048,
    tokens: Column | None = None,
    key: str = "doc_id",
) -> DataFrame:
    """A row for each piece: where it lies in its document and in which sequence, with the sequence's length."""
    prepare(docs.sparkSession)
    capacities = tuple(sorted(capacities))
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), (token_count(F.col("text")) if tokens is None else tokens).alias("tokens"))
    blocks = max(1, math.ceil(docs.count() / block_rows))
    # a long document brings many pieces, but a block's load is even over blocks of thousands of documents
    alike = narrow.groupBy("doc_id", "tokens").agg(F.count(F.lit(1)).alias("n"))
    # the copies of one row are made in several tasks
    runs = alike.withColumn("run", F.explode(F.expr(f"sequence(0L, (n - 1) div {COPIES_EACH})"))).repartition("doc_id", "tokens", "run")
    copy = F.explode(F.expr(f"sequence(run * {COPIES_EACH}, least(n, (run + 1) * {COPIES_EACH}) - 1)"))
    dealt = runs.select("doc_id", "tokens", copy.alias("copy")).withColumn("block", F.pmod(F.xxhash64("doc_id", "tokens", "copy"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(packer(capacities), SCHEMA)


def fill_rate(used: np.ndarray, capacity: np.ndarray) -> float:
    """Share of the sequences' length that tokens take."""
    return float(used.sum() / capacity.sum()) if len(used) else 1.0
