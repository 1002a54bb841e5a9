"""Token ids in files of canonical, length-limited Huffman codes.

Texts are turned into ids, ids are counted over the whole corpus, and package-merge
gives each id a code of MAX_BITS bits at most; codes are canonical, so the code table
is one byte an id. Documents, in ascending order of id, lie in blocks that are decoded
apart from each other: a block names its documents and their numbers of ids, and has a
bit offset for every LANE ids (a checkpoint), from which table-driven decoding goes on
in step with all others. Blocks are rows of a table in the shared folder, whose writes
survive lost executors; where a block lies among all ids comes from digit histograms of
the document ids (``radix``), so nothing is sorted as a whole.

A block, little-endian: magic, number of documents, ids before it; then by document
its id, whether that is null, its number of ids, its bytes; then checkpoints; then
codes, each document from a byte's start.

Words between ASCII white space, cut where a letter is followed by punctuation or a
digit, are encoded once and remembered by each worker: this vocabulary's pre-tokens go
over neither place, so a text's ids are its pieces' ids in a row (a test holds them
against whole texts). A vocabulary that keeps white space needs another cut.

Nulls: a null text is empty and has the end id alone; a null document id sorts first.
Rows of equal id are ordered by a hash of their ids, then of their number. Repeated
rows have their own places. Empty input gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import radix
from lexmill.llm.common import discard, materialize, prepare

END_ID = 2
#: Bits of the longest code and ids between checkpoints.
MAX_BITS, LANE = 18, 256
#: Words a worker remembers before it starts anew.
WORDS = 1_000_000
#: A letter and an ASCII character that is none: no pre-token goes over this place.
LETTER_ENDS = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-;=-@\[-`{-~])"
#: Bytes of text, and eight times the ids, that are worked on at once.
LOT = 4 << 20
MAGIC = b"LXH1"


# ---- ids


class Words:
    """Ids of words by one tokenizer, remembered up to a bounded number of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # a special token between words marks their ends; words that hold its text are encoded alone
        special = sorted((i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark = special[-1] if special else None
        self.folds = self.alike("A", "a") and self.alike("Zq.", "zq.")
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def alike(self, a: str, b: str) -> bool:
        return self.tokenizer.encode(a, add_special_tokens=False).ids == self.tokenizer.encode(b, add_special_tokens=False).ids

    def each(self, words: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def in_row(self, words: list[str]) -> list[np.ndarray]:
        """Ids of words that don't hold the mark's text, many at a time."""
        number, text = self.mark
        rows = [words[i : i + 500] for i in range(0, len(words), 500)]
        out = []
        for row, e in zip(rows, self.tokenizer.encode_batch_fast([text.join([*r, ""]) for r in rows], add_special_tokens=False), strict=True):
            ids = np.asarray(e.ids, np.uint32)
            ends = np.flatnonzero(ids == number)
            # a mark that a longer special token swallowed
            out += [ids[a:b] for a, b in zip([0, *(ends[:-1] + 1)], ends, strict=True)] if len(ends) == len(row) else self.each(row)
        return out

    def learn(self, words: list[str]) -> None:
        if self.mark is None:
            apart, row = words, []
        else:
            apart = [w for w in words if self.mark[1][0] in w]
            row = [w for w in words if self.mark[1][0] not in w]
        found = [*(self.in_row(row) if row else []), *(self.each(apart) if apart else [])]
        for w in (*row, *apart):
            self.known[w] = len(self.known)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.ids = np.concatenate([self.ids, *found])

    def pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the pieces of all words in a row, pieces of each word): words cut where a letter ends, ASCII in lower case."""
        plain = pc.invert(pc.match_substring(words, self.mark[1][0])) if self.mark else pa.array([True] * len(words))
        if self.folds:
            words = pc.if_else(pc.and_(plain, pc.string_is_ascii(words)), pc.ascii_lower(words), words)
        lists = pc.ascii_split_whitespace(pc.if_else(plain, pc.replace_substring_regex(words, LETTER_ENDS, r"\1 \2"), words))
        split = lists.flatten().dictionary_encode()
        names = split.dictionary.to_pylist()
        if len(self.known) + len(names) > WORDS:
            self.clear()
        new = [w for w in names if w not in self.known]
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return at[split.indices.to_numpy()], lists.value_lengths().to_numpy()

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id; where each text's ids end)."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        split = lists.flatten().dictionary_encode()
        piece, n_pieces = self.pieces(split.dictionary)
        n = self.starts[piece + 1] - self.starts[piece]
        # ids of the distinct words in a row, and of the end id behind them
        flat = np.append(self.ids[spans(self.starts[piece], n)], np.uint32(end_id))
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(n_pieces)])]
        first, size = np.append(upto[:-1], len(flat) - 1), np.append(np.diff(upto), 1)
        n_words = lists.value_lengths().to_numpy()
        ends = np.cumsum(n_words + 1)
        slots = np.full(int(ends[-1]) if len(ends) else 0, len(size) - 1, np.int64)
        mask = np.ones(len(slots), bool)
        mask[ends - 1] = False
        slots[mask] = split.indices.to_numpy()
        counts = size[slots]
        return flat[spans(first[slots], counts)], np.cumsum(counts)[ends - 1]


def spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], ..., first[i] + n[i] - 1 for all i in a row."""
    upto = np.cumsum(n)
    out = np.arange(int(upto[-1]) if len(upto) else 0)
    out += np.repeat(first - upto + n, n)
    return out


_words: dict[str, Words] = {}


def words_of(path: str) -> Words:
    if path not in _words:
        _words[path] = Words(path)
    return _words[path]


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def width_of(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def lots(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `most` at most; a larger row is a run of its own."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if len(sizes) > first:
        yield first, len(sizes)


def tokens(docs: DataFrame, path: str | None, end_id: int = END_ID) -> DataFrame:
    """doc_id, number, n (ids), ids (their bytes) and a hash of these, for every row. path: null for the installed vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path or vocabulary_path())
        width = width_of(max(words.vocabulary, end_id + 1))
        for whole in batches:
            for first, end in lots(pc.fill_null(pc.binary_length(whole["text"]), 0).to_numpy(zero_copy_only=False), LOT):
                b = whole.slice(first, end - first)
                ids, ends = words.encode(b["text"], end_id)
                parts = [x.tobytes() for x in np.split(ids.astype(width), ends[:-1])]
                lengths = pa.array(np.diff(ends, prepend=0), pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["number"], lengths, binary(parts)], ["doc_id", "number", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("number"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, number long, n long, ids binary").withColumn("content", F.xxhash64("ids"))


def counts(rows: DataFrame, width: str) -> dict[int, int]:
    """How often each id occurs: one row an id of the vocabulary at most reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            found = np.bincount(np.frombuffer(b"".join(b["ids"].to_pylist()), width)) if b.num_rows else total[:0]
            more = np.zeros(max(len(found), len(total)), np.int64)
            more[: len(total)] += total
            more[: len(found)] += found
            total = more
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["id", "n"])

    return {r["id"]: r["n"] for r in rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


# ---- codes


def code_lengths(weights: list[int], most: int = MAX_BITS) -> list[int]:
    """Lengths of the least costly prefix code with words of `most` bits at most (package-merge)."""
    n = len(weights)
    if n < 2:
        return [1] * n
    if n > 1 << most:
        raise ValueError(f"{n} symbols don't fit codes of {most} bits")
    order = np.argsort(np.asarray(weights, dtype=object), kind="stable")
    # object only where sums could pass 63 bits
    kind = np.int64 if sum(weights).bit_length() + most.bit_length() < 62 else object
    single = np.asarray(weights, dtype=object)[order].astype(kind)
    row, chosen = single, [np.ones(n, bool)]
    for _ in range(most - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        at = np.argsort(both, kind="stable")
        row = both[at]
        chosen.append(at < n)
    lengths, take = np.zeros(n, np.int64), 2 * n - 2
    for is_single in reversed(chosen):
        singles = int(is_single[:take].sum())
        lengths[:singles] += 1
        take = 2 * (take - singles)
    out = np.zeros(n, np.int64)
    out[order] = lengths
    return out.tolist()


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids by length and id, code of each id): codes count up along that order."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    sizes = lengths[order].tolist()
    for i, size in zip(order.tolist(), sizes, strict=True):
        code <<= size - last
        codes[i], code, last = code, code + 1, size
    return order, codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, code length) by the next `bits` bits, and bits."""
    order, _ = canonical(lengths)
    bits = int(lengths.max()) if len(order) else 1
    each = 1 << (bits - lengths[order].astype(np.int64))
    ids, sizes = np.repeat(order, each), np.repeat(lengths[order], each)
    room = (1 << bits) - len(ids)  # a code of one id leaves half the table empty
    return np.append(ids, np.zeros(room, np.int64)).astype(np.uint32), np.append(sizes, np.ones(room, np.int64)).astype(np.int64), bits


def pack(ids: np.ndarray, ends: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(codes of all documents, each from a byte's start; where its bytes end; bit offset of every LANE-th id in its document)."""
    if not len(ids):
        return b"", np.zeros(len(ends), np.int64), np.zeros(0, np.uint32)
    size = lengths[ids].astype(np.int64)
    upto = np.cumsum(size)
    n = np.diff(ends, prepend=0)
    first = ends - n
    base = np.where(first > 0, upto[first - 1], 0)  # documents have an id at least
    bits = upto[ends - 1] - base
    byte_ends = np.cumsum((bits + 7) // 8)
    inside = upto - size - np.repeat(base, n)
    at = np.repeat((byte_ends - (bits + 7) // 8) * 8, n) + inside
    word = codes[ids].astype(np.uint64) << (32 - size - (at & 7)).astype(np.uint64)
    place, total = at >> 3, int(byte_ends[-1]) + 4
    out = np.zeros(total)
    for k in range(4):
        # bits of different codes never meet, so sums are unions
        out += np.bincount(place + k, weights=(word >> np.uint64(24 - 8 * k)) & np.uint64(255), minlength=total)
    nth = np.arange(len(ids)) - np.repeat(first, n)
    return out.astype(np.uint8)[: int(byte_ends[-1])].tobytes(), byte_ends, inside[nth % LANE == 0].astype(np.uint32)


def unpack(data: bytes, starts: np.ndarray, n: np.ndarray, marks: np.ndarray, table: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Ids of documents that start at the given bytes: all lanes go on by one id at a time."""
    ids, sizes, bits = table
    raw = np.frombuffer(data + b"\0" * 4, np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    lanes = -(-n // LANE)
    at = np.repeat(starts * 8, lanes) + marks
    nth = np.arange(len(at)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    left = np.minimum(np.repeat(n, lanes) - nth * LANE, LANE)
    to = np.repeat(np.cumsum(n) - n, lanes) + nth * LANE
    order = np.argsort(-left, kind="stable")
    at, to, left = at[order], to[order], left[order]
    live = np.searchsorted(-left, -np.arange(LANE), side="left")  # lanes with more than t ids
    out = np.zeros(int(n.sum()), np.uint32)
    for t in range(LANE):
        k = live[t]
        if not k:
            break
        here = at[:k]
        code = (ahead[here >> 3] >> (32 - bits - (here & 7)).astype(np.uint32)) & np.uint32((1 << bits) - 1)
        out[to[:k] + t] = ids[code]
        at[:k] += sizes[code]
    return out


# ---- blocks

HEAD = struct.Struct("<4sIq")
#: By document: id, whether it is null, its number of ids, its bytes.
ENTRY = np.dtype([("id", "<i8"), ("null", "u1"), ("n", "<i8"), ("bytes", "<i8")])


def block(start: int, documents: list[tuple[int | None, int, bytes, bytes]]) -> bytes:
    """One block of (id, number of ids, checkpoints, codes) in order."""
    table = np.array([(i or 0, i is None, n, len(codes)) for i, n, _, codes in documents], ENTRY)
    return b"".join([HEAD.pack(MAGIC, len(documents), start), table.tobytes(), *(m for _, _, m, _ in documents), *(c for *_, c in documents)])


def read_block(data: bytes, decoder: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, int, np.ndarray]:
    """(table of documents, ids before the block, all its ids)."""
    magic, count, start = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    table = np.frombuffer(data, ENTRY, count, HEAD.size)
    at = HEAD.size + table.nbytes
    n_marks = int((-(-table["n"] // LANE)).sum())
    marks = np.frombuffer(data, "<u4", n_marks, at)
    ends = np.cumsum(table["bytes"])
    return table, start, unpack(data[at + 4 * n_marks :], ends - table["bytes"], table["n"].astype(np.int64), marks.astype(np.int64), decoder)


def write(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, DataFrame]:
    """(blocks: start, block; code: lengths) as tables of the shared folder."""
    prepare(spark)
    vocabulary = max(words_of(path or vocabulary_path()).vocabulary, end_id + 1)
    width = width_of(vocabulary)
    rows = materialize(spark, tokens(docs, path, end_id), "tokens")
    found = counts(rows, width)
    sizes = np.zeros(vocabulary, np.uint8)
    sizes[list(found)] = code_lengths(list(found.values()), max(MAX_BITS, math.ceil(math.log2(max(2, len(found))))))
    code = materialize(spark, spark.createDataFrame([(bytearray(sizes.tobytes()),)], "lengths binary"), "code")
    celled, names = radix.celled(rows, "doc_id", "content", "number", [])
    starts = radix.before(celled, [], names, {"start": F.col("n")})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(sizes)[1]
        for whole in batches:
            for first, end in lots(whole["n"].to_numpy(), LOT // 8):
                b = whole.slice(first, end - first)
                n = b["n"].to_numpy()
                data, byte_ends, marks = pack(np.frombuffer(b"".join(b["ids"].to_pylist()), width), np.cumsum(n), sizes, codes)
                lanes = np.cumsum(-(-n // LANE))
                packed = [data[a:z] for a, z in zip([0, *byte_ends[:-1]], byte_ends, strict=True)]
                marked = [marks[a:z].tobytes() for a, z in zip([0, *lanes[:-1]], lanes, strict=True)]
                rest = [c for c in b.schema.names if c != "ids"]
                yield pa.RecordBatch.from_arrays([*(b[c] for c in rest), binary(marked), binary(packed)], [*rest, "marks", "codes"])

    keep = "doc_id long, number long, n long, content long, " + ", ".join(f"{c} int" for c in names)
    packed = celled.select("doc_id", "number", "n", "content", "ids", *names).mapInArrow(encode, f"{keep}, marks binary, codes binary")

    def gather(left: pa.Table, right: pa.Table) -> pa.Table:
        got = sorted(left.to_pylist(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["content"] >> 28 & (1 << 36) - 1, r["mixed"], r["content"], r["number"]))
        start = right["start"][0].as_py()
        data = block(start, [(r["doc_id"], r["n"], r["marks"], r["codes"]) for r in got])
        return pa.table({"start": pa.array([start], pa.int64()), "block": binary([data])})

    mixed = F.xxhash64("number").bitwiseAND(F.lit((1 << radix.DEEP) - 1))
    cells = packed.withColumn("mixed", mixed).groupBy(*names).cogroup(starts.groupBy(*names)).applyInArrow(gather, "start long, block binary")
    blocks = materialize(spark, cells, "blocks")
    discard(spark, rows)
    return blocks, code


def read(blocks: DataFrame, code: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the blocks."""
    first = code.first()
    lengths = np.frombuffer(bytes(first["lengths"]), np.uint8).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decoding_table(lengths)
        for b in batches:
            for data in b["block"]:
                table, start, ids = read_block(data.as_py(), decoder)
                ends = np.cumsum(table["n"])
                sums = [zlib.crc32(x.astype("<u4")) for x in np.split(ids, ends[:-1])]
                columns = [
                    pa.array(table["id"].astype(np.int64), mask=table["null"].astype(bool)),
                    pa.array(start + ends - table["n"], pa.int64()),
                    pa.array(table["n"].astype(np.int64)),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """What the written files hold about each row of docs."""
    return read(*write(spark, docs, path, end_id))
