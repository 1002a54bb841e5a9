"""N-gram Jaccard join by PartEnum signatures, and its connected components.

A document's set is its distinct word shingles. Sets of a Jaccard similarity of at
least num / den differ in at most k features, where k follows from their sizes.
Sizes are cut into bands; the instance of a band serves all pairs whose larger set
lies in it. An instance deals the feature domain to n1 x n2 partitions with
n1 * (k2 + 1) > k: by the pigeonhole principle two similar sets differ in at most k2
of the n2 parts of some first-level partition, so they agree on a subset of
n2 - k2 parts. Every such subset gives a signature (an order-free hash of the
features in it), and similar sets share one. Here k2 is 0 or 1, and the shape is
the one of fewest signatures that hold FEATURES_EACH features on average.

Only texts whose sets are different are joined: equal sets form a class, whatever
the number of copies. A signature that very many sets share is dealt to parts, so
that none is sorted in one task. Members are not paired with all others:

1. Members are chained in two orders; each set is verified with those of its
   neighbours that it shares most places of chains with, NEAREST in all.
2. Verified links give components.
3. Where a signature still has members of several components, the pairs between
   different components that were not verified yet are verified too, all of them,
   so that no link is lost; pairs inside a component can't change it.

So a family of near copies gives step 1 a number of pairs in proportion to its members,
whatever the number of signatures; step 3 forms its pairs inside a join whose condition
holds two bitmaps, and only those that the bitmaps leave open become rows.

Before whole shingle sets are compared, parity bitmaps rule pairs out: each feature
flips one bit of its set's bitmap, so two bitmaps differ in no more bits than the
sets in features, and a pair of more differing bits than similar sets may have in
features is certainly no link. Links and components stay in tables.

Nulls: a null text has no shingles and, like a text without words, is linked with
nothing; rows with a null id belong to classes like others, and the smallest id
leaves them out. Repeated ids are judged row by row. Empty input gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm.common import discard, materialize, prepare
from lexmill.llm.sharding import numbered
from lexmill.llm.textfeat import Words, mix, slices

FEATURES_EACH, SLACK = 2, 1.25
BAND_RATIO = 1.4
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


@lru_cache
def bands(upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest set size of each band, for sizes up to `upto` at least."""
    lows, highs, low = [], [], 1
    while True:
        high = max(low, math.floor(low * BAND_RATIO))
        lows.append(low)
        highs.append(high)
        if high >= upto:
            return np.array(lows), np.array(highs)
        low = high + 1


def distance(high: int, num: int, den: int) -> int:
    """The most features that two similar sets of at most `high` features can differ in."""
    return (den - num) * 2 * high // (den + num)


@lru_cache
def shape(low: int, high: int, num: int, den: int) -> tuple[int, int]:
    """(n1, n2) of the instance of a band; k2 is 1 if n2 is over 1, else 0.

    SLACK more first-level partitions than needed let a set leave its poorest parts unsigned.
    """
    k = distance(high, num, den)
    least = -(-low * num // den)
    if not k:
        return 1, 1
    found = [(math.ceil(SLACK * (-(-(k + 1) // 2))), n2) for n2 in (2, 3, 4)]
    each = lambda n1, n2: least * (n2 - 1) / (n1 * n2)
    rich = [s for s in found if each(*s) >= FEATURES_EACH]
    return min(rich, key=lambda s: s[0] * s[1]) if rich else max(found, key=lambda s: each(*s))


def sets_of(texts: list[bytes], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, end, the distinct shingles' hashes by text, and their bounds."""
    for at, to in slices(texts):
        grams, owner = Words(texts[at:to]).grams(width)
        order = np.lexsort((grams, owner))
        grams, owner = grams[order], owner[order]
        if len(grams):
            fresh = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])]
            grams, owner = grams[fresh], owner[fresh]
        yield at, to, grams, np.searchsorted(owner, np.arange(to - at + 1))


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def identities(grams: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    return mix(sums(mix(grams), cuts)).view(np.int64), mix(sums(mix(grams ^ SECOND), cuts)).view(np.int64)


#: 64-bit words of a short bitmap, the same for all sizes, that is compared first, and of a longer one that is compared next.
SHORT, MIDDLE = 4, 16
META = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("sid", pa.int64()),
        ("twin", pa.int64()),
        ("n_shingles", pa.int64()),
        *((f"q{i}", pa.int64()) for i in range(SHORT)),
        ("middle", pa.list_(pa.int64())),
        ("bits", pa.list_(pa.int64())),
    ]
)
META_SQL = "doc_id long, sid long, twin long, n_shingles long, " + "".join(f"q{i} long, " for i in range(SHORT)) + "middle array<long>, bits array<long>"


def describe(width: int):
    """Each row's set: its hashes, size and bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            sid, twin, n = (np.zeros(len(texts), np.int64) for _ in range(3))
            maps, middles, shorts = [], [], [np.zeros((0, SHORT), np.int64)]
            for at, to, grams, cuts in sets_of(texts, width):
                sid[at:to], twin[at:to] = identities(grams, cuts)
                n[at:to] = np.diff(cuts)
                maps += bitmaps(grams, cuts)
                shorts.append(short_bitmaps(grams, cuts, SHORT))
                middles += list(short_bitmaps(grams, cuts, MIDDLE))
            quick = [pa.array(q) for q in np.concatenate(shorts).T.copy()]
            long = [pa.array(x, META.field("bits").type) for x in (middles, maps)]
            rows = [batch.column(0), pa.array(sid), pa.array(twin), pa.array(n), *quick, *long]
            yield pa.RecordBatch.from_arrays(rows, schema=META)

    return run


def least_features(held: np.ndarray, owner: np.ndarray, local: np.ndarray, width: np.ndarray, most: np.ndarray) -> np.ndarray:
    """For each set the greatest c so that signatures of c features or more suffice, where `most` features may differ.

    To spoil all such signatures of a first-level partition takes no differing feature if none has c features, one if
    only some have (a part that all of those hold), and two if all have. If that adds up to more than `most`, a similar
    set agrees on one of them; it holds as many features there, so it signs it too if its own c is no greater, and
    the set of the greater c decides for both.
    """
    heads = np.flatnonzero(local % width == 0)
    two = width[heads] > 1
    cost = np.concatenate([np.maximum.reduceat(held, heads), np.minimum.reduceat(held, heads)[two]])
    of_set = np.concatenate([owner[heads], owner[heads][two]])
    order = np.lexsort((-cost, of_set))
    start = np.searchsorted(of_set[order], np.arange(len(most)))
    return cost[order][start + most]


def signatures(grams: np.ndarray, cuts: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some sets, and the number of the set that each belongs to."""
    n = np.diff(cuts)
    filled = np.flatnonzero(n)
    if not len(filled):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # bands up to one whose least size no set here can be similar to
    lows, highs = bands(1 << int(2 * n.max() * den // num + 1).bit_length())
    spread = mix(grams)
    own = np.searchsorted(highs, n)
    out, owners = [], []
    shift = 0
    while True:
        band = own + shift
        sets = filled[n[filled] * den >= lows[np.minimum(band[filled], len(lows) - 1)] * num]
        if not len(sets):
            return np.concatenate(out), np.concatenate(owners)
        b = band[sets]
        shapes = np.array([shape(int(lows[x]), int(highs[x]), num, den) for x in range(len(lows))])
        n1, n2 = shapes[b].T
        parts = n1 * n2
        base = np.r_[0, np.cumsum(parts)]
        # all features of these sets, each with its set's place
        size = n[sets]
        place = np.repeat(np.arange(len(sets)), size)
        at = np.repeat(cuts[sets], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        cell = base[place] + ((grams[at] >> np.uint64(8)) % parts[place].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        bounds = np.searchsorted(cell[order], np.arange(base[-1] + 1))
        part = sums(spread[at][order], bounds)
        owner = np.repeat(np.arange(len(sets)), parts)
        local = np.arange(base[-1]) - base[owner]
        # a first-level partition is n2 parts in a row; leaving one part out is its total less that part
        width = n2[owner]
        total = np.r_[np.uint64(0), np.cumsum(part)]
        start = base[owner] + local // width * width
        rest = np.where(width > 1, total[start + width] - total[start] - part, part)
        held = np.where(width > 1, bounds[start + width] - bounds[start] - (bounds[1:] - bounds[:-1]), bounds[1:] - bounds[:-1])
        most = (den - num) * (size + np.minimum(highs[b], size * den // num)) // (den + num)
        rich = held >= least_features(held, owner, local, width, most)[owner]
        tag = mix((b[owner].astype(np.uint64) << np.uint64(40)) + local.astype(np.uint64))
        out.append(mix(rest + tag)[rich])
        owners.append(sets[owner[rich]])
        shift += 1


SIGNED = pa.schema([("sig", pa.int64()), ("part", pa.int32()), ("sid", pa.int64())])
#: A signature of more sets than HOT in one batch is dealt to PARTS parts, in SPREADS different ways by signature.
HOT, PARTS, SPREADS = 256, 256, 4


def parts_of(sig: np.ndarray, sid: np.ndarray, hot: int) -> np.ndarray:
    """0, or for hot signatures the part that each row is dealt to.

    Two rows of a hot signature stay in part 0, where sets of other batches meet them; the rest, in parts over 0, are
    known not to be alone. Different spreads let the parts of one group overlap over its signatures.
    """
    order = np.argsort(sig, kind="stable")
    fresh = np.r_[True, sig[order][1:] != sig[order][:-1]]
    start = np.flatnonzero(fresh)
    run = np.cumsum(fresh) - 1
    many = np.diff(np.r_[start, len(sig)])[run] > hot
    away = order[many & (np.arange(len(sig)) - start[run] >= 2)]
    part = np.zeros(len(sig), np.int32)
    spread = mix(sig[away]) % np.uint64(SPREADS)
    part[away] = 1 + (mix(sid[away].view(np.uint64) + spread) % np.uint64(PARTS - 1)).astype(np.int32)
    return part


def sign(width: int, num: int, den: int, hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies in one task are signed once
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(0).to_pylist()]
            sigs, sids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, _, grams, cuts in sets_of(texts, width):
                sid, _ = identities(grams, cuts)
                new = np.zeros(len(sid), bool)
                for i, s in enumerate(sid.tolist()):
                    if s not in seen:
                        seen.add(s)
                        new[i] = True
                sig, owner = signatures(grams, cuts, num, den)
                keep = new[owner]
                sigs.append(sig[keep])
                sids.append(sid[owner[keep]])
            sig, sid = np.concatenate(sigs), np.concatenate(sids)
            if len(sig):
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(parts_of(sig, sid, hot)), pa.array(sid)], schema=SIGNED)

    return run


CHAINED = pa.schema([("sig", pa.int64()), ("sid", pa.int64()), ("before", pa.int64()), ("before2", pa.int64())])
#: Members of a signature that are put in the second order at a time.
WINDOW = 1024


def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of more than one set, each member with its neighbours; rows are sorted by sig, sid.

    A group is what a task has of a signature. Rows wait until their group is complete,
    but for groups of very many rows, which are given out piece by piece.
    """
    waiting = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
    last: tuple[int, int] | None = None  # the last row given out

    def give(sig: np.ndarray, part: np.ndarray, sid: np.ndarray) -> pa.RecordBatch | None:
        nonlocal last
        fresh = np.r_[True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])] if len(sig) else np.zeros(0, bool)
        if len(sig) and (int(sig[0]), int(sid[0])) == last:
            fresh[0] = False
        sig, part, sid = sig[fresh], part[fresh], sid[fresh]
        if not len(sig):
            return None
        linked = np.r_[False, sig[1:] == sig[:-1]]
        before = np.r_[0, sid[:-1]]
        if last is not None and int(sig[0]) == last[0]:
            before[0], linked[0] = last[1], True
        many = linked | np.r_[linked[1:], False] | (part > 0)
        # the second order, inside windows, takes the members by a hash of theirs
        group = np.cumsum(~linked)
        window = np.arange(len(sig)) // WINDOW
        order = np.lexsort((mix(sid.view(np.uint64)), window, group))
        close = (group[order][1:] == group[order][:-1]) & (window[order][1:] == window[order][:-1])
        second, second_on = np.zeros(len(sid), np.int64), np.zeros(len(sid), bool)
        second[order[1:][close]] = sid[order[:-1][close]]
        second_on[order[1:][close]] = True
        last = int(sig[-1]), int(sid[-1])
        columns = [pa.array(sig[many]), pa.array(sid[many]), pa.array(before[many], mask=~linked[many]), pa.array(second[many], mask=~second_on[many])]
        return pa.RecordBatch.from_arrays(columns, schema=CHAINED)

    for batch in batches:
        if not batch.num_rows:
            continue
        sig, part, sid = (np.concatenate([w, batch.column(i).to_numpy()]) for i, w in enumerate(waiting))
        earlier = np.flatnonzero(sig != sig[-1])
        cut = int(earlier[-1]) + 1 if len(earlier) else 0
        if cut == 0 and len(sig) > 1 << 20:
            cut = len(sig) - 1
        out = give(sig[:cut], part[:cut], sid[:cut])
        if out is not None:
            yield out
        waiting = [sig[cut:], part[cut:], sid[cut:]]
    out = give(*waiting)
    if out is not None:
        yield out


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def verify(width: int, num: int, den: int):
    """Links between classes: rows are sorted by key, the header (member null) first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, heads = None, []
        for batch in batches:
            a, b = [], []
            head, part, members, classes = (batch.column(i).to_pylist() for i in range(4))
            keys = list(zip(head, part, strict=True))
            texts = [t.encode() for t in batch.column(4).to_pylist()]
            for at, to, grams, cuts in sets_of(texts, width):
                for i in range(at, to):
                    x = grams[cuts[i - at] : cuts[i - at + 1]]
                    if keys[i] != key:
                        key, heads = keys[i], []
                    if members[i] is None:
                        heads.append((classes[i], x.copy()))
                        continue
                    for other, y in heads:
                        low, high = sorted((len(x), len(y)))
                        if low * den < num * high:
                            continue
                        same = len(np.intersect1d(x, y, assume_unique=True))
                        if den * same >= num * (len(x) + len(y) - same):
                            a.append(min(classes[i], other))
                            b.append(max(classes[i], other))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=LINKS)

    return run


def similar_short(a: str, b: str, num: int, den: int) -> Column:
    """False only for pairs that sizes or short bitmaps prove to be dissimilar; a, b: aliases of rows with n and q0, q1 and so on."""
    sized = f"{a}.n * {den} >= {b}.n * {num} and {b}.n * {den} >= {a}.n * {num}"
    short = " + ".join(f"bit_count({a}.q{i} ^ {b}.q{i})" for i in range(SHORT))
    return F.expr(f"{sized} and ({short}) * {den + num}L <= {den - num}L * ({a}.n + {b}.n)")


def similar_middle(a: str, b: str, num: int, den: int) -> Column:
    """The same by the bitmaps of MIDDLE words."""
    differing = " + ".join(f"bit_count({a}.middle[{i}] ^ {b}.middle[{i}])" for i in range(MIDDLE))
    return F.expr(f"({differing}) * {den + num}L <= {den - num}L * ({a}.n + {b}.n)")


def similar_bits(a: str, b: str, num: int, den: int) -> Column:
    """The same by the whole bitmaps, for pairs that pass similar_short()."""
    common = f"least(size({a}.bits), size({b}.bits))"

    def folded(x: str) -> str:
        # sizes within the ratio have bitmaps of equal length, or of one doubling
        half = f"size({x}.bits) div 2"
        return f"if(size({x}.bits) = {common}, {x}.bits, zip_with(slice({x}.bits, 1, {half}), slice({x}.bits, {half} + 1, {half}), (p, q) -> p ^ q))"

    differing = f"aggregate(zip_with({folded(a)}, {folded(b)}, (p, q) -> bit_count(p ^ q)), 0, (t, p) -> t + p)"
    return F.expr(f"{differing} * {den + num}L <= {den - num}L * ({a}.n + {b}.n)")


def possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The distinct pairs (a, b) that sizes and bitmaps don't rule out."""
    short = [c for c in sketches.columns if c not in ("sid", "middle", "bits")]
    for fields, similar in ((short, similar_short), (["n", "bits"], similar_bits)):
        left = sketches.select(F.col("sid").alias("a"), F.struct(*fields).alias("x"))
        right = sketches.select(F.col("sid").alias("b"), F.struct(*fields).alias("y"))
        pairs = pairs.join(left, "a").join(right, "b").where(similar("x", "y", num, den)).select("a", "b").distinct()
    return pairs


#: Members that are compared with one copy of their head.
MEMBERS = 4096


def links_of(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) between classes, from pairs (a, b) of set hashes and texts (sid, cls, text)."""
    dealt = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts")), "a")
    dealt = dealt.select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    heads = dealt.select("a", "part").distinct().join(texts, F.col("a") == F.col("sid"))
    members = dealt.join(texts, F.col("b") == F.col("sid"))
    rows = heads.select("a", "part", F.lit(None).cast("long").alias("b"), "cls", "text").unionByName(members.select("a", "part", "b", "cls", "text"))
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return rows.mapInArrow(verify(width, num, den), "a long, b long")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges with the same components: each node of a task with its least node; flushed in parts of bounded size."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def give() -> pa.RecordBatch:
        rows = [(r, x) for x in parent if (r := find(x)) != x]
        parent.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], schema=LINKS)

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > 1_000_000:
            yield give()
    yield give()


def connected(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, label) with the least node reachable, for every node of links (a, b); all state is in tables."""
    edges = materialize(spark, links.select("a", "b").mapInArrow(stars, "a long, b long").distinct(), "edges")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = materialize(spark, labels, "labels")
    while True:
        told = both.join(labels, F.col("a") == F.col("node")).select(F.col("b").alias("node"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("node", "label", F.col("label").alias("old"))
        # what a node's label has become is a shorter way than the node's own links
        ahead = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        jumped = labels.join(ahead, F.col("label") == F.col("_n")).select("node", F.col("_l").alias("label"), F.lit(None).cast("long").alias("old"))
        new = own.unionByName(told).unionByName(jumped).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        new = materialize(spark, new, "labels")
        changed = new.where("label < old").limit(1).count()
        discard(spark, labels)
        if not changed:
            discard(spark, edges)
            out = new.select("node", "label")
            out._lexmill_path = new._lexmill_path
            return out
        labels = new.drop("old")
        labels._lexmill_path = new._lexmill_path


def classes_of(meta: DataFrame) -> DataFrame:
    return meta.groupBy("sid", "twin", "n_shingles").agg(F.min("doc_id").alias("cls"))


def split_groups(placed: DataFrame) -> DataFrame:
    """(sig) of the groups with several labels in placed (sig, sid, label), one for each list of members.

    Signatures of the same members give the same pairs: one of them is enough. A group may hold a member twice, which
    bit_xor would cancel, so members are told by sums of their hashes' halves, which can't overflow.
    """
    halves = [h for s in (F.xxhash64("sid"), F.xxhash64("sid", F.lit(1))) for h in (F.shiftrightunsigned(s, 32), s.bitwiseAND(F.lit((1 << 32) - 1)))]
    hashes = [F.sum(h).alias(f"h{i}") for i, h in enumerate(halves)]
    groups = placed.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k"), *hashes)
    return groups.where("x < y").groupBy("k", "h0", "h1", "h2", "h3").agg(F.min("sig").alias("sig")).select("sig")


#: Neighbours in chains that a set is verified with at first.
NEAREST = 8


def nearest(members: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of each set and the NEAREST sets that come before it in most chains of members' (sid, before, before2)."""
    chains = members.select(F.explode(F.array("before", "before2")).alias("a"), F.col("sid").alias("b")).where("a is not null")
    most = Window.partitionBy("b").orderBy(F.col("count").desc(), F.xxhash64("a", "b"))  # ties by chance, so that not all take the same few
    close = chains.groupBy("a", "b").count().withColumn("_r", F.row_number().over(most)).where(F.col("_r") <= NEAREST)
    return close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


#: Members of a group whose pairs are formed in one task, and the least signatures of a set that go with each of its rows.
BLOCK, LEAST = 2048, 16


def pairs_apart(split: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs (a, b) of split's (sig, sid, label) that share a signature but no label, and that the shorter bitmaps don't rule out.

    A group of more than BLOCK members is dealt to blocks; each two blocks, and each block with itself, meet in a cell
    of their own.
    """
    blocks = split.groupBy("sig").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    short = sketches.drop("bits")
    least = split.groupBy("sid").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LEAST).alias("least"))
    rows = split.join(blocks, "sig").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).join(short, "sid").join(least, "sid")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("cell", F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"))
    left, right = rows.alias("l"), rows.alias("r")
    same = (F.col("l.sig") == F.col("r.sig")) & (F.col("l.cell") == F.col("r.cell"))
    # a cell of two blocks is for their mixed pairs only
    mixed = (F.col("l.block") != F.col("r.block")) | (F.col("l.block") == F.col("l.other"))
    apart = same & (F.col("l.sid") < F.col("r.sid")) & (F.col("l.label") != F.col("r.label")) & mixed
    # near copies share very many signatures: what is certainly no link, or meets in a lesser signature too, is not to leave the join
    met = F.exists("l.least", lambda sig: (sig < F.col("l.sig")) & F.array_contains("r.least", sig))
    found = left.join(right, apart & similar_short("l", "r", num, den) & similar_middle("l", "r", num, den) & ~met)
    return found.select(F.col("l.sid").alias("a"), F.col("r.sid").alias("b")).distinct()


def components(spark: SparkSession, docs: DataFrame, width: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) for every row of docs."""
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    meta = materialize(spark, rows.mapInArrow(describe(width), META_SQL), "sets")
    classes = materialize(spark, classes_of(meta.where("n_shingles > 0")).where("cls is not null"), "classes")

    signed = rows.select("text").mapInArrow(sign(width, num, den, HOT), "sig long, part int, sid long")
    members = signed.repartition("sig", "part").sortWithinPartitions("sig", "sid").mapInArrow(chain, "sig long, sid long, before long, before2 long")
    members = materialize(spark, members, "members")

    # the bitmaps of one row for each class that shares a signature; rows that repeat an id may hold other sets
    nodes = members.select("sid").distinct().join(classes, "sid").select("sid", "cls")
    maps = [*[f"q{i}" for i in range(SHORT)], "middle", "bits"]
    first = meta.select("doc_id", "sid", F.col("n_shingles").alias("n"), *maps)
    sketches = first.join(nodes, (first.doc_id == nodes.cls) & (first.sid == nodes.sid)).select(first.sid, "n", *maps)
    sketches = materialize(spark, sketches.dropDuplicates(["sid"]), "sketches")

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct().join(classes, "sid")
        wanted = rows.where("doc_id is not null").join(ends, F.col("doc_id") == F.col("cls")).select("sid", "cls", "text")
        texts = materialize(spark, wanted.mapInArrow(own_texts(width), TEXTS_SQL), "texts")
        links = materialize(spark, links_of(pairs, texts, width, num, den).distinct(), "links")
        discard(spark, texts)
        return links

    pairs = materialize(spark, possible(nearest(members), sketches, num, den), "pairs")
    links = verified(pairs)
    labels = connected(spark, links)

    # what the chains left open: members of one signature in different components
    of_set = classes.join(labels, F.col("cls") == F.col("node"), "left").groupBy("sid").agg(F.min(F.coalesce("label", "cls")).alias("label"))
    of_set = materialize(spark, of_set, "set-labels")
    placed = members.select("sig", "sid").join(of_set, "sid")
    split = materialize(spark, placed.join(split_groups(placed), "sig", "left_semi").distinct(), "split")
    discard(spark, members)
    rest = materialize(spark, possible(pairs_apart(split, sketches, num, den).join(pairs, ["a", "b"], "left_anti"), sketches, num, den), "rest")
    done = [pairs, of_set, split, sketches]
    if rest.limit(1).count():
        more = verified(rest)
        if more.limit(1).count():
            done += [links, more, labels]
            labels = connected(spark, links.unionByName(more))
    final = classes.join(labels, F.col("cls") == F.col("node"), "left").select("sid", "twin", F.coalesce("label", "cls").alias("label"))
    final = materialize(spark, final, "components")
    for table in (*done, rest, classes):
        discard(spark, table)
    out = meta.select("doc_id", "sid", "twin", "n_shingles").join(final, ["sid", "twin"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"))


def bitmaps(grams: np.ndarray, cuts: np.ndarray) -> list[np.ndarray]:
    """For each set the parities of its features by hash, over a power of two of at least twice as many bits."""
    out = []
    for at, to in zip(cuts[:-1], cuts[1:], strict=True):
        size = max(64, 1 << int(2 * (to - at) - 1).bit_length()) if to > at else 64
        parity = np.bincount((grams[at:to] % np.uint64(size)).astype(np.int64), minlength=size).astype(np.uint8) & 1
        out.append(np.packbits(parity, bitorder="little").view(np.int64))
    return out


def short_bitmaps(grams: np.ndarray, cuts: np.ndarray, words: int) -> np.ndarray:
    """For each set the parities of its features by hash over so many words, a row each."""
    size, n = 64 * words, len(cuts) - 1
    owner = np.repeat(np.arange(n), np.diff(cuts))
    parity = np.bincount(owner * size + (grams % np.uint64(size)).astype(np.int64), minlength=n * size).astype(np.uint8) & 1
    return np.packbits(parity.reshape(n, size), axis=1, bitorder="little").view(np.int64)


TEXTS = pa.schema([("sid", pa.int64()), ("cls", pa.int64()), ("text", pa.string())])
TEXTS_SQL = "sid long, cls long, text string"


def own_texts(width: int):
    """The rows whose text has the set hash that they are filed under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids = [np.zeros(0, np.int64)]
            for _, _, grams, cuts in sets_of([(t or "").encode() for t in batch.column(2).to_pylist()], width):
                sids.append(identities(grams, cuts)[0])
            yield pa.RecordBatch.from_arrays(batch.columns, schema=TEXTS).filter(pa.array(np.concatenate(sids) == batch.column(0).to_numpy()))

    return run


def keep_one(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs' own columns, the rows of each component's least id; rows with a null id or no words stay."""
    found = components(spark, docs, width, num, den)
    gone = found.where("n_shingles > 0 and doc_id is not null and doc_id != component_id").select("doc_id").distinct()
    gone = materialize(spark, gone, "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def keep_one_row(spark: SparkSession, docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs' own columns, one row of each component: of the least id, a null last; rows without words stay.

    Where ids repeat or are null, rows are joined by their numbers, by id and then by a
    hash of the row, which takes a copy of docs.
    """
    prepare(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").count()
    if not ids.where("count > 1 or doc_id is null").limit(1).count():
        return keep_one(spark, docs, width, num, den)
    of_row = [F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns)]
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("_key"), *[h.alias(f"_h{i}") for i, h in enumerate(of_row)])
    known, n = numbered(rows.where("_key is not null"), "_key", ["_h0", "_h1"])
    rest, _ = numbered(rows.where("_key is null"), "_h0", ["_h1"])
    dealt = known.select("_doc", F.col("row").cast("long").alias("_row")).unionByName(rest.select("_doc", (F.col("row") + n).cast("long").alias("_row")))
    dealt = materialize(spark, dealt, "numbered")
    found = components(spark, dealt.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), width, num, den)
    gone = found.where("n_shingles > 0 and doc_id != component_id").select(F.col("doc_id").alias("_row"))
    return dealt.join(materialize(spark, gone, "duplicates"), "_row", "left_anti").select("_doc.*")
