"""Neighbours and density clusters against plain versions."""

import collections
import itertools

import numpy as np
import pytest

from lexmill.operators import density, neighbours


def table(spark, x, extra=()):
    rows = [(i, [float(a) for a in v], "c") for i, v in enumerate(x)] + [(*r, "c") for r in extra]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, point string").repartition(3)


def plain_clusters(x, min_size, min_samples):
    """The hierarchy over all pairs, from the widest reach down, in recursive form."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples]
    w = np.maximum(d, np.maximum(core[:, None], core[None]))

    def parts(members, reach):
        """Components of members by pairs nearer than reach."""
        left, out = set(members), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                a = todo.pop()
                seen.add(a)
                near = [b for b in left if w[a, b] < reach]
                left -= set(near)
                todo += near
            out.append(sorted(seen))
        return out

    def widest(members):
        """The greatest edge of the members' spanning tree."""
        inside, best = {members[0]}, {b: w[members[0], b] for b in members[1:]}
        top = 0.0
        while best:
            b = min(best, key=best.get)
            top = max(top, best.pop(b))
            inside.add(b)
            for c in best:
                best[c] = min(best[c], w[b, c])
        return top

    def follow(members, birth):
        """(own, best, clusters) of the cluster that has these members from 1/birth on."""
        own, mine = 0.0, members
        start = birth
        while True:
            reach = widest(mine) if len(mine) > 1 else 0.0
            if reach == 0:
                return own, own, [members]
            own += len(mine) * (1 / reach - start)
            start = 1 / reach
            big = [p for p in parts(mine, reach) if len(p) >= min_size]
            if len(big) == 1:
                mine = big[0]
                continue
            if not big:
                return own, own, [members]
            below = [follow(p, 1 / reach) for p in big]
            rest = sum(b for _, b, _ in below)
            return (own, own, [members]) if own >= rest else (own, rest, [c for *_, cs in below for c in cs])

    # all rows together are no cluster: go down to the first split
    mine = list(range(n))
    while True:
        reach = widest(mine)
        big = [p for p in parts(mine, reach) if len(p) >= min_size]
        if len(big) == 1:
            mine = big[0]
            continue
        return {frozenset(c) for p in big for c in follow(p, 1 / reach)[2]}


def sets_of(rows):
    out = collections.defaultdict(set)
    for r in rows:
        if r["topic_id"] >= 0:
            out[r["topic_id"]].add(r["vec_id"])
    return {frozenset(s) for s in out.values()}


def blobs(rng):
    near = rng.normal(0, 0.1, (90, 3))
    wide = rng.normal(3, 0.6, (100, 3))
    other = rng.normal([-4, 4, 0], 0.3, (60, 3))
    return np.concatenate([near, wide, other, rng.uniform(-10, 10, (50, 3))])


def test_equal_to_the_plain_hierarchy(spark):
    x = blobs(np.random.default_rng(3))
    got = density.density_clusters(spark, table(spark, x), min_size=8, k=len(x), levels=None).collect()
    assert len(got) == 300 and sets_of(got) == plain_clusters(x, 8, 2)


def test_uneven_density_that_k_means_splits(spark):
    from lexmill.operators import topics

    rng = np.random.default_rng(4)
    x = blobs(rng)
    df = table(spark, x, [(400, None), (401, [float("nan")] * 3), (402, x[0].tolist()), (None, x[1].tolist()), (403, [])])
    rows = density.density_clusters(spark, df, min_size=10).collect()
    got = {r["vec_id"]: r["topic_id"] for r in rows}
    assert len(rows) == 305 and got[400] == got[401] == got[403] == -1 and got[402] == got[0]
    planted = [range(90), range(90, 190), range(190, 250)]
    main = [collections.Counter(got[i] for i in p).most_common(1)[0] for p in planted]
    assert len({m for m, _ in main}) == 3 and -1 not in {m for m, _ in main}
    assert all(n >= 0.9 * len(p) for (_, n), p in zip(main, planted, strict=True))
    assert sum(got[i] == -1 for i in range(250, 300)) >= 25
    means = {r["vec_id"]: r["topic_id"] for r in topics.clusters(df.where("vec_id < 300"), k=3, noise=1.0).collect()}
    pure = [collections.Counter(means[i] for i in p).most_common(1)[0][1] / len(p) for p in planted]
    assert min(pure) < 0.9 or sum(means[i] == means[0] for i in range(250, 300)) > 5  # no noise, or a split


def test_copies_count_as_rows(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.repeat(rng.normal(0, 1, (3, 2)), 30, axis=0), rng.uniform(5, 60, (20, 2))])
    got = density.density_clusters(spark, table(spark, x), min_size=20).collect()
    labels = {r["vec_id"]: r["topic_id"] for r in got}
    assert all(len({labels[i] for i in range(30 * k, 30 * k + 30)} - {-1}) == 1 for k in range(3))


def test_few_or_no_vectors(spark):
    none = table(spark, np.zeros((1, 2))).limit(0)
    assert density.density_clusters(spark, none).count() == 0
    assert [r["topic_id"] for r in density.density_clusters(spark, table(spark, np.ones((7, 2)))).collect()] == [-1] * 7
    assert [r["topic_id"] for r in density.density_clusters(spark, table(spark, np.eye(3))).collect()] == [-1] * 3


def test_spanning_forests_in_small_blocks_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(6)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 400), rng.integers(60, 120, 400), rng.integers(1, 40, 400), strict=True)]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    monkeypatch.setattr(density, "FOREST_EDGES", 25)
    kept = density.thinned(df, 400).collect()
    assert len(kept) < 400

    def parts(rows, most):
        trees = density.Trees()
        for a, b, w in rows:
            if w <= most:
                trees.join(a, b)
        return [trees.find(i) for i in range(120)]

    for most in range(0, 41, 4):
        assert parts(edges, most) == parts([tuple(r) for r in kept], most)


@pytest.mark.parametrize("spread", [0.3, 3.0])
def test_neighbours_recall(spark, spread):
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 1, (20, 16))
    x = centers[rng.integers(0, 20, 3000)] * spread + rng.normal(0, 0.5, (3000, 16))
    pts = neighbours.points(spark, table(spark, x))
    where = {tuple(r["v"]): r["point"] for r in pts.collect()}
    ids = np.array([where[tuple(v)] for v in x.tolist()])
    got = collections.defaultdict(dict)
    for r in neighbours.neighbours(spark, pts, k=10, trees=6, block=600).collect():
        got[r["a"]][r["b"]] = r["d"]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) if len(x) <= 3000 else None
    near = np.argsort(d, axis=1)[:, 1:11]
    hits = sum(len({int(ids[j]) for j in near[i]} & set(got[int(ids[i])])) for i in range(len(x)))
    assert hits / (10 * len(x)) >= 0.9
    place = {int(p): i for i, p in enumerate(ids)}
    for a, b in itertools.islice(((a, b) for a in got for b in got[a]), 500):
        assert abs(got[a][b] - d[place[a], place[b]]) < 1e-9
