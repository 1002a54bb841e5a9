"""The layout keeps neighbourhoods that a linear projection folds onto each other."""

import numpy as np
from pyspark.sql import functions as F

from lexmill.operators import layout, topics


def plain_memberships(near, k):
    out = {}
    for a, found in near.items():
        first, want = min(d for _, d in found), np.log2(max(2, len(found)))
        lo, hi = max(d for _, d in found) * 1e-6, max(d for _, d in found) * 1e3
        for _ in range(200):
            middle = (lo * hi) ** 0.5
            lo, hi = (lo, middle) if sum(np.exp(-max(0, d - first) / middle) for _, d in found) > want else (middle, hi)
        for b, d in found:
            w = np.exp(-max(0, d - first) / lo)
            pair = (min(a, b), max(a, b))
            out[pair] = 1 - (1 - out.get(pair, 0.0)) * (1 - w)
    return out


def test_memberships(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = {a: [(int(b), float(d[a, b])) for b in np.argsort(d[a])[1:9]] for a in range(60)}
    df = spark.createDataFrame([(a, b, w) for a, found in near.items() for b, w in found], "a long, b long, d double")
    got = {(r["a"], r["b"]): r["w"] for r in layout.memberships(df).collect()}
    want = plain_memberships(near, 8)
    assert set(got) == set(want) and max(abs(got[p] - want[p]) for p in want) < 1e-6


def test_a_roll_is_unrolled(spark):
    rng = np.random.default_rng(2)
    t, h = rng.uniform(1.5 * np.pi, 4.5 * np.pi, 400), rng.uniform(0, 10, 400)
    x = np.stack([t * np.cos(t), h, t * np.sin(t)], axis=1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    near = lambda y: np.argsort(((y[:, None] - y[None]) ** 2).sum(axis=2), axis=1)[:, 1:16]
    true = near(x)

    def kept(rows):
        y = np.array([tuple(r)[1:] for r in sorted(rows)])
        return np.mean([len(set(a) & set(b)) / 15 for a, b in zip(true, near(y), strict=True)])

    assert kept(layout.layout(spark, df, epochs=15).collect()) > kept(topics.projection(df).collect()) + 0.1


def test_layout_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.0, 1.0]), (2, None), (3, [float("nan"), 0.0]), (4, [5.0, 5.0]), (5, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = layout.layout(spark, df, size=3, epochs=2).collect()
    assert len(got) == 7 and all((r["x0"] is None) == (r["vec_id"] in (2, 3, 5)) for r in got)
    assert len({tuple(r) for r in got if r["vec_id"] == 1}) == 1
    assert layout.layout(spark, df.where(F.lit(False)), epochs=2).count() == 0
