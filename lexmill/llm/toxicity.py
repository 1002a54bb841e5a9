"""Toxicity scores by a factorization machine over hashed terms.

Terms are a text's distinct lower-cased words and the words' first bytes (HEADS
lengths, so inflected forms share terms), hashed to 2**HASH_BITS values. A
factorization machine of degree two scores them: each term has a weight and a short
vector, and the inner products of the vectors of terms that occur together catch
pairs, such as an insult beside a mention of a group, that no sum of weights can.

The model is fitted to a sample of SAMPLE_ROWS labelled rows at most, those of the
least hash, and to its FEATURES terms of the largest chi-squared statistic; the
fit runs in one task over the sample's terms, whose size those bounds limit.
Scoring streams over all rows with the small model broadcast.

A hash of the id decides which labels are held out; nothing but the text enters a
score. Nulls: a null text is the empty text; rows with a null id or label are not
learned from, and are scored like others. Equal texts get equal scores. Without
labels of both kinds every text gets the share of toxic labels (0 without any).
Empty input gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.common import hashed_sample, prepare
from lexmill.llm.textfeat import LOWERED, Words, slices

HASH_BITS, HEADS = 20, (4, 5, 6)
SAMPLE_ROWS = 16384
FEATURES, FACTORS, EPOCHS, BATCH, RATE, DECAY = 1024, 8, 30, 256, 0.05, 1e-4
#: A term must occur in as many sampled texts to be a feature.
LEAST_ROWS = 4


def held_out(key: Column) -> Column:
    """Labels of rows whose CRC-32 of the id as text leaves 2 modulo 4 are for testing only."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def terms(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of texts: first, end, and the distinct (text, term) pairs, sorted."""
    for at, to in slices(texts):
        w = Words(texts[at:to], LOWERED)
        hashes, owners = [w.hash], [w.text]
        for i, length in enumerate(HEADS):
            h, o = w.head(length, i + 1)
            hashes.append(h)
            owners.append(o)
        term = (np.concatenate(hashes) >> np.uint64(64 - HASH_BITS)).astype(np.int64)
        pairs = np.unique((np.concatenate(owners).astype(np.int64) << HASH_BITS) | term)
        yield at, to, pairs >> HASH_BITS, pairs & ((1 << HASH_BITS) - 1)


class Model:
    """score = sigmoid(bias + sum of weights + sum over pairs of inner products)."""

    def __init__(self, prior: float, features: np.ndarray, bias: float = 0.0, weight=None, factor=None) -> None:
        self.prior, self.features, self.bias, self.weight, self.factor = prior, features, bias, weight, factor

    def scores(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """Scores of n texts from the features that each holds."""
        if self.weight is None:
            return np.full(n, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.margin(n, owner, feature), -30, 30)))

    def margin(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        out = self.bias + np.bincount(owner, self.weight[feature], n)
        for f in range(self.factor.shape[1]):
            v = self.factor[feature, f]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        where = np.full(1 << HASH_BITS, -1, np.int64)
        where[self.features] = np.arange(len(self.features))
        for at, to, owner, term in terms(texts):
            feature = where[term]
            known = feature >= 0
            out[at:to] = self.scores(to - at, owner[known], feature[known])
        return out


def select(labels: np.ndarray, owner: np.ndarray, term: np.ndarray) -> np.ndarray:
    """The terms whose presence depends most on the label."""
    n, p = len(labels), labels.sum()
    with_term = np.bincount(term, minlength=1 << HASH_BITS).astype(float)
    toxic = np.bincount(term, labels[owner].astype(float), 1 << HASH_BITS)
    expected = with_term * p / n
    spread = with_term * (p / n) * (1 - p / n) * (1 - with_term / n)
    chi = np.divide((toxic - expected) ** 2, spread, out=np.zeros_like(spread), where=(spread > 0) & (with_term >= LEAST_ROWS))
    best = np.argsort(-chi, kind="stable")[:FEATURES]
    return best[chi[best] > 0]


def fit(labels: np.ndarray, owner: np.ndarray, term: np.ndarray, seed: int = 0) -> Model:
    """Adam on the logistic loss over mini-batches; owner ascending."""
    n = len(labels)
    prior = float(labels.mean()) if n else 0.0
    if prior in (0.0, 1.0):
        return Model(prior, np.zeros(0, np.int64))
    features = select(labels, owner, term)
    if not len(features):
        return Model(prior, np.zeros(0, np.int64))
    where = np.full(1 << HASH_BITS, -1, np.int64)
    where[features] = np.arange(len(features))
    known = where[term] >= 0
    owner, feature = owner[known], where[term[known]]
    rng = np.random.default_rng(seed)
    m = len(features)
    # one matrix: bias in the last row, weight in the first column, then the factors
    theta = np.zeros((m + 1, 1 + FACTORS))
    theta[:m, 1:] = rng.normal(0, 0.01, (m, FACTORS))
    theta[m, 0] = np.log(prior / (1 - prior))
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    starts = np.searchsorted(owner, np.arange(n + 1))
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        rate = RATE * (1 - epoch / EPOCHS)
        for k in range(0, n, BATCH):
            rows = order[k : k + BATCH]
            count = starts[rows + 1] - starts[rows]
            at = np.repeat(np.arange(len(rows)), count)
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            x = feature[np.repeat(starts[rows], count) + within]
            v = theta[x, 1:]
            total = np.stack([np.bincount(at, v[:, f], len(rows)) for f in range(FACTORS)], 1)
            squares = np.bincount(at, (v * v).sum(1), len(rows))
            margin = theta[m, 0] + np.bincount(at, theta[x, 0], len(rows)) + 0.5 * ((total * total).sum(1) - squares)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            grad = DECAY * theta
            grad[m] = 0
            grad[m, 0] = error.sum()
            e = error[at]
            grad[:m, 0] += np.bincount(x, e, m)
            pull = e[:, None] * (total[at] - v)
            for f in range(FACTORS):
                grad[:m, 1 + f] += np.bincount(x, pull[:, f], m)
            step += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad * grad - second)
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Model(prior, features, float(theta[m, 0]), theta[:m, 0].copy(), theta[:m, 1:].copy())


def sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        rows = []
        for at, to, owner, term in terms(texts):
            cuts = np.searchsorted(owner, np.arange(to - at + 1))
            rows += [term[cuts[i] : cuts[i + 1]].astype(np.int32).tobytes() for i in range(to - at)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(rows, pa.binary())], names=["toxic", "terms"])


def fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    labels, lists = [], []
    for batch in batches:
        labels += batch.column(0).to_pylist()
        lists += [np.frombuffer(b, np.int32) for b in batch.column(1).to_pylist()]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists]) if lists else np.zeros(0, np.int64)
    term = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
    model = fit(np.array(labels, dtype=float), owner, term)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model.__dict__)], pa.binary())], names=["model"])


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from the labelled rows of docs that are not held out."""
    prepare(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = hashed_sample(chosen, "doc_id", sample_rows)
    # sample_rows bounds what is broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.select("toxic", "text").mapInArrow(sample_terms, "toxic int, terms binary")
    # one task fits: the sample is bounded, and sorted so that the fit does not depend on how rows were dealt
    found = found.repartition(1).sortWithinPartitions("terms", "toxic")
    fitted = found.mapInArrow(fit_sample, "model binary").collect()
    model = Model(0.0, np.zeros(0, np.int64))
    model.__dict__.update(pickle.loads(fitted[0][0]) if fitted else {})
    return model


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.score([(t or "").encode() for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*batch.schema.names[:-1], "score"])

    return run


def score(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    prepare(spark)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(scorer(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(spark: SparkSession, docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """docs' own columns without the rows whose text the model rejects."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
