"""The factorization machine learns pairs that no sum of weights can, and scores as a plain double loop does."""

import numpy as np
import pytest

from lexmill.llm import toxicity


def texts_of(kinds, n=4000, seed=1):
    """(texts, labels, row kinds): random words with the words of one kind, whose label is given; None adds nothing and is clean."""
    rng = np.random.default_rng(seed)
    texts, labels, which = [], [], []
    for _ in range(n):
        words = [f"w{k}" for k in rng.integers(0, 120, 12)]
        kind = int(rng.integers(len(kinds)))
        extra, label = kinds[kind]
        words += extra
        rng.shuffle(words)
        texts.append(" ".join(words).encode())
        labels.append(label)
        which.append(kind)
    return texts, np.array(labels, float), np.array(which)


def fitted(texts, labels):
    owners, found = [], []
    for at, _, owner, term in toxicity.terms(texts):
        owners.append(owner + at)
        found.append(term)
    return toxicity.fit(labels, np.concatenate(owners), np.concatenate(found))


class NoFactors:
    """Factors that start at zero stay there, so what is fitted is linear."""

    def __init__(self, seed):
        self.rng = np.random.Generator(np.random.PCG64(seed))

    def normal(self, mean, spread, shape):
        return np.zeros(shape)

    def permutation(self, n):
        return self.rng.permutation(n)


CROSSED = [(["insult", "groupa"], 1), (["praise", "groupb"], 1), (["insult", "groupb"], 0), (["praise", "groupa"], 0)]
EXCLUSIVE = [(["kettle", "window"], 0), (["kettle"], 1), (["window"], 1), ([], 0)]


@pytest.mark.parametrize("kinds", [CROSSED, EXCLUSIVE])
def test_pairs_that_no_linear_model_tells(monkeypatch, kinds):
    texts, labels, _ = texts_of(kinds)
    right = lambda model: np.mean((model.score(texts[3000:]) >= 0.5) == labels[3000:])
    with_pairs = right(fitted(texts[:3000], labels[:3000]))
    monkeypatch.setattr(toxicity.np.random, "default_rng", NoFactors)
    linear = fitted(texts[:3000], labels[:3000])
    assert not linear.factor.any()
    assert with_pairs > 0.97 and right(linear) < 0.8


def test_scores_equal_a_double_loop():
    texts, labels, _ = texts_of(CROSSED, 800)
    model = fitted(texts, labels)
    place = {int(t): k for k, t in enumerate(model.features)}
    more = [b"", b"unseen words only", b"insult groupa insult", "INSULT gröup \xff".encode(), " ".join(f"w{i}" for i in range(3000)).encode()]
    for text in [*texts[:40], *more]:
        held = sorted({place[int(t)] for _, _, _, terms in toxicity.terms([text]) for t in terms if int(t) in place})
        margin = model.bias + sum(model.weight[k] for k in held)
        for a in range(len(held)):
            for b in range(a + 1, len(held)):
                margin += sum(x * y for x, y in zip(model.factor[held[a]], model.factor[held[b]], strict=True))
        want = 1 / (1 + np.exp(-min(30, max(-30, margin))))
        assert abs(model.score([text])[0] - want) < 1e-9
