"""Vectorised hashing of words, word n-grams and lines of many texts at once.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix sums, so
no Python code runs for each word. White space is the six ASCII characters; all
other bytes, among them those of multi-byte characters, belong to words. As any hash
of 64 bits it can give two words one value; for a polynomial modulo 2**64 such pairs
of words can be constructed, of a thousand bytes and more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
GRAM = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)
#: Bytes of text that are hashed in one go.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(lower: bool, seed: int = 1) -> np.ndarray:
    """A fixed value for each byte."""
    out = mix(mix(np.arange(256, dtype=np.uint64) + np.uint64(1)) + np.uint64(seed))
    if lower:
        out[65:91] = out[97:123]
    return out


LOWERED, EXACT = byte_values(True), byte_values(False)


class Powers:
    """Powers of BASE and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, SLICE + 1)
            for name, base in (("up", BASE), ("down", UNBASE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


POWERS = Powers()


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE bytes; a longer text is a range of its own."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > SLICE:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


class Words:
    """The words of some texts: hash, first and last byte, and number of the text."""

    def __init__(self, texts: list[bytes], values: np.ndarray = LOWERED, split_lines: bool = False) -> None:
        # a separator between the texts keeps their words apart
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts)))
        word = np.zeros(len(data) + 2, dtype=bool)
        word[1:-1] = ~SPACE[data]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        up, down = POWERS.upto(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=sums[1:])
        self.sums, self.down, self.data = sums, down, data
        self.text = np.searchsorted(ends, self.start, side="right")
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.group = self.text
        if split_lines:  # the separators are lines' ends too
            self.group = np.searchsorted(np.flatnonzero(data == 0x0A), self.start)

    def head(self, length: int, tag: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first bytes of the words that have as many, and their texts."""
        long = self.end - self.start >= length
        s = self.start[long]
        return mix((self.sums[s + length] - self.sums[s]) * self.down[s] + np.uint64(tag)), self.text[long]

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words of a group (the whole of it where it has fewer), and their texts."""
        h, g = self.hash, self.group
        if not len(h):
            return h, self.text
        m = len(h) - n + 1
        parts, owners = [], []
        if m > 0:
            same = g[n - 1 :] == g[:m]
            total = np.zeros(m, dtype=np.uint64)
            for k in range(n):
                total += h[k : k + m] * GRAM[k]
            parts.append(mix(total[same]))
            owners.append(self.text[:m][same])
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        count = np.diff(np.r_[first, len(g)])
        for i, c in zip(first[count < n], count[count < n], strict=True):
            with np.errstate(over="ignore"):
                total = np.uint64(c)
                for k in range(c):
                    total = total + h[i + k] * GRAM[k]
            parts.append(mix(np.array([total], dtype=np.uint64)))
            owners.append(self.text[i : i + 1])
        grams, texts = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(texts, kind="stable")
        return grams[order], texts[order]
