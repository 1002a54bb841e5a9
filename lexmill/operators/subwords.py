"""Counting subwords of a given vocabulary: the longest piece first, over a trie."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

#: Pieces a vocabulary may have: it is collected once and sent to the tasks.
MOST_PIECES = 500_000
#: A word of more characters is one unknown piece.
MOST_CHARACTERS = 100
#: Runs of word characters, and every other character that is no white space alone.
WORD = re.compile(r"[^\W_]+|[^\w\s]|_")
END = ""


def vocabulary(pieces: DataFrame, column: str = "piece") -> list[str]:
    """The pieces of a table, one a row; at most MOST_PIECES."""
    rows = pieces.select(column).where(f"{column} is not null").distinct().limit(MOST_PIECES + 1).collect()
    if len(rows) > MOST_PIECES:
        raise ValueError(f"a vocabulary has {MOST_PIECES} pieces at most")
    return [r[0] for r in rows]


def trie(pieces: Iterable[str]) -> dict:
    root: dict = {}
    for p in pieces:
        at = root
        for c in p:
            at = at.setdefault(c, {})
        at[END] = True
    return root


def longest(root: dict, word: str, start: int) -> int:
    """Where the longest piece from start on ends; start if there is none."""
    at, end = root, start
    for i in range(start, len(word)):
        at = at.get(word[i])
        if at is None:
            break
        if END in at:
            end = i + 1
    return end


def word_pieces(first: dict, inner: dict, word: str) -> int:
    """Pieces of a word; a word that can't be covered is one unknown piece."""
    if len(word) > MOST_CHARACTERS:
        return 1
    n = start = 0
    while start < len(word):
        end = longest(inner if start else first, word, start)
        if end == start:
            return 1
        n, start = n + 1, end
    return n


def counter(pieces: Iterable[str], inside: str = "##", lower: bool = True) -> Callable[[str], int]:
    """A function that counts a text's subwords: pieces that begin with `inside` go on inside a word.

    A piece is taken as long as possible from the left. Counts of words are remembered
    by each worker, for a bounded number of words.
    """
    pieces = list(pieces)
    first = trie(p for p in pieces if not p.startswith(inside))
    inner = trie(p[len(inside) :] for p in pieces if p.startswith(inside))
    known: dict[str, int] = {}

    def count(text: str) -> int:
        total = 0
        for word in WORD.findall(text.lower() if lower else text):
            n = known.get(word)
            if n is None:
                if len(known) > 1 << 18:
                    known.clear()
                n = known[word] = word_pieces(first, inner, word)
            total += n
        return total

    return count
