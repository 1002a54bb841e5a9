"""Long lists of children are mapped as short ones are."""

import random

from lexmill.llm.wrapper import Tree, aligned, match


def tree(keys: list[str]) -> Tree:
    return Tree("ul", [Tree(k, [], [i], hash((k, ()))) for i, k in enumerate(keys)], [], hash(tuple(keys)))


def common(x: list[str], y: list[str]) -> int:
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(max(row[j + 1], new[j], row[j] + (a == b)))
        row = new
    return row[-1]


def test_the_largest_mapping_at_any_length():
    rng = random.Random(1)
    for n, m in ((1, 1), (2, 5), (30, 41), (1100, 1000)):
        x, y = ([rng.choice(["p", "li", "h2", "dt"]) for _ in range(k)] for k in (n, m))
        a, b, plan = tree(x), tree(y), {}
        assert match(a, b, plan) == 1 + common(x, y)
        found = sorted((p[0], q[0]) for p, q in aligned(a, b, plan) if p and q)
        assert len(found) == common(x, y) and all(x[i] == y[j] for i, j in found)
        assert all(i < k and j < n for (i, j), (k, n) in zip(found, found[1:]))


def test_one_more_child_does_not_change_the_way():
    """1,001 children each were mapped to the next of their key: a first one without its like used up all the rest."""
    x, y = ["dt", *["p", "h2"] * 500], [*["p", "h2"] * 500, "dt"]
    assert match(tree(x), tree(y)) == 1 + 1000
