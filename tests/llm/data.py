"""Small critique tables with every awkward case, shared by the tests."""

from __future__ import annotations

import random

WORDS = "shot cut frame palette motion tension light key onset window hop clip sample track subject thirds".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))


def awkward(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """Null and empty texts, blanks, null ids, repeated rows, ties, a very long text."""
    base = prose(rng, 60)
    rows: list[tuple[int | None, str | None]] = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, base), (6, base), (6, base), (7, base + " end"), (None, base), (None, None)]
    rows += [(10 + i, prose(rng, rng.randrange(1, 80))) for i in range(20)]
    rows.append((40, prose(rng, 20_000)))
    return rows
