from __future__ import annotations

import random

import pytest

TABLE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Frame of `documents` from (doc_id, text) pairs."""

    def make(rows, extra=""):
        full = [(i, t, "en", None if i is not None and i % 7 == 0 else "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, TABLE).repartition(3) if full else spark.createDataFrame([], TABLE)

    return make


def noise(seed: int, n: int, letters: str, low: int, high: int, space: float = 0.0) -> list[str]:
    """Texts over few words, with passages copied between them."""
    rng = random.Random(seed)
    out: list[str] = []
    for _ in range(n):
        words = [rng.choice(letters) for _ in range(rng.randint(low, high))]
        for _ in range(rng.randint(0, 2)):
            if out:
                other = rng.choice(out).split()
                if other:
                    a = rng.randrange(len(other))
                    cut = other[a:a + rng.randint(10, 40)]
                    at = rng.randint(0, len(words))
                    words[at:at] = cut
        sep = [" ", "\n", "  ", "\t"]
        out.append("".join(w + rng.choice(sep) if rng.random() < 0.3 else w + " " for w in words))
    return out
