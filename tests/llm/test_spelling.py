"""Spelling variants against brute force."""

from __future__ import annotations

import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import regex

from cohortwise.llm import spelling


def near(a: str, b: str) -> bool:
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute(counts: dict[str, int], factor: int = 2) -> dict[str, tuple]:
    out, form = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * n else None
        out[w] = (n, len(others), form[w], counts[form[w]] if form[w] else None)
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def table(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def result(frame):
    rows = [(r.word, (r.n, r.n_near, r.form, r.form_n, r.root)) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def words(seed: int, n: int, letters: str, low: int, high: int) -> dict[str, int]:
    rng = random.Random(seed)
    known = set()
    while len(known) < n:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))
        known.add(w)
        if rng.random() < 0.5:
            i = rng.randrange(len(w))
            known.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]) or "a")
    return {w: rng.choice([3, 3, 4, 6, 12, 40, 100]) for w in sorted(known)}


@pytest.mark.parametrize("letters, low, high", [("ab", 1, 9), ("abcé", 3, 7), ("aé漢😀", 2, 30)])
def test_like_brute_force(spark, letters, low, high):
    counts = words(5, 300, letters, low, high)
    assert result(spelling.variants(table(spark, counts))) == brute(counts)


def test_large_and_wide_cells_are_halved(spark, monkeypatch):
    """Words with one long beginning and end, and zones beyond the limits."""
    monkeypatch.setattr(spelling, "BLOCK", 8)
    monkeypatch.setattr(spelling, "WIDE", 4)
    counts = words(6, 150, "ab", 4, 8) | {"x" * 40 + w + "y" * 40: n for w, n in words(7, 100, "abc", 2, 6).items()}
    assert result(spelling.variants(table(spark, counts))) == brute(counts)


def test_block_recurrences():
    zones = ["abc", "abd", "ab", "abcd", "xabc", "abc", "b", "acb", "aabc"]
    cell = np.array([1, 1, 1, 1, 1, 2, 1, 1, 1])
    i, j = spelling.near_in_block(zones, cell)
    want = {(a, b) for a in range(9) for b in range(9) if a != b and cell[a] == cell[b] and near(zones[a], zones[b])}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_chain_of_forms(spark):
    """Forms are followed to the last, however long the chain."""
    chain = {"a" * k: 2**k for k in range(5, 30)}
    got = result(spelling.variants(table(spark, chain)))
    assert {r[4] for r in got.values()} == {"a" * 29} and got["a" * 29][2] is None


def test_very_long_word(spark):
    long = "ab" * 30_000
    counts = {long: 3, long[:-1]: 9, long[:20_000] + "c" + long[20_001:]: 30, "short": 3}
    got = result(spelling.variants(table(spark, counts)))
    assert got[long][1:3] == (2, long[:20_000] + "c" + long[20_001:]) and got["short"] == (3, 0, None, None, "short")


def test_runs_and_counts(spark, documents):
    frame = documents([(1, "Étoile ÉTOILE, étoile-x9x ÷×aB"), (2, None), (3, ""), (3, "")]).selectExpr("*", "1 as word", "2 as run", "3 as n")
    assert sorted(r.run for r in spelling.runs(frame).collect()) == sorted(["Étoile", "ÉtoilE".lower().replace("é", "É"), "étoile", "x", "x", "÷×ab"])
    frame = documents([(i, "wordy words wordy four") for i in range(2)])
    assert {tuple(r) for r in spelling.vocabulary(spelling.runs(frame), "run").collect()} == {("wordy", 4)}
    assert spelling.variants(spelling.vocabulary(spelling.runs(documents([])), "run")).count() == 0


def test_query_like_brute_force(spark):
    from cohortwise.llm.queries import op11_spelling_variants

    folder = "/root/testdata/sf0.001"
    counts: Counter = Counter()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        for run in regex.findall("[A-Za-zÀ-ÿ]+", r.text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = crc32(f"{r.doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    assert result(op11_spelling_variants(spark, folder)) == brute(counts)
