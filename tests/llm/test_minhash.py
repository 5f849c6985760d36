"""Near-duplicate documents against brute force."""

from __future__ import annotations

import random
import re

import pytest

from cohortwise.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)])


def brute(rows, words=2, percent=80):
    sets = [shingles(t, words) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: (len(sets[i]), least[root(i)], least[root(i)] == d) for i, (d, _) in enumerate(rows)}


def family(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    texts = [[rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 30, 120]))] for _ in range(n // 3)]
    while len(texts) < n:
        t = list(rng.choice(texts))
        for _ in range(rng.randint(0, max(1, len(t) // 12))):
            if t:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
        texts.append([w.upper() if rng.random() < 0.1 and w.isascii() else w for w in t])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("words", [2, 5])
def test_like_brute_force(documents, words):
    texts = family(words, 240)
    rows = [(i * 7 - 300, t) for i, t in enumerate(random.Random(1).sample(texts, len(texts)))]
    found = minhash.near_duplicates(documents(rows), words=words).collect()
    want = brute(rows, words)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == want
    assert len({c for _, c, _ in want.values()}) < len(rows) - 20


def test_one_large_group_in_small_blocks(documents, monkeypatch):
    monkeypatch.setattr(minhash, "SALT", 8)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # a chain of copies: the ends are no longer near each other
        if i % 10 == 0:
            base[rng.randrange(60)] = f"n{i}"
        rows.append((i, " ".join(base) + (f" x{i}" if i % 3 else "")))
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents(rows), words=2).collect()}
    assert found == brute(rows)


def test_rows_of_all_kinds(documents):
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(1, long), (2, None), (3, ""), (4, " \n\t"), (5, "One"), (6, "one "), (7, "a b c"), (7, "a b c"), (7, "other text here"), (None, "a B c"), (None, "alone in this"), (8, long + " end")]
    frame = documents(rows).selectExpr("*", "1 as node", "2 as bucket", "'k' as kept")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in minhash.near_duplicates(frame, words=2).collect())
    assert found == sorted([
        ("1", 199_999, "1", True), ("2", 0, "2", True), ("3", 0, "3", True), ("4", 0, "4", True), ("5", 1, "5", True), ("6", 1, "5", False),
        ("7", 2, "7", True), ("7", 2, "7", True), ("7", 2, "7", True), ("None", 2, "7", False), ("None", 2, "None", True), ("8", 200_000, "1", False)])


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
