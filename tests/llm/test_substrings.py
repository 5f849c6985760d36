"""Repeated word windows against brute force."""

from __future__ import annotations

import re

import pytest
from llm.conftest import noise

from cohortwise.llm.substrings import remove_repeated_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """{(id, text): (words, kept)}; rows equal in id and text are one document."""
    docs = sorted({(i, t or "") for i, t in rows}, key=lambda r: (r[0] is None, r[0] or 0))
    assert len({i for i, _ in docs}) == len(docs)
    first, words = {}, {d: WORD.findall(d[1]) for d in docs}
    for n, d in enumerate(docs):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s:s + window]), (n, s))
    out = {}
    for n, d in enumerate(docs):
        gone = set()
        for s in range(len(words[d]) - window + 1):
            if first[tuple(words[d][s:s + window])] != (n, s):
                gone.update(range(s, s + window))
        out[d] = (len(words[d]), len(gone), " ".join(w for i, w in enumerate(words[d]) if i not in gone))
    return out


def run(frame):
    return [((r.doc_id, r.text or ""), (r.n_words, r.n_removed, r.kept_text)) for r in remove_repeated_windows(frame).collect()]


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcd", 2), ("abcdefghijklmnop", 3), ("a", 4), ("abcdefghijklmnopqrstuvwxyzäö", 5)])
def test_like_brute_force(documents, letters, seed):
    texts = noise(seed, 60, letters, 0, 60)
    rows = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    want = brute(rows)
    got = run(documents(rows))
    assert len(got) == len(rows) and all(want[k] == v for k, v in got)
    assert letters != "abcd" or any(v[1] for _, v in got)


def test_null_empty_long_repeated_rows_and_extra_columns(spark, documents):
    long = " ".join(f"w{i}" for i in range(300_000))
    part = " ".join(f"w{i}" for i in range(1000, 1030))
    rows = [(1, long), (2, part), (3, None), (4, ""), (5, " \t\n"), (2, part), (None, part), (6, part.replace(" ", "\n"))]
    want = brute(rows)
    frame = documents(rows).selectExpr("*", "'x' as n_words", "1 as part", "2 as at", "3 as row")
    got = run(frame)
    assert sorted(map(str, got)) == sorted(str(((i, t or ""), want[(i, t or "")])) for i, t in rows)
    assert remove_repeated_windows(frame).columns == [c for c in frame.columns if c != "n_words"] + ["n_words", "n_removed", "kept_text", "removed_at"]


def test_empty_table(documents):
    assert run(documents([])) == []
