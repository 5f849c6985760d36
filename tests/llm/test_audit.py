"""Filters in every order, against brute force."""

from __future__ import annotations

import random
from itertools import permutations

import pytest
import regex

from cohortwise.llm import audit

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def masks(rows) -> list[int]:
    out = []
    first: dict[str, int] = {}
    for i, text, _ in rows:
        first[text or ""] = min(first.get(text or "", audit.LAST), audit.LAST if i is None else i)
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        out.append(
            (len(words) < 100) | (100 * len(set(words)) < 80 * len(words)) << 1
            | (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) << 2 | any(c in "#$%&*|" for c in text) << 3
            | ((audit.LAST if i is None else i) > first[text]) << 4)
    return out


def brute(rows, labels) -> dict:
    out = {}
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    parts: dict[str, list] = {}
    for (i, _, part), mask in zip(rows, masks(rows)):
        parts.setdefault(part or "", []).append((i, mask))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [d for d in left if d[1] & bit]
                left = [d for d in left if not d[1] & bit]
                shapley[letter] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(1 for d in docs if d[1] & bit) - len(gone), sum(d[1] == bit for d in docs),
                    sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone), letter]
        for key in [k for k in out if k[0] == part]:
            out[key][-1] = shapley[out[key][-1]]
    return {k: tuple(v) for k, v in out.items()}


def result(frame):
    rows = [((r.part, r.filter_order, r.step), (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def documents_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def some_texts(seed: int, n: int):
    rng = random.Random(seed)
    kinds = ["word", "Word", "A", "B", "é", "x#y", "100%", " ", "tab\tend", "other", "thing"]
    texts: list[str | None] = [None, "", " \n\t", "CAPS", "漢字 " * 99 + "字", "w " * 99 + "w"]
    for _ in range(n):
        words = [rng.choice(kinds) + (str(i) if rng.random() < 0.7 else "") for i in range(rng.choice([5, 99, 100, 130]))]
        texts.append(rng.choice([" ", "\n", "  "]).join(words))
    return [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(4 * n)]


def test_like_brute_force(spark):
    rng = random.Random(2)
    rows = [*some_texts(1, 40), (None, "CAPS", "en"), (None, "only here", "en"), (None, "only here", "en"), (3, "CAPS", "de"), (3, "CAPS", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = documents_of(spark, rows).selectExpr("*", "1 as mask", "2 as part", "3 as n", "4 as id")
    marked = audit.failures(frame)
    assert sorted((r.id is None, r.id or 0, r.part, r["mask"]) for r in marked.collect()) == sorted(
        (i is None, i or 0, p or "", m) for (i, _, p), m in zip(rows, masks(rows)))
    got = result(audit.audit(audit.cells(marked, labels_of(spark, labels))))
    assert got == brute(rows, labels) and len(got) == 600 * 4


def test_a_text_that_most_documents_share(spark):
    rows = [(i, "the same text", "en") for i in range(500)] + [(1000 + i, f"text {i}", "en") for i in range(5)]
    assert sum(r["mask"] >= 16 for r in audit.failures(documents_of(spark, rows)).collect()) == 499


def test_very_long_text(spark):
    rows = [(1, "word " * 300_000, "en"), (2, "x" * 1_000_000, "en")]
    assert {r.id: r["mask"] for r in audit.failures(documents_of(spark, rows)).collect()} == {1: 2, 2: 1}


def test_empty_tables(spark):
    none, no_labels = documents_of(spark, []), labels_of(spark, [])
    assert audit.audit(audit.cells(audit.failures(none), no_labels)).count() == 0
    rows = some_texts(3, 5)
    assert result(audit.audit(audit.cells(audit.failures(documents_of(spark, rows)), no_labels))) == brute(rows, [])


@pytest.mark.parametrize("letters", ["A", "AB", "ABCD"])
def test_prefixes_of_any_number_of_filters(spark, letters):
    rows = audit.prefixes(spark, letters).collect()
    orders = {"".join(p[:k]) for p in permutations(letters) for k in range(1, len(letters) + 1)}
    assert len(rows) == len(orders) << len(letters) and {r.prefix for r in rows} == orders
