"""Language-model scores against exact counts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_in_five():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 1


def brute(rows):
    """{id: (held out, tokens, known, N, base, score of exact counts)}."""
    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), None] for d, t in rows}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    ones, twos, starts = Counter(), Counter(), 0
    for d, _ in rows:
        if not held[d]:
            ones.update(tokens[d])
            twos.update(zip([0, *tokens[d]], tokens[d]))
            starts += 1
    n, v = sum(ones.values()), len(ones)
    mu = max(lm.SMOOTHING * n, 1.0)
    out = {}
    for d, _ in rows:
        q = [(ones[t] + 0.5) / (n + 0.5 * (v + 1)) for t in tokens[d]]
        before = [starts, *(ones[t] for t in tokens[d][:-1])]
        p = [(twos[b, t] + mu * x) / (c + mu) for (b, t), x, c in zip(zip([0, *tokens[d]], tokens[d]), q, before)]
        out[d] = (held[d], len(q), sum(ones[t] > 0 for t in tokens[d]), n, sum(map(math.log10, q)), sum(map(math.log10, p)))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeÉé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(vocabulary, weights, k=rng.randint(0, 90))) for _ in range(n)]


def check(found, want):
    for r in found:
        held, n, known, total, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert r.score == pytest.approx(score, rel=0.05, abs=2.5)  # a false hit makes a rare pair seen
        assert r.score < 0 or not total
    assert abs(np.mean([r.score - want[r.doc_id][5] for r in found])) < 0.4


def test_like_exact_counts(documents):
    rows = [(i * 11 - 70, t) for i, t in enumerate(texts(1, 300))] + [(100_001, None), (100_002, ""), (100_003, " \n\t "), (None, "a b c")]
    frame = documents(rows).selectExpr("*", "1 as score", "2 as part", "3 as n", "4 as held_out")
    found = lm.score(frame, one_in_five()).collect()
    assert len(found) == len(rows)
    check(found, brute(rows))


def test_rounds_and_parts_give_the_same(documents, monkeypatch):
    rows = list(enumerate(texts(2, 120)))
    one = {r.doc_id: r for r in lm.score(documents(rows), one_in_five()).collect()}
    monkeypatch.setattr(lm, "PART_BYTES", 5000)
    monkeypatch.setattr(lm, "ROUND_BYTES", 4000)
    many = {r.doc_id: r for r in lm.score(documents(rows), one_in_five()).collect()}
    for d, r in one.items():
        assert many[d].base_score == pytest.approx(r.base_score, rel=1e-12)
        assert many[d].score == pytest.approx(r.score, rel=0.02, abs=2.5)
        assert many[d].n_known == r.n_known


def test_repeated_rows_count_and_each_has_a_row(documents):
    rows = [(1, "a b a"), (1, "a b a"), (2, "b"), (2, "other text"), (3, "x " * 300_000)]
    found = lm.score(documents(rows), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(1, 4), (1, 4), (2, 2), (2, 3), (3, 300_001)]
    assert {r.train_tokens for r in found} == {300_014}


def test_all_held_out_and_empty(documents):
    found = lm.score(documents([(1, "a b"), (2, "c")]), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in found) and len(found) == 2
    assert lm.score(documents([]), F.lit(False)).count() == 0


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 20_000).astype(np.uint64)
    counts = rng.geometric(0.4, 20_000) ** 3
    f = lm.Filter(1, {0: lm.build_block(hashes, counts).tobytes()})
    got = f.count(hashes, np.zeros(len(hashes), np.int64))
    exact = lm.TYPICAL[lm.grade(counts)]
    assert (got >= exact).all() and np.mean(got == exact) > 0.98
    other = f.count(rng.integers(2**63, 2**64 - 1, 50_000, dtype=np.uint64), np.zeros(50_000, np.int64))
    assert np.mean(other > 0) < 0.02
    assert np.all(np.abs(np.log(exact / counts)) < 0.25)


def test_grades_and_typical_counts():
    assert lm.grade(np.array([1, 2, 3, 4, 5, 6, 7])).tolist() == [1, 2, 3, 4, 4, 5, 5]
    assert lm.TYPICAL[:6].tolist() == [0, 1, 2, 3, 4.5, 6.5]


def test_the_corpus_is_read_as_often_for_a_filter_of_any_size(documents, monkeypatch):
    seen = []
    stored = lm.stored
    monkeypatch.setattr(lm, "stored", lambda df, what, **options: seen.append(what) or stored(df, what, **options))
    monkeypatch.setattr(lm, "PART_BYTES", 2000)
    monkeypatch.setattr(lm, "ROUND_BYTES", 1000)
    rows = list(enumerate(texts(3, 100)))
    want = brute(rows)
    found = {r.doc_id: (r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in lm.score(documents(rows), one_in_five()).collect()}
    assert found == {d: x[:4] for d, x in want.items()}
    assert len(seen) <= 2, seen  # a table for each round over the corpus before


def test_a_common_word_is_sent_once_per_group():
    columns = [1, 2, 3], [False, True, False], ["the " * 200_000, "the cat", None]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "held", "__text"])
    sent = pa.Table.from_batches(lm._send(lm._keep([batch]), 3))
    assert sum(sent.column("words").to_pylist()) == 3  # the, cat, the end
    assert sum(len(x) for x in sent.column("data").to_pylist()) < 1000
    parts = [sent.filter(pc.equal(sent.column("part"), p)) for p in sorted(set(sent.column("part").to_pylist()))]
    made = pa.concat_tables([lm._count(p) for p in parts])
    assert (sum(made.column("total").to_pylist()), sum(made.column("distinct").to_pylist())) == (200_002, 2)
