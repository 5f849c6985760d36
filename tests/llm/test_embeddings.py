"""Near-duplicate embeddings against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from cohortwise.llm import embeddings


def brute(ids, vectors, threshold=0.95):
    ok = [i for i, v in enumerate(vectors) if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i in range(len(ids))}
    for i in ok:
        for j in ok:
            a, b = np.array(vectors[i], float), np.array(vectors[j], float)
            if i != j and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links[i].add(j)
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(ids[j] for j in seen)
        out.append((ids[i], len(links[i]), least, least == ids[i]))
    return sorted(out)


def cloud(seed, n, d):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    near = base[rng.integers(0, len(base), n - len(base))]
    near = near + rng.normal(size=near.shape) * np.linalg.norm(near, axis=1, keepdims=True) / np.sqrt(d) * rng.uniform(0, 0.5, (len(near), 1))
    return np.concatenate((base, near)).astype(np.float32)


def run(spark, rows):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as label", "2 as node", "4 as n_links")
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect())


@pytest.mark.parametrize("d, block", [(3, 64), (24, 2048), (24, 50)])
def test_like_brute_force(spark, monkeypatch, d, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    x = cloud(d, 500, d)
    ids = [int(i) for i in np.random.default_rng(1).permutation(len(x)) * 3 - 40]
    want = brute(ids, x.astype(float).tolist())
    assert run(spark, list(zip(ids, x.tolist()))) == want
    assert sum(w[1] for w in want) > 100


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v), (2, [2.0, 4.0, 6.0]), (3, v), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [inf, 1.0, 1.0]), (8, [nan, 1.0, 1.0]),
            (9, []), (10, [1.0, 2.0]), (11, [-1.0, -2.0, -3.0]), (12, [3e38, 3e38, 3e38]), (13, [1e-30, 1e-30, 1e-30])]
    got = {r[0]: r[1:] for r in run(spark, rows)}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), **{i: (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11)}, 12: (1, 12, True), 13: (1, 12, False)}


def test_repeated_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0])] * 3 + [(None, [1.0, 0.001])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(frame).collect()} == {(1, 3, 1, True), (None, 3, 1, False)}
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]


def test_vectors_of_several_lengths(spark):
    parts = [(24, 400), (16, 300), (3, 40)]
    rows, want = [], []
    for k, (d, n) in enumerate(parts):
        x = cloud(d, n, d)
        ids = [int(i) * 3 + k for i in range(len(x))]
        rows += zip(ids, x.tolist())
        want += brute(ids, x.astype(float).tolist())
        assert sum(w[1] for w in want[-n:]) > 10
    rows += [(5000, [2.0]), (5001, [5.0]), (5002, [1.0] * 7)]
    assert run(spark, rows) == sorted([*want, (5000, 1, 5000, True), (5001, 1, 5000, False), (5002, 0, 5002, True)])


def test_cosines_close_to_the_threshold_are_decided_in_double_precision():
    rng = np.random.default_rng(6)
    vectors = []
    for i in range(200):
        a, b = rng.normal(size=(2, 48))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        t = 0.95 + (i % 2 * 2 - 1) * 1e-9
        vectors += [a * 3, (t * a + np.sqrt(1 - t * t) * b / np.linalg.norm(b)) * 0.5]
    linker = embeddings._Linker(pa.chunked_array([pa.array(vectors[:150]), pa.array(vectors[150:])]), np.ones(400), 0.95)
    linker.multiply(np.arange(400), np.arange(400), True)
    assert linker.links.tolist() == [0, 0, 1, 1] * 100
    assert linker.forest().tolist() == [x for i in range(0, 400, 4) for x in (i, i + 1, i + 2, i + 2)]


def test_structureless_vectors_go_to_each_pair_of_blocks_once():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 24))
    c = embeddings.fit_centroids(embeddings._unit(x), 30)
    cell = (embeddings._unit(x) @ c.T).argmax(axis=1)
    begin, pieces, blocks = embeddings._packed(embeddings._chain(c), dict(enumerate(np.bincount(cell, minlength=30).tolist())), 700, 0)

    class Layout:
        value = {24: (c, begin, pieces)}

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), pa.array(np.ones(3000, np.int64)), pa.array(x.tolist())], ["node", "copies", "vector"])
    dealt = pa.Table.from_batches(embeddings._deal([batch], Layout, 0.95))
    assert blocks <= 7 and set(dealt.column("cell").to_pylist()) == set(range(30))
    assert np.bincount(dealt.column("mine")).max() <= 700
    # each is sent to each visited cell before, and for each of those to all blocks of its members
    assert max(len(set(b)) for b in dealt.column("blocks").to_pylist()) == max(map(len, dealt.column("blocks").to_pylist())) <= blocks
    assert all(m in b for m, b in zip(dealt.column("mine").to_pylist(), dealt.column("blocks").to_pylist()))


@pytest.mark.parametrize("d", [20, 64])
def test_blocks_and_tiles_like_brute_force(monkeypatch, d):
    monkeypatch.setattr(embeddings, "TILE", 37)
    x = cloud(d, 400, d).astype(float)
    want = brute(list(range(len(x))), x.tolist())
    linker = embeddings._Linker(pa.chunked_array([pa.array(x.tolist())]), np.ones(len(x)), 0.95)
    rows = np.random.default_rng(8).permutation(len(x))
    for a, b, same in ((rows[:150], rows[:150], True), (rows[:150], rows[150:], False), (rows[150:], rows[150:], True)):
        linker.multiply(a, b, same)
    assert [(i, int(n), int(r), i == r) for i, (n, r) in enumerate(zip(linker.links, linker.forest()))] == want
    assert sum(w[1] for w in want) > 100
