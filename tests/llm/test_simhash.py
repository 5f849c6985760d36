from __future__ import annotations

import hashlib
import random

import pytest

from cohortwise.llm import simhash

MASK = (1 << 64) - 1


def edited(rows):
    """{(id, text): edited} for rows with different ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        h = len(t) // 2
        out[i] = t[:len(t) - h] + n[:h]
    return out


def prints(frame):
    return {r.doc_id: r for r in simhash.compare_neighbours(frame).collect()}


def some(seed, n):
    rng = random.Random(seed)
    words = [a + b for a in ("the", "ré", "on", "😀", "x") for b in ("tion", "a", "ing", "ß")]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_edited_texts_and_fingerprints(spark, documents):
    rng = random.Random(4)
    ids = rng.sample(range(-5000, 9000), 70) + [2**40, 2**40 + 1, -(2**50)]
    rows = list(zip(ids, some(1, len(ids))))
    rows[3], rows[4], rows[5] = (rows[3][0], None), (rows[4][0], ""), (rows[5][0], "one")
    got, want = prints(documents(rows)), edited(rows)
    assert sorted(got) == sorted(ids)
    # fingerprints of the edited texts by the operator itself
    again = simhash.fingerprints(spark.createDataFrame([(i, t) for i, t in want.items()], "i long, t string"), ["i"], "t")
    of_edited = {r.i: (r.low, r.high) for r in again.collect()}
    own = {r.i: (r.low, r.high) for r in simhash.fingerprints(spark.createDataFrame(rows, "i long, t string"), ["i"], "t").collect()}
    order = sorted(ids, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for i, t in rows:
        r = got[i]
        assert r.n_chars == len(t or "")
        assert r.edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
        assert (r.low, r.high) == own[i] and (r.edited_low, r.edited_high) == of_edited[i] and (r.next_low, r.next_high) == own[after[i]]


def test_votes(spark):
    text = "a bb ccc bb ccc"
    terms = ["a bb", "bb ccc", "ccc bb", "bb ccc", "ccc"]
    hashes = spark.createDataFrame([(t,) for t in terms], "t string").selectExpr("t", "xxhash64(t) a", "xxhash64(t, 1) b").collect()
    got = simhash.fingerprints(spark.createDataFrame([(1, text)], "i int, t string"), ["i"], "t").first()
    for side, value in (("a", got.low), ("b", got.high)):
        for bit in range(64):
            votes = sum(len(h.t) * (1 if h[side] >> bit & 1 else -1) for h in hashes)
            assert (value >> bit & 1) == (votes > 0)


def test_repeated_rows_null_ids_and_clashing_columns(documents):
    rows = [(5, "a b c d"), (5, "a b c d"), (5, "z"), (None, "n n"), (None, None), (1, " \n a  b c d ")]
    frame = documents(rows).selectExpr("*", "1 as low", "2 as __group", "3 as n_next")
    found = simhash.compare_neighbours(frame).collect()
    assert len(found) == len(rows)
    equal = {(r.low, r.high) for r in found if r.doc_id in (1, 5) and r.n_chars > 1}
    assert len(equal) == 1
    assert simhash.compare_neighbours(documents([])).count() == 0
    one = simhash.compare_neighbours(documents([(3, "ab cd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


@pytest.mark.parametrize("radius, blocks", [(3, 4), (3, 6), (1, 3), (0, 2)])
def test_near_like_brute_force(spark, radius, blocks):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(20)]
    for _ in range(150):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(128)
        base.append(x)

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    rows = [(signed(x & MASK), signed(x >> 64)) for x in base]
    frame = spark.createDataFrame(rows, "low long, high long")
    queries = frame.limit(60)
    asked = {tuple(r) for r in queries.collect()}
    got = {(r.query_low, r.query_high, r.low, r.high): r.distance for r in simhash.near(frame, queries, radius, blocks).collect()}
    want = {}
    for a in asked:
        for b in set(rows):
            d = bin((a[0] ^ b[0]) & MASK).count("1") + bin((a[1] ^ b[1]) & MASK).count("1")
            if d <= radius:
                want[(*a, *b)] = d
    assert got == want


@pytest.mark.parametrize("radius, blocks, chunk", [(26, 9, 1024), (26, 9, 2), (7, 5, 1024), (20, 7, 1024)])
def test_count_near_like_brute_force(spark, monkeypatch, radius, blocks, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(15)]
    for _ in range(250):
        base.append(rng.choice(base[:15]) ^ sum(1 << k for k in rng.sample(range(128), rng.randint(0, radius + 3))))
    base += base[:40]

    def signed(x):
        return x - (1 << 64) if x >> 63 else x

    frame = spark.createDataFrame([(signed(x & MASK), signed(x >> 64)) for x in base], "low long, high long")
    queries = [(signed(x & MASK), signed(x >> 64)) for x in base[:80]]
    got = {(r.query_low, r.query_high): r.n_near for r in simhash.count_near(frame, spark.createDataFrame(queries, "low long, high long"), radius, blocks).collect()}
    want = {(signed(x & MASK), signed(x >> 64)): sum((x ^ y).bit_count() <= radius for y in base) for x in base[:80]}
    assert got == want and max(want.values()) > 10


def test_query_finds_ordinary_near_copies(spark, documents, tmp_path):
    from cohortwise.llm.queries import op10_document_fingerprints

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(0, 1500, 50):
        text = rng.choices(words, k=200)
        rows.append((i, " ".join(text)))
        for k in (1, 2, 3):
            for at in rng.sample(range(200), 2 * k):
                text[at] = "changed"
            rows.append((i + k, " ".join(text)))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.n_near for r in op10_document_fingerprints(spark, str(tmp_path)).collect()}
    assert all(found[i] is None for i, _ in rows if i % 50)
    assert sum(found[i] for i in range(0, 1500, 50)) >= 0.95 * 90 and max(found[i] for i in range(0, 1500, 50)) == 3


def test_no_python_in_the_plan(spark, documents):
    plan = simhash.compare_neighbours(documents([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))
