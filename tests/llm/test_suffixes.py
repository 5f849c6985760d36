"""Repeated byte strings against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from zstandard import ZstdCompressor

from cohortwise.llm import suffixes


def brute(rows, window=200):
    """{(id, text): (bytes, removed, runs, kept)}; rows equal in id and text are one document."""
    docs = sorted({(i, t or "") for i, t in rows}, key=str)
    raw = {d: d[1].encode() for d in docs}
    seen = Counter(x[s:s + window] for x in raw.values() for s in range(len(x) - window + 1))
    out = {}
    for d, x in raw.items():
        gone = np.zeros(len(x) + 1, bool)
        for s in range(len(x) - window + 1):
            if seen[x[s:s + window]] > 1:
                gone[s:s + window] = True
        keep = bytes(b for b, g in zip(x, gone) if not g)
        out[d] = (len(x), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum() + gone[0]), keep)
    return out


def run(frame):
    found = suffixes.remove_repeated_bytes(frame).collect()
    return [((r.doc_id, r.text or ""), (r.n_bytes, r.n_removed, len(r.removed_at) // 2, bytes(r.kept_bytes))) for r in found]


def passages(seed: int, n: int, letters: str) -> list[str]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.choice([150, 199, 200, 201, 260, 700]))) for _ in range(6)]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 500)))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            if rng.random() < 0.4:
                a = rng.randrange(len(p))
                p = p[:a] + rng.choice(letters) + p[a + 1:]
            at = rng.randint(0, len(text))
            text = text[:at] + p + text[at:]
        out.append(text)
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghij ", "aéß漢😀 \n"])
def test_like_brute_force(documents, letters):
    rows = list(enumerate(passages(len(letters), 50, letters)))
    want, got = brute(rows), run(documents(rows))
    assert len(got) == len(rows)
    for key, value in got:
        assert want[key] == value


def test_hot_gram_in_blocks(documents, monkeypatch):
    rng = random.Random(7)
    line = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) + line[rng.randint(0, 30):] + str(i)) for i in range(60)]
    rows += [(100 + i, line) for i in range(3)]
    monkeypatch.setattr(suffixes, "UNIT", 7)
    monkeypatch.setattr(suffixes, "INDEXED", 3000)
    flags, real = [], suffixes._contexts_of_grams
    monkeypatch.setattr(suffixes, "_contexts_of_grams", lambda *a: flags.append(real(*a)) or flags[-1])
    want, got = brute(rows), local_run(rows)
    assert got == want
    assert max(int(v[:, 1].max() & np.uint64(2**32 - 1)) for _, v in flags if len(v)) > 3


def local_run(rows, window=200):
    """The steps of the operator in this process, with its present constants."""
    import pyarrow as pa
    from pyarrow import compute

    from cohortwise.llm import packed

    def batch(extra=None):
        columns = {"__k": pa.array([i for i, _ in rows], pa.int64()), "__tie": pa.array([hash(t) for _, t in rows], pa.int64()), "text": pa.array([t for _, t in rows]), "__z": pa.array([ZstdCompressor().compress(t.encode()) for _, t in rows])}
        return pa.RecordBatch.from_pydict(columns | (extra or {}))

    def exchange(sent, answer):
        table = pa.Table.from_batches(sent, packed.ROWS_ARROW)
        parts = set(table.column("part").to_pylist())
        answers = pa.concat_tables([answer(table.filter(compute.equal(table.column("part"), p))) for p in parts])
        groups = set(answers.column("gid").to_pylist())
        return pa.concat_tables([packed.by_document(answers.filter(compute.equal(answers.column("gid"), g))) for g in groups])

    def joined(replies):
        by = {}
        for r in replies.to_pylist():
            by.setdefault(r["__k"], ([], []))[0].append(r["__tie"])
            by[r["__k"]][1].append(r["at"])
        both = [by.get(i, (None, None)) for i, _ in rows]
        return batch({"__ties": pa.array([a for a, _ in both], pa.list_(pa.int64())), "__ats": pa.array([b for _, b in both], pa.list_(pa.binary()))})

    flags = exchange(list(suffixes._send_grams([batch()], "text", 3, window)), lambda t: packed.answered(t, suffixes._contexts_of_grams))
    found = exchange(list(suffixes._send_contexts([joined(flags)], 3, window)), lambda t: suffixes._match_contexts(t, window))
    schema = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("kept_bytes", pa.binary()), ("removed_at", pa.list_(pa.int32()))])
    out = pa.Table.from_batches(list(suffixes._cut([joined(found)], "text", schema)), schema).to_pylist()
    return {row: (o["n_bytes"], o["n_removed"], len(o["removed_at"]) // 2, o["kept_bytes"]) for row, o in zip(rows, out)}


def test_odd_rows(documents):
    rng = random.Random(3)
    p = "".join(rng.choice("abcdef ") for _ in range(400))
    long = "".join(rng.choice("abcdef ") for _ in range(3_000_000))
    rows = [(1, p), (1, p), (2, None), (3, ""), (4, "x"), (None, "z" + p[:250]), (None, "zz"), (5, long), (6, long[1_000_000:1_000_300])]
    got = dict(run(documents(rows)))
    assert got[(1, p)][1] == 250 and got[(None, "z" + p[:250])][1] == 250
    assert got[(5, long)][1] == 300 and got[(6, long[1_000_000:1_000_300])][3] == b""
    assert got[(2, "")] == got[(3, "")] == (0, 0, 0, b"")
    assert len(run(documents(rows))) == len(rows)


def test_repeated_rows_are_no_copies(documents):
    rng = random.Random(5)
    p = "".join(rng.choice("abcdef ") for _ in range(400))
    assert [v[1] for _, v in run(documents([(1, p), (1, p)]))] == [0, 0]


def test_empty_table(documents):
    assert run(documents([])) == []


def test_statistics_of_any_strings():
    rng = random.Random(11)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 8))]
        data = np.frombuffer(b"".join(strings), np.uint8)
        stop = np.repeat(np.cumsum([len(s) for s in strings]), [len(s) for s in strings])
        suffix = [bytes(data[i:e]) for i, e in enumerate(stop)]

        def agree(a, b):
            return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        want = [max([agree(s, t) for j, t in enumerate(suffix) if j != i], default=0) for i, s in enumerate(suffix)]
        assert suffixes.matching_statistics(data, stop).tolist() == want


def test_whole_copies_in_one_task_and_in_several(documents):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("abcdef ") for _ in range(700))) for i in range(30)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    want = brute(rows)
    assert local_run(rows) == want and {k: v for k, v in run(documents(rows))} == want
    assert sum(v[3] == b"" for v in want.values()) == 20
