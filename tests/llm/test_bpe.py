"""Token ids against the tiktoken library."""

from __future__ import annotations

import hashlib
import random
import time
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken

from cohortwise.llm import bpe
from cohortwise.llm.common import public_vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return public_vocabulary()


def reference(ranks, pattern):
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def odd_texts(seed=1, n=150):
    rng = random.Random(seed)
    parts = ["the", " of", "ion", "é", "ß", "漢字", "😀", "\n\n", "  ", "\t", "'s", "'LL", "123", "$$$", "aaaaaaa", "ab" * 5, "<|endoftext|>", " ", "\r\n", "Ünïcödé", "и"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_like_tiktoken(documents, vocabulary):
    rows = list(enumerate([*odd_texts(), None, "", " ", "x" * 5000, "ab " * 40_000]))
    frame = documents(rows).selectExpr("*", "1 as token_ids", "'y' as decoded")
    got = {r.doc_id: (list(r.token_ids), bytes(r.decoded)) for r in bpe.encode(frame, *vocabulary).collect()}
    library = reference(*vocabulary)
    for i, t in rows:
        assert got[i][0] == library.encode_ordinary(t or "")
        assert got[i][1] == (t or "").encode()


def test_query_digests(spark, vocabulary):
    from cohortwise.llm.queries import op7_byte_level_bpe

    folder = "/root/testdata/sf0.001"
    library = reference(*vocabulary)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op7_byte_level_bpe(spark, folder).collect():
        ids = library.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_any_ranks(seed):
    """Vocabularies in which a later merge can make an earlier one possible."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    while len(tokens) < 340:
        tokens.add(bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))))
    late = sorted(t for t in tokens if len(t) > 1)
    rng.shuffle(late)
    ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + late)}
    vocabulary = bpe.Vocabulary(ranks, r"\w+|\W+")
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 14))) for _ in range(300)]
    words = [w for w in words if w not in ranks]
    ids, ends = bpe.replay(words, vocabulary)
    for w, a, b in zip(words, ends[:-1], ends[1:]):
        assert ids[a:b].tolist() == vocabulary.one(w)


def test_empty_table(documents, vocabulary):
    assert bpe.encode(documents([]), *vocabulary).count() == 0


def test_every_text_is_read_in_blocks(monkeypatch, vocabulary):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    known, pattern = bpe.Vocabulary(*vocabulary), regex.compile(public_tokenizers.PATTERN)
    column = pa.array([*odd_texts(2, 30), None])
    parts = [bpe._encoded(column.slice(a, b - a), known, pattern) for a, b in bpe._blocks(column)]
    assert len(parts) > 10
    ids = pa.concat_arrays(parts)
    assert ids.to_pylist() == [reference(*vocabulary).encode_ordinary(t) for t in odd_texts(2, 30)] + [[]]
    assert bpe._decoded(ids, known).to_pylist() == [t.encode() for t in odd_texts(2, 30)] + [b""]


@pytest.mark.parametrize("remembered", [1 << 20, 100])
def test_pieces_of_earlier_blocks_are_not_merged_again(monkeypatch, vocabulary, remembered):
    monkeypatch.setattr(bpe, "BLOCK", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", remembered, raising=False)
    merged, replay = [], bpe.replay
    monkeypatch.setattr(bpe, "replay", lambda words, known: merged.extend(words) or replay(words, known))
    rows = [*odd_texts(3, 40), "qwertzuiop yxcvbnm " * 30, None, *odd_texts(3, 40)]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(part, pa.string())}) for part in (rows, [], rows)]
    shared = SimpleNamespace(value=bpe.Vocabulary(*vocabulary))
    out = pa.Table.from_batches(list(bpe._code(iter(batches), shared, "text"))).to_pylist()
    library = reference(*vocabulary)
    assert [(r["text"], r["token_ids"], r["decoded"]) for r in out] == [
        (t, library.encode_ordinary(t or ""), (t or "").encode()) for t in [*rows, *rows]]
    if remembered > 100:
        assert len(merged) == len(set(merged)) > 10


@pytest.mark.parametrize("letters", ["abcdefghijklmnopqrstuvwxyz", "一二三四五六七八九十百千的是不了在人有我他这", "กขคงจฉชซญดตถทธนบปผ", "é", "ab"])
def test_long_runs_of_letters(vocabulary, letters):
    """100,000 letters without a break are encoded in about a second, equal to the library."""
    rng = random.Random(3)
    text = "".join(rng.choice(letters) for _ in range(100_000))
    known, pattern = bpe.Vocabulary(*vocabulary), regex.compile(public_tokenizers.PATTERN)
    start = time.perf_counter()
    ids, _ = bpe.encode_block([text], known, pattern)
    seconds = time.perf_counter() - start
    assert ids.tolist() == reference(*vocabulary).encode_ordinary(text)
    assert seconds < 10  # about half a second; the rest is for a busy machine


def test_encoder_and_decoder_alone(spark, documents, vocabulary):
    shared = spark.sparkContext.broadcast(bpe.Vocabulary(*vocabulary))
    frame = documents([(1, "some text"), (2, None)]).withColumn("ids", bpe.encoder(shared)("text"))
    assert {r.doc_id: bytes(r.back) for r in frame.withColumn("back", bpe.decoder(shared)("ids")).collect()} == {1: b"some text", 2: b""}
