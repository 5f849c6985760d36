"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The model is of words and pairs of words:

    p(w | v) = (c(v w) + mu q(w)) / (c(v) + mu),   q(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

with mu = SMOOTHING * N, a text's start as first v, and an end as last w. Counts are quantised on
a logarithmic scale: an n-gram whose count has grade g is put into a Bloom filter g times, with
the numbers 1 to g. Probing for 1, 2, .. until one is missing gives back the grade, never less
than the true one.

Counting: texts are kept in groups of about GROUP bytes. A group sends its distinct words and pairs,
each once with its number in training texts, to parts by their hash. A part adds up the exact counts,
builds its own filter block and probes it for everything it was sent. The number of parts follows the bytes
of the input, so a part and its block have a bounded size, and a word reaches its part once per group
however often it occurs.

Scoring: each group gets back the exact counts of its words and the grades of its words and pairs, in the
order it sent them, reads its texts once more and adds up the scores. So the corpus is read as often for any
size of the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from cohortwise.llm import packed, texts
from cohortwise.llm.common import stored

U64 = np.uint64
START, END = U64(0x51A7C0DE51A7C0DE), U64(0xE2DC0DE5E2DC0DE5)
SMOOTHING = 0.004
BASE = 1.5
BITS, PROBES = 12, 4
#: Text bytes whose words and pairs a part gets.
PART_BYTES = 16 << 20
#: Text bytes whose words and pairs travel together.
GROUP = 8 << 20
#: Bytes of hashes that are probed at once.
ROUND_BYTES = 64 << 20

KEPT = "gid long, bytes long, learning long, ids array<{}>, held array<boolean>, sizes binary, texts binary"
SENT = "part int, gid long, words int, data binary"
SENT_ARROW = pa.schema([("part", pa.int32()), ("gid", pa.int64()), ("words", pa.int32()), ("data", pa.binary())])
MADE = "part int, gid long, words int, data binary, total long, distinct long"
MADE_ARROW = pa.schema([("part", pa.int32()), ("gid", pa.int64()), ("words", pa.int32()), ("data", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, the one before, row): the words of each row and its end; before the first stands START."""
    data = texts.LOWER[data]
    start, end, row = texts.words(data, offsets)
    n, rows = len(start), len(offsets) - 1
    stop = np.searchsorted(row, np.arange(1, rows + 1)) + np.arange(rows)
    token = np.empty(n + rows, U64)
    token[np.arange(n) + row] = texts.window_hash(texts.prefix_sums(data), start, end)
    token[stop] = END
    before = np.concatenate(([START], token[:-1]))
    before[stop[:-1] + 1] = START
    where = np.empty(n + rows, np.int64)
    where[np.arange(n) + row] = row
    where[stop] = np.arange(rows)
    return token, before, where


def grade(count: np.ndarray) -> np.ndarray:
    """1 for a count of one, and one more for each further step of BASE."""
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def typical() -> np.ndarray:
    """A count for each grade: the middle of those that have it, 0 for grade 0."""
    out, low = [0.0], 1
    for g in range(1, 110):
        high = max(low, int(np.ceil(BASE**g - 1e-9)) - 1)
        out.append((low + high) / 2)
        low = high + 1
    return np.array(out)


TYPICAL = typical()


def _positions(hashes: np.ndarray, level: np.ndarray, bits: np.ndarray, probe: int) -> np.ndarray:
    h = texts.mix(hashes + level.astype(U64) * U64(0x9E3779B97F4A7C15))
    x = (h >> U64(32)) + U64(probe) * (h & U64(0xFFFFFFFF) | U64(1)) & U64(0xFFFFFFFF)
    return (x * bits.astype(U64) >> U64(32)).astype(np.int64)


def build_block(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Filter bytes of n-grams with their counts."""
    grades = grade(counts)
    bits = max(64, int(grades.sum()) * BITS)
    filled = np.zeros(-(-bits // 8) * 8, bool)
    for level in range(1, int(grades.max(initial=0)) + 1):
        these = hashes[grades >= level]
        for probe in range(PROBES):
            filled[_positions(these, np.full(len(these), level), np.full(len(these), bits), probe)] = True
    return np.concatenate((np.array([bits], "<i8").view(np.uint8), np.packbits(filled, bitorder="little")))


class Filter:
    """Blocks of some parts; probing gives the typical count of each n-gram's grade."""

    def __init__(self, parts: int, blocks: dict[int, bytes]):
        self.parts, self.bytes = parts, np.frombuffer(b"".join(b[8:] for b in blocks.values()), np.uint8)
        self.here = np.zeros(parts, bool)
        self.first, self.bits = np.zeros(parts, np.int64), np.ones(parts, np.int64)
        at = 0
        for part, block in blocks.items():
            self.here[part] = True
            self.first[part], self.bits[part] = at, int(np.frombuffer(block[:8], "<i8")[0])
            at += len(block) - 8

    def grades(self, hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
        grades = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        level = 0
        while len(alive):
            level += 1
            for probe in range(PROBES):
                p = part[alive]
                at = _positions(hashes[alive], np.full(len(alive), level), self.bits[p], probe)
                alive = alive[self.bytes[self.first[p] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 > 0]
            grades[alive] = level
        return np.minimum(grades, len(TYPICAL) - 1)

    def count(self, hashes: np.ndarray, part: np.ndarray) -> np.ndarray:
        return TYPICAL[self.grades(hashes, part)]


@texts.trimmed
def _keep(batches) -> Iterator[pa.RecordBatch]:
    """A row for each group of texts, with its texts compressed together."""
    groups, compress = packed.numbers(), ZstdCompressor(level=1).compress
    for batch in batches:
        ids, held, _ = batch.columns
        for first, end, data, offsets in texts.pieces(batch, "__text", GROUP):
            n = end - first
            learning = n - int(held.slice(first, n).to_numpy(zero_copy_only=False).astype(bool).sum())
            one = [pa.array([x]) for x in (next(groups), len(data), learning)]
            lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), x.slice(first, n)) for x in (ids, held)]
            blobs = [texts.binary([x]) for x in (packed.planes(np.diff(offsets)), compress(data.tobytes()))]
            yield pa.RecordBatch.from_arrays([*one, *lists, *blobs], ["gid", "bytes", "learning", "ids", "held", "sizes", "texts"])


def _opened(sizes: bytes, squeezed: bytes) -> list[np.ndarray]:
    """Tokens of a group's texts, each with the one before and its row."""
    data = ZstdDecompressor().decompress(squeezed)
    offsets = np.concatenate(([0], np.cumsum(packed.unplanes(sizes), dtype=np.int64)))
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def find(first, data, offsets):
        token, before, row = tokens(data, offsets)
        return token, before, row + first

    return next(texts.groups(pa.RecordBatch.from_arrays([whole], ["__text"]), "__text", find, len(data) + 1))


def _numbered(hashes: np.ndarray, use: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes in order, how often each is in `use`, where each part begins and the last ends)."""
    distinct = np.unique(hashes)
    learned, times = np.unique(hashes[use], return_counts=True)
    count = np.zeros(len(distinct), np.uint32)
    count[np.searchsorted(distinct, learned)] = times
    part = (distinct >> U64(32)) * U64(parts) >> U64(32)  # in the order of the hashes
    return distinct, count, np.searchsorted(part, np.arange(parts + 1, dtype=U64))


def _rising(hashes: np.ndarray) -> bytes:
    """Hashes in order as their differences, byte by byte of their significance."""
    return np.diff(hashes, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _risen(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=U64)


@texts.trimmed
def _send(batches, parts: int) -> Iterator[pa.RecordBatch]:
    compress = ZstdCompressor(level=1).compress
    for batch in batches:
        for gid, held, sizes, squeezed in zip(*(batch.column(batch.schema.get_field_index(x)) for x in ("gid", "held", "sizes", "texts"))):
            token, before, row = _opened(sizes.as_py(), squeezed.as_py())
            use = ~held.values.to_numpy(zero_copy_only=False).astype(bool)[row]
            word, trained, cuts = _numbered(token, use, parts)
            couple, count, couple_cuts = _numbered(texts.pair(before, token), use, parts)
            out: dict[str, list] = {f.name: [] for f in SENT_ARROW}
            for p in np.flatnonzero(np.diff(cuts) + np.diff(couple_cuts)).tolist():
                mine, theirs = slice(cuts[p], cuts[p + 1]), slice(couple_cuts[p], couple_cuts[p + 1])
                data = _rising(word[mine]) + packed.planes(trained[mine]) + _rising(couple[theirs]) + packed.planes(count[theirs])
                for name, value in (("part", p), ("gid", gid.as_py()), ("words", int(cuts[p + 1] - cuts[p])), ("data", compress(data))):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in SENT_ARROW], schema=SENT_ARROW)


def _totals(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, index of each given one, sum of counts)."""
    distinct, back = np.unique(np.concatenate(hashes), return_inverse=True)
    return distinct, back, np.bincount(back, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _count(table: pa.Table) -> pa.Table:
    """The answers of one part to each group, in the order of what the group sent."""
    gids, numbers = table.column("gid").to_pylist(), table.column("words").to_pylist()
    expand, compress = ZstdDecompressor().decompress, ZstdCompressor(level=1).compress
    sent: list[list[np.ndarray]] = [[], [], [], []]
    for n, squeezed in zip(numbers, table.column("data")):
        raw = expand(squeezed.as_py())
        m = (len(raw) - 12 * n) // 12
        for found, of, read, a, b in zip(sent, (n, n, m, m), (_risen, packed.unplanes) * 2, (0, 8 * n, 12 * n, 12 * n + 8 * m), (8 * n, 12 * n, 12 * n + 8 * m, 12 * (n + m))):
            found.append(read(raw[a:b]) if of else np.zeros(0, U64))
    known, back, total = _totals(sent[0], sent[1])
    pairs, pair_back, pair_total = _totals(sent[2], sent[3])
    seen, met = total > 0, pair_total > 0
    f = Filter(1, {0: build_block(np.concatenate((known[seen], pairs[met])), np.concatenate((total[seen], pair_total[met]))).tobytes()})
    step = max(1, ROUND_BYTES // 8)

    def grades(hashes):
        return np.concatenate([np.zeros(0, np.uint8), *(
            f.grades(hashes[a:a + step], np.zeros(len(hashes[a:a + step]), np.int64)).astype(np.uint8) for a in range(0, len(hashes), step))])

    word_grades, pair_grades = grades(known), grades(pairs)
    data, at, pair_at = [], 0, 0
    for words, couples in zip(sent[0], sent[2]):
        mine, theirs = back[at:at + len(words)], pair_back[pair_at:pair_at + len(couples)]
        exact = total[mine].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
        data.append(compress(exact + word_grades[mine].tobytes() + pair_grades[theirs].tobytes()))
        at, pair_at = at + len(words), pair_at + len(couples)
    rest = [0] * (len(gids) - 1)
    made = table.column("part").to_pylist(), gids, numbers, data, [int(total.sum()), *rest], [int(seen.sum()), *rest]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(made, MADE_ARROW)], schema=MADE_ARROW)


def _score(kept: pa.Table, made: pa.Table, total: int, distinct: int, starts: int) -> pa.Table:
    """The texts of one group with their scores."""
    expand, exact, word_grades, pair_grades = ZstdDecompressor().decompress, [], [], []
    for i in np.argsort(made.column("part").to_numpy()).tolist():
        raw, n = np.frombuffer(expand(made.column("data")[i].as_py()), np.uint8), made.column("words")[i].as_py()
        exact.append(np.ascontiguousarray(raw[:8 * n].reshape(8, n).T).view("<i8").ravel())
        word_grades.append(raw[8 * n:9 * n])
        pair_grades.append(raw[9 * n:])
    (ids, held), (sizes, squeezed) = (kept.column(x)[0].values for x in ("ids", "held")), (kept.column(x)[0].as_py() for x in ("sizes", "texts"))
    token, before, row = _opened(sizes, squeezed)
    mu = max(SMOOTHING * total, 1.0)
    below = total + 0.5 * (distinct + 1)
    back, couple = (np.unique(x, return_inverse=True)[1] for x in (token, texts.pair(before, token)))
    trained, count = np.concatenate(exact), TYPICAL[np.concatenate(word_grades)]
    value = np.log10(TYPICAL[np.concatenate(pair_grades)][couple] + (mu * (count + 0.5) / below)[back])
    # each word but the end is the context of the next token
    value -= np.where(token == END, 0.0, np.log10(count + mu)[back])
    value[before == START] -= np.log10(starts + mu)
    n_tokens = np.bincount(row, minlength=len(ids))

    def sums(of):
        return np.bincount(row, weights=of, minlength=len(ids))

    return pa.table({
        "id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": sums((trained > 0)[back]).astype(np.int64),
        "base_score": sums(np.log10(trained + 0.5)[back]) - n_tokens * np.log10(below), "score": sums(value)})


def score(docs: DataFrame, held_out, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of all texts by a model of the texts that are not held out.

    `held_out` is a boolean column expression. Words are runs of bytes other than white space, A-Z in lower
    case; each text has one end, counted as a token. Returns id_column, held_out, n_tokens,
    n_known (tokens that occur in training texts), train_tokens, base_score (sum of log10 q(w) with
    exact counts), score (log10 probability of the model above, counts from the filter), one row
    per row of `docs`. Null and empty texts are an end alone. Repeated rows are counted as often
    as they occur and have equal scores; null ids are ids like others. Without training texts all
    counts are zero.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("__text"))
    kept = stored(rows.mapInArrow(_keep, KEPT.format(kind)), "texts", maxRecordsPerFile=8)
    size, starts = kept.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("bytes", "learning"))).first()
    parts = max(1, -(-size // PART_BYTES))

    def count(table):
        try:
            return _count(table)
        finally:
            texts.release()

    sent = kept.select("gid", "held", "sizes", "texts").mapInArrow(partial(_send, parts=parts), SENT)
    made = stored(sent.groupBy("part").applyInArrow(count, MADE), "counts")
    total, distinct = made.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in ("total", "distinct"))).first()

    def read(group, answers):
        try:
            return _score(group, answers, total, distinct, starts)
        finally:
            texts.release()

    groups, answers = kept.select("gid", "ids", "held", "sizes", "texts").groupBy("gid"), made.select("part", "gid", "words", "data").groupBy("gid")
    scored = groups.cogroup(answers).applyInArrow(
        read, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(id_column), "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
