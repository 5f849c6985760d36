"""Byte-level BPE by merge replay: all merges of a block of texts in rank order, over an inverted index.

A task takes about BLOCK bytes of text at a time, splits them with the vocabulary's pattern and
keeps each distinct piece once. Blocks wait until BLOCK bytes of pieces are new, or their batch ends, and only the new ones
are merged, together: a task remembers the ids of up to REMEMBERED bytes of pieces, and then begins anew. The index holds, for each pair of tokens that a merge joins, the
places where the pair stands in any piece. The lowest rank present is taken from a heap, all its
places are merged at once, and only the pairs with the neighbours on both sides are looked up
and entered anew. No shuffle, and no state between tasks. Rows leave
a task as soon as their pieces are merged; a text longer than a block is cut between pieces.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyarrow import compute
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from cohortwise.llm import texts

#: Bytes of text that are encoded together, and token ids that are decoded together.
BLOCK = 1 << 20
#: Bytes of distinct pieces (and PIECE for each) whose ids a task keeps from block to block.
REMEMBERED, PIECE = 1 << 25, 200
NONE = np.int64(1 << 40)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a token in base64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Tokens, the rank of each pair that joins to a token, and the pattern that cuts texts into pieces.

    Every byte must be a token. Its size is that of its file, so it can be broadcast.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        joined = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    joined[left << 32 | right] = rank
        self.pairs = np.array(sorted(joined), np.int64)
        self.pair_ranks = np.array([joined[p] for p in self.pairs.tolist()], np.int64)
        # tokens that join with a neighbour to a token of lower rank: of several places in a piece the order matters
        sides = np.stack((self.pairs >> 32, self.pairs & 0xFFFFFFFF))
        self.early = set(sides[sides > self.pair_ranks].tolist())
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.two = np.full((256, 256), NONE)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.two[token[0], token[1]] = rank

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], NONE) if len(self.pairs) else np.full(len(key), NONE)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of these ids, one after another. An unknown id is an error."""
        if "flat" not in self.__dict__:
            sizes = np.zeros(max(self.tokens) + 1, np.int64)
            sizes[list(self.tokens)] = [len(t) for t in self.tokens.values()]
            self.sizes, self.starts = sizes, np.cumsum(sizes) - sizes
            self.flat = np.frombuffer(b"".join(self.tokens[r] for r in sorted(self.tokens)), np.uint8)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
            raise ValueError("a token id is not in the vocabulary")
        size = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids], size) + texts.ragged(size)]

    def one(self, piece: bytes) -> list[int]:
        """A single piece, merge by merge, from a heap of (rank, place) over linked parts.

        For pieces in which two places of a rank make a pair of lower rank possible.
        """
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i:i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, i) for i in range(n - 1) if (rank := ranks.get(piece[i:i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            left, j = parts[i], after[i]
            # an entry is void if its part is gone or has another neighbour by now
            if left is None or j >= n or ranks.get(left + parts[j]) != rank:
                continue
            parts[i], parts[j] = left + parts[j], None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (further := ranks.get(parts[i] + parts[k])) is not None:
                    heappush(heap, (further, i))
            h = before[i]
            if h >= 0 and (further := ranks.get(parts[h] + parts[i])) is not None:
                heappush(heap, (further, h))
        return [ranks[p] for p in parts if p is not None]


def replay(words: list[bytes], vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(token ids of all words, n+1 offsets); the words are not empty."""
    lengths = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(lengths)
    data = np.frombuffer(b"".join(words), np.uint8)
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    token = vocabulary.bytes[data]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1] = -1
    before[ends - lengths] = -1
    rank = np.full(n, NONE)
    rank[:-1] = vocabulary.two[data[:-1], data[1:]]
    rank[ends - 1] = NONE
    alive = np.ones(n, bool)
    odd: list[np.ndarray] = []
    index: dict[int, list[np.ndarray]] = {}

    def enter(places: np.ndarray) -> np.ndarray:
        ranks = rank[places]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.concatenate(([0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1)) if len(ranks) else np.zeros(0, np.int64)
        starts = cuts.tolist()
        for r, a, b in zip(ranks[cuts].tolist(), starts, [*starts[1:], len(places)]):
            if r not in index:
                index[r] = []
                heappush(heap, r)
            index[r].append(places[a:b])
        return ranks

    heap: list[int] = []
    enter(np.flatnonzero(rank < NONE))
    heapify(heap)
    while heap:
        r = heappop(heap)
        at = np.concatenate(index.pop(r))
        at = at[rank[at] == r]
        at.sort()
        if len(at) > 1:  # a place may have been entered twice
            at = at[np.concatenate(([True], at[1:] != at[:-1]))]
        if not len(at):
            continue
        second = after[at]
        meets = second[:-1] == at[1:]
        if meets.any():  # of overlapping places every other one, from the left
            here = np.arange(len(at))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], ~meets)), here, 0))
            keep = (here - first) % 2 == 0
            at, second = at[keep], second[keep]
        if r in vocabulary.early:
            word, times = np.unique(np.searchsorted(ends, at, "right"), return_counts=True)
            odd.append(word[times > 1])
        follow = after[second]
        token[at] = r
        after[at] = follow
        inner = follow >= 0
        before[follow[inner]] = at[inner]
        alive[second] = False
        rank[second] = NONE
        rank[at] = NONE
        rank[at[inner]] = vocabulary.rank_of(token[at[inner]], token[follow[inner]])
        left = before[at]
        left = left[left >= 0]
        rank[left] = vocabulary.rank_of(token[left], token[after[left]])
        touched = np.concatenate((at, left))
        touched = touched[rank[touched] < NONE]
        if len(touched):
            enter(touched)
    kept = np.flatnonzero(alive)
    ids, offsets = token[kept], np.concatenate(([0], np.searchsorted(kept, ends)))
    if odd:
        length, parts, end = np.diff(offsets), [], 0
        for w in np.unique(np.concatenate(odd)).tolist():
            own = vocabulary.one(words[w])
            parts += [ids[end:offsets[w]], np.array(own, np.int64)]
            length[w], end = len(own), offsets[w + 1]
        ids, offsets = np.concatenate([*parts, ids[end:]]), np.concatenate(([0], np.cumsum(length)))
    return ids, offsets


class Memory:
    """Token ids of the distinct pieces a task has met, one after another, with the place of each piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.bytes, self.new = 0, 0

    def places(self, pieces: list[str]) -> np.ndarray:
        """The place of each piece. `new` counts the bytes that wait to be merged."""
        known = self.known
        unknown = set(pieces).difference(known)
        known.update(zip(unknown, range(len(known), len(known) + len(unknown))))
        self.new += sum(map(len, unknown))
        return np.fromiter(map(known.__getitem__, pieces), np.int32, len(pieces))

    def merge(self) -> None:
        """Token ids of the pieces that have none yet."""
        words = [p.encode() for p in islice(self.known, len(self.start), None)]
        whole = np.fromiter((self.vocabulary.ranks.get(w, -1) for w in words), np.int64, len(words))
        split = np.flatnonzero(whole < 0)
        ids, offsets = replay([words[i] for i in split], self.vocabulary)
        # a piece that is a token is its own entry behind the others
        start, length = len(self.ids) + len(ids) + np.arange(len(words)), np.ones(len(words), np.int32)
        start[split], length[split] = len(self.ids) + offsets[:-1], np.diff(offsets)
        self.ids = np.concatenate((self.ids, ids.astype(np.int32), whole.astype(np.int32)))
        self.start, self.length = np.concatenate((self.start, start)), np.concatenate((self.length, length))
        self.bytes, self.new = self.bytes + sum(map(len, words)) + PIECE * len(words), 0

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids one after another, n+1 offsets) of pieces by their places; all must be merged."""
        size = self.length[at]
        ids = self.ids[np.repeat(self.start[at], size) + texts.ragged(size)] if len(at) else np.zeros(0, np.int32)
        return ids, np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def _long(text: str, pattern, memory: Memory) -> np.ndarray:
    """Token ids of a text of any length."""
    parts, found = [], pattern.finditer(text)
    while some := [match.group() for match in islice(found, BLOCK // 4)]:
        at = memory.places(some)
        memory.merge()
        parts.append(memory.tokens(at)[0])
        if memory.bytes > REMEMBERED:
            memory.forget()
    return np.concatenate(parts)


def encode_blocks(blocks: Iterator[list[str]], pattern, memory: Memory) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(token ids one after another, n+1 offsets) of each block of texts, in order; a text of more than BLOCK must stand alone."""
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def done() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        memory.merge()
        for at, ends in waiting:
            ids, offsets = memory.tokens(at)
            yield ids, offsets[ends]
        waiting.clear()
        if memory.bytes > REMEMBERED:
            memory.forget()

    for block in blocks:
        if len(block) == 1 and len(block[0]) > BLOCK:
            yield from done()
            ids = _long(block[0], pattern, memory)
            yield ids, np.array([0, len(ids)])
            continue
        found = [pattern.findall(text) for text in block]
        ends = np.concatenate(([0], np.cumsum([len(own) for own in found], dtype=np.int64)))
        waiting.append((memory.places(list(chain.from_iterable(found))), ends))
        if memory.new > BLOCK:
            yield from done()
    yield from done()


def encode_block(block: list[str], vocabulary: Vocabulary, pattern) -> tuple[np.ndarray, np.ndarray]:
    """(token ids one after another, n+1 offsets) of texts; a single text may have any length."""
    return next(encode_blocks(iter([block]), pattern, Memory(vocabulary)))


def _blocks(batch: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows with at most BLOCK bytes, or one row."""
    sizes = compute.fill_null(compute.binary_length(batch), 0).to_numpy(zero_copy_only=False)
    at, first = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
    while first < len(sizes):
        end = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield first, end
        first = end


def _encoded(column: pa.Array, vocabulary: Vocabulary, pattern) -> pa.Array:
    return pa.concat_arrays([ids for _, _, ids in _coded(column, pattern, Memory(vocabulary))] or [pa.array([], pa.list_(pa.int32()))])


def _coded(column: pa.Array, pattern, memory: Memory) -> Iterator[tuple[int, int, pa.Array]]:
    """(first, end, token ids) of runs of rows."""
    runs = list(_blocks(column))
    blocks = ([t or "" for t in column.slice(a, b - a).to_pylist()] for a, b in runs)
    for (a, b), (ids, offsets) in zip(runs, encode_blocks(blocks, pattern, memory)):
        yield a, b, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))


def _decoded(ids: pa.Array, vocabulary: Vocabulary) -> pa.Array:
    """The bytes of each row's ids, BLOCK ids at a time."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype.kind != "i":
        raise ValueError("a token id is null")
    lengths = compute.fill_null(compute.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    parts = [vocabulary.decoded(flat[a:a + BLOCK]) for a in range(0, len(flat), BLOCK)]
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    size = vocabulary.sizes[flat] if parts else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(size)))[ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def encoder(vocabulary) -> Callable:
    """Column function: token ids (array<int>) of a text; null and empty texts have none.

    `vocabulary` is a broadcast Vocabulary. Special tokens' strings are ordinary text.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary.value
        pattern, memory = regex.compile(v.pattern), Memory(v)
        for batch in batches:
            parts = [ids for _, _, ids in _coded(batch, pattern, memory)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return encode


def decoder(vocabulary) -> Callable:
    """Column function: bytes of an array of token ids; null has none. An unknown id is an error."""

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield _decoded(batch, vocabulary.value)

    return decode


@texts.trimmed
def _code(batches, vocabulary, text: str) -> Iterator[pa.RecordBatch]:
    """Rows with token ids and decoded bytes, block by block."""
    v = vocabulary.value
    pattern, memory = regex.compile(v.pattern), Memory(v)
    for batch in batches:
        column = batch.schema.get_field_index(text)
        for a, b, ids in _coded(batch.column(column), pattern, memory):
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*rows.columns, ids, _decoded(ids, v)], [*rows.schema.names, "token_ids", "decoded"])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """`docs` with token_ids, and `decoded`, the bytes these ids stand for.

    Equal to the library that publishes the rank file, without special tokens. Columns of these
    names are replaced and stand last. Null and empty texts have no ids and no bytes; rows are kept as they
    are, repeated ones too.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(ranks, pattern))
    rows = docs.drop("token_ids", "decoded")
    schema = StructType([*rows.schema.fields, StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    return rows.mapInArrow(partial(_code, vocabulary=shared, text=text), schema)
