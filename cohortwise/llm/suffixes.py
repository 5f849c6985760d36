"""Removal of repeated byte strings with a run-length index of the places that may repeat.

1. Each window of `window` bytes is represented by the least 32-byte gram in it (leftmost of
   equal ones), so equal windows have equal grams at the same distance. The windows of one gram
   are neighbours; together they are its context. Grams that occur once are done. Where all
   contexts of a gram are equal (passages copied whole) every window is a repeat. Only grams
   with several different contexts, at the ends of copied passages, go on, one copy of each
   context.
2. The contexts of a gram meet in one unit. A unit's contexts are concatenated, their suffixes
   sorted and the Burrows-Wheeler transform cut into runs. Longest common prefixes with the
   neighbours in suffix order are computed at the ends of the runs alone; in text order each
   further position's value is one less than the last one's, so one scan streams the matching
   statistics. Positions with a match of `window` bytes or more start a repeat.

A gram with more than UNIT different contexts is spread over all pairs of blocks of its
contexts, so no task ever holds more than two blocks of one gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from cohortwise.llm import packed, texts
from cohortwise.llm.common import text_bytes

U64 = np.uint64
GRAM = 32
UNIT = 4096
#: Bytes of contexts that are indexed at a time.
INDEXED = 1 << 19
POSITION = U64((1 << 31) - 1)
FACTORS = np.random.default_rng(20240301).integers(1, 2**63, GRAM // 8, dtype=np.uint64) * U64(2) + U64(1)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; the last seven positions are left out."""
    return np.lib.stride_tricks.sliding_window_view(data, 8).copy().view("<u8").ravel()


class Anchored:
    """Grams that represent windows, with the first and last window of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        n, zone = len(data), window - GRAM + 1
        self.at = self.low = self.high = self.row = np.zeros(0, np.int64)
        self.hash = np.zeros(0, U64)
        if n < window:
            return
        words, m = eights(data), n - GRAM + 1
        blocks = -(-m // zone)
        key = np.full(blocks * zone, np.iinfo(U64).max, U64)
        here, part = key[:m], np.empty(m, U64)
        np.multiply(words[:m], FACTORS[0], out=here)
        for i in range(1, GRAM // 8):
            np.multiply(words[8 * i:8 * i + m], FACTORS[i], out=part)
            here += part
        here &= ~POSITION
        here |= np.arange(m, dtype=U64)
        grid = key.reshape(blocks, zone)
        ahead = np.minimum.accumulate(grid, axis=1).ravel()
        behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        last = n - window + 1
        least = np.minimum(behind[:last], ahead[zone - 1:zone - 1 + last])
        new = np.concatenate(([True], least[1:] != least[:-1]))
        inside = np.zeros(n + 1, np.int8)
        long = np.diff(offsets) >= window
        begin, stop = offsets[:-1][long], offsets[1:][long] - window + 1
        if not len(begin):
            return
        inside[begin] += 1
        inside[stop] -= 1
        new[begin] = True
        valid = np.cumsum(inside[:last], dtype=np.int8).view(bool)
        heads = np.flatnonzero(new & valid)
        self.at, self.low = (least[heads] & POSITION).astype(np.int64), heads
        self.row = np.searchsorted(offsets, heads, "right") - 1
        bound = offsets[self.row + 1] - window + 1
        self.high = np.minimum(np.append(heads[1:], n), bound) - 1 + window
        at = self.at
        self.hash = texts.pair(texts.pair(words[at], words[at + 8]), texts.pair(words[at + 16], words[at + 24]))

    def contexts(self, data: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        whole = [xxh3_64_intdigest(raw[a:b]) for a, b in zip(self.low.tolist(), self.high.tolist())]
        return texts.pair(np.array(whole, U64), (self.at - self.low).astype(U64))


def _unrepeated(k: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """True for the first of the rows that are equal in id and text."""
    _, first = np.unique(np.stack((k, tie)), axis=1, return_index=True)
    out = np.zeros(len(k), bool)
    out[first] = True
    return out


@texts.trimmed
def _send_grams(batches, text: str, parts: int, window: int) -> Iterator[pa.RecordBatch]:
    gid = packed.numbers()
    for batch in batches:
        k, tie = packed.names(batch)

        def find(first, data, offsets):
            a = Anchored(data, offsets, window)
            return a.row + first, a.at - offsets[a.row], a.hash, a.contexts(data)

        for row, pos, gram, context in texts.groups(batch, text, find):
            if len(k) > 1:
                use = np.flatnonzero(_unrepeated(k, tie)[row])
                row, pos, gram, context = row[use], pos[use], gram[use], context[use]
            _, one, count = np.unique(texts.pair(gram, context), return_index=True, return_counts=True)
            other = np.ones(len(row), bool)
            other[one] = False
            other = np.flatnonzero(other)
            known = row[other], _answer(pos[other], 1, 0, 0)
            dup, mine = (count > 1).astype(np.uint8), context[one]
            yield packed.outgoing(
                parts, next(gid), k, tie, row[one], pos[one], gram[one], lambda pick: mine[pick].tobytes() + dup[pick].tobytes(), known)


def _answer(pos, flag, block, blocks) -> np.ndarray:
    """One row of two numbers each: position and flag; block and number of blocks."""
    out = np.empty((len(pos), 2), "<u8")
    out[:, 0] = pos.astype("<u8") << U64(2) | np.asarray(flag).astype("<u8")
    out[:, 1] = np.asarray(block).astype("<u8") << U64(32) | np.asarray(blocks).astype("<u8")
    return out


def _contexts_of_grams(k, tie, doc, pos, gram, aux):
    """Flag 1: an equal context occurs elsewhere. Flag 2: first of its contexts, and the gram has others."""
    context = np.concatenate([np.frombuffer(x, U64, len(x) // 9) for x in aux])
    dup = np.concatenate([np.frombuffer(x, np.uint8, offset=len(x) // 9 * 8) for x in aux]).astype(bool)
    order = np.lexsort((pos, tie[doc], k[doc], context, gram))
    g, c, d = gram[order], context[order], doc[order]
    new_gram = np.concatenate(([True], g[1:] != g[:-1]))
    new_context = np.concatenate(([True], (c[1:] != c[:-1]))) | new_gram
    place = np.stack((k[d], tie[d], pos[order]))
    fresh = np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0))) | new_context
    of_gram, of_context = np.cumsum(new_gram) - 1, np.cumsum(new_context) - 1
    several = (np.bincount(of_context, weights=fresh.astype(int) + dup[order]) > 1)[of_context]
    kinds = np.bincount(of_gram, weights=new_context).astype(np.int64)[of_gram]
    number = np.cumsum(new_context) - 1
    number -= number[np.flatnonzero(new_gram)][of_gram]
    index = new_context & (kinds > 1)
    flag = several + 2 * index
    hit = np.flatnonzero(flag)
    return order[hit], _answer(pos[order[hit]], flag[hit], number[hit] // UNIT, -(-kinds[hit] // UNIT))


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.stack((low, high), axis=1).astype("<u4")


@texts.trimmed
def _send_contexts(batches, parts: int, window: int) -> Iterator[pa.RecordBatch]:
    gid = packed.numbers()
    for batch in packed.opened(map(packed.with_answers, batches)):
        k, tie = packed.names(batch)
        replies = packed.replies_of(batch)
        raw, starts = texts.column(batch, "__text")

        def find(first, data, offsets):
            a = Anchored(data, offsets, window)
            said = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in replies[first:first + len(offsets) - 1]]
            where = np.repeat(np.arange(len(said)), [len(x) for x in said])
            said = np.concatenate(said)
            which = np.searchsorted(a.at, offsets[where] + (said[:, 0] >> U64(2)).astype(np.int64))
            low = offsets[where]
            return where + first, a.low[which] - low, a.high[which] - low, a.hash[which], said

        for row, low, high, gram, said in texts.groups(batch, "__text", find):
            flag = (said[:, 0] & U64(3)).astype(np.int64)
            whole = np.flatnonzero(flag & 1)
            known = row[whole], _spans(low[whole], high[whole])
            index = np.flatnonzero(flag & 2)
            block, blocks = (said[index, 1] >> U64(32)).astype(np.int64), (said[index, 1] & U64(2**32 - 1)).astype(np.int64)
            copy = np.repeat(np.arange(len(index)), blocks)  # a block meets every block of its gram
            other = texts.ragged(blocks)
            first, second = np.minimum(block[copy], other).astype(U64), np.maximum(block[copy], other).astype(U64)
            which, hot = index[copy], blocks[copy] > 1
            unit = np.where(hot, texts.pair(gram[which], first << U64(32) | second), gram[which])
            order = np.argsort(unit, kind="stable")
            which, unit, hot = which[order], unit[order], hot[order]
            begin, end = (starts[row] + low)[which], (starts[row] + high)[which]

            def strings(pick):
                size = packed.planes((end - begin)[pick])
                return len(pick).to_bytes(4, "little") + size + b"".join(
                    [raw[x:y].tobytes() for x, y in zip(begin[pick].tolist(), end[pick].tolist())])

            yield packed.outgoing(parts, next(gid), k, tie, row[which], low[which], unit, strings, known, own=hot)


def suffix_order(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Suffix array, by prefix doubling; a suffix ends at `stop`, and equal ones are in text order.

    stop[i] is the end of the string that holds position i.
    """
    n = len(data)
    here = np.arange(n)
    key = np.zeros(n, U64)
    for j in range(7):  # nine bits hold a byte or the end
        inside = here + j < stop
        key = key << U64(9) | np.where(inside, data[np.minimum(here + j, n - 1)].astype(U64) + U64(1), U64(0))
    order = np.argsort(key, kind="stable")
    depth, rank = 7, np.empty(n, np.int64)
    sorted_key = key[order]
    new = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
    rank[order] = np.maximum.accumulate(np.where(new, here, 0)) + 1  # rank: one plus the place of the first of its group
    most = int((stop - here).max()) if n else 0
    while depth < most:
        single = new & np.append(new[1:], True)
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        suffix = order[open_]
        after = suffix + depth
        second = np.where(after < stop[suffix], rank[np.minimum(after, n - 1)], 0)
        key = rank[suffix].astype(U64) << U64(32) | second.astype(U64)
        by = np.argsort(key, kind="stable")
        order[open_], sorted_key = suffix[by], key[by]
        changed = np.concatenate(([True], sorted_key[1:] != sorted_key[:-1]))
        new[open_] = changed
        rank[order[open_]] = np.maximum.accumulate(np.where(changed, open_, 0)) + 1
        depth *= 2
    return order


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that agree from positions a and b on, at most `most`; `words` has the eight bytes from each position on."""
    out = np.zeros(len(a), np.int64)
    alive = np.arange(len(a))
    while len(alive):
        differ = words[a[alive] + out[alive]] ^ words[b[alive] + out[alive]]
        bits = differ & (~differ + U64(1))
        equal = np.where(differ == 0, 8, np.frexp(bits.astype(np.float64))[1] - 1 >> 3)
        out[alive] += equal
        alive = alive[(equal == 8) & (out[alive] < most[alive])]
    return np.minimum(out, most)


def matching_statistics(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For each position the longest prefix of its suffix that occurs at another position too."""
    n = len(data)
    order = suffix_order(data, stop)
    first = np.concatenate(([True], stop[1:] != stop[:-1]))
    before = np.where(first[order], -1, data[np.maximum(order - 1, 0)].astype(np.int64))  # the transform; -1: a string's start
    head = np.concatenate(([True], (before[1:] != before[:-1]) | (before[1:] < 0)))  # of a run
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    words = eights(padded)
    place = np.flatnonzero(head)[1:]
    left, right = order[place - 1], order[place]
    shared = common_prefix(words, left, right, np.minimum(stop[left] - left, stop[right] - right))
    out = np.zeros(n, np.int64)
    for at in (right, left):  # samples at run heads, for the neighbour above; at run ends, for the one below
        value = np.full(n, -1, np.int64)
        value[at] = shared
        value[order[0 if at is right else -1]] = 0
        sampled = np.flatnonzero(value >= 0)
        last = sampled[np.searchsorted(sampled, np.arange(n), "right") - 1]
        out = np.maximum(out, value[last] - (np.arange(n) - last))
    return np.maximum(out, 0)


def repeats(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string the starts of windows that also start elsewhere in the strings."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    stop = np.repeat(ends, [len(s) for s in strings])
    long = np.flatnonzero(matching_statistics(data, stop) >= window)
    cuts = np.searchsorted(long, ends)
    return [long[a:b] - (e - len(s)) for a, b, e, s in zip([0, *cuts[:-1]], cuts, ends, strings)]


def _match_contexts(table: pa.Table, window: int) -> pa.Table:
    def decide(k, tie, doc, pos, unit, aux):
        strings: list[bytes] = []
        for raw in aux:
            strings += _unpack(raw)
        order = np.lexsort((pos, tie[doc], k[doc], unit))
        place = np.stack((unit[order].view(np.int64), k[doc[order]], tie[doc[order]], pos[order]))
        order = order[np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(axis=0)))]
        sizes = np.array([len(strings[i]) for i in order])
        new = np.concatenate(([True], unit[order][1:] != unit[order][:-1]))
        group, total = np.cumsum(new) - 1, np.cumsum(sizes)
        heads = np.flatnonzero(new)
        turn = (total[heads] - sizes[heads]) // INDEXED  # whole units, about INDEXED bytes at a time
        picked, spans = [], []
        for t in np.unique(turn):
            mine = np.flatnonzero(turn[group] == t)
            for i, starts in zip(order[mine], repeats([strings[i] for i in order[mine]], window)):
                if len(starts):
                    cut = np.flatnonzero(np.diff(starts) > 1)
                    low, high = starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)] + window
                    picked.append(np.full(len(low), i))
                    spans.append(_spans(low + pos[i], high + pos[i]))
        if not picked:
            return np.zeros(0, np.int64), np.zeros((0, 2), "<u4")
        return np.concatenate(picked), np.concatenate(spans)

    return packed.answered(table, decide)


def _unpack(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    lengths = packed.unplanes(raw[4:4 + 4 * n]).tolist()
    out, at = [], 4 + 4 * n
    for length in lengths:
        out.append(raw[at:at + length])
        at += length
    return out


def _widened(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of UTF-8 bytes widened to whole characters; runs that meet are one."""
    low, high = low.copy(), high.copy()
    inside = np.append(raw & 0xC0 == 0x80, False)  # bytes that go on a character
    for _ in range(3):
        low -= inside[low]
        high += inside[high]
    new = np.append(True, low[1:] > high[:-1])
    return low[new], high[np.append(np.flatnonzero(new)[1:], len(low)) - 1]


@texts.trimmed
def _cut(batches, text: str, schema: pa.Schema, characters: bool = False) -> Iterator[pa.RecordBatch]:
    for batch in packed.opened(batches):
        n_bytes, n_removed, kept, spans = [], [], [], []
        raw, offsets = texts.column(batch, "__text")
        for a, b, reply in zip(offsets[:-1].tolist(), offsets[1:].tolist(), packed.replies_of(batch)):
            own, runs = raw[a:b].tobytes(), []
            if reply:
                s = np.frombuffer(reply, "<u4").reshape(-1, 2).astype(np.int64)
                s = s[np.argsort(s[:, 0], kind="stable")]
                reach = np.maximum.accumulate(s[:, 1])
                new = np.concatenate(([True], s[1:, 0] > reach[:-1]))
                low, high = s[new, 0], reach[np.append(np.flatnonzero(new)[1:], len(s)) - 1]
                if characters:
                    low, high = _widened(raw[a:b], low, high)
                runs = np.stack((low, high), axis=1).ravel().tolist()
                edges = [0, *runs, len(own)]
                own = b"".join([own[x:y] for x, y in zip(edges[::2], edges[1::2])])
            n_bytes.append(b - a)
            n_removed.append(b - a - len(own))
            kept.append(own)
            spans.append(runs)
        made = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_bytes": pa.array(kept, pa.binary()), "removed_at": pa.array(spans, pa.list_(pa.int32()))}
        yield packed.result(batch, text, made, schema)


def remove_repeated_bytes(
    docs: DataFrame, window: int = 200, id_column: str = "doc_id", text: str = "text", characters: bool = False,
) -> DataFrame:
    """`docs` without each byte that lies in a string of `window` bytes which also starts elsewhere.

    Texts are UTF-8 bytes; elsewhere is any other document or another start in the same one;
    every copy goes. Strings are judged on the input and do not cross documents. Adds n_bytes,
    n_removed, kept_bytes and removed_at (first, end, first, end, .. of the maximal removed
    runs, in bytes); columns of these names are replaced. Null and empty texts have no bytes.
    Texts are compared whatever their ids: null ids and different texts under one id are
    documents like any other; rows equal in id and text are one document listed repeatedly, do
    not count as copies of each other, and all get its result. Texts shorter than `window` stay
    whole. With `characters`, removed runs are widened to whole characters, so that the kept bytes are UTF-8.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string as ddl

    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM} bytes")
    parts = packed.parts_for(text_bytes(docs, text))
    keyed = packed.identified(docs, id_column, text)
    whole = packed.squeezed(keyed, text)
    sent = keyed.mapInArrow(partial(_send_grams, text=text, parts=parts, window=window), packed.ROWS)
    flags = packed.exchanged(sent, lambda t: packed.answered(t, _contexts_of_grams))
    sent = packed.with_replies(whole, flags).mapInArrow(partial(_send_contexts, parts=parts, window=window), packed.ROWS)
    found = packed.exchanged(sent, lambda t: _match_contexts(t, window))
    out = packed.result_schema(docs, "n_bytes long, n_removed long, kept_bytes binary, removed_at array<int>")
    schema = to_arrow_schema(ddl(out))
    return packed.with_replies(whole, found).mapInArrow(partial(_cut, text=text, characters=characters, schema=schema), out)
