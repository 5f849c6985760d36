"""Removal of repeated word windows, found by locally consistent recompression.

Words are renamed in rounds: a run of two equal words becomes one symbol, then a symbol of the
left half of the alphabet and a following one of the right half become one symbol. Names and halves are hashes of what a symbol stands for, so every task of every
round gives the same name to the same words without a dictionary, and two copies of a
passage are cut into the same symbols except near their ends:

    round           longest symbol   words lost at each end of a common passage
    run of two      2                2
    pair            2                1

(A further pair round would lose more of 20 words at the ends than it saves in symbols; CAPS
has the longest symbol of each pair round.) A window of 20 words therefore keeps, in every copy, the
symbols that start at its words 3 to 16. Of those starting at words 3 to 10 the least name is
the window's anchor; the anchor's name covers the symbols that start within seven words. Anchors with one occurrence rule their
windows out. Only windows under a shared anchor are hashed whole (64 bits over 20 words) and
sent to find their earliest copy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortwise.llm import packed, texts
from cohortwise.llm.common import text_bytes

U64 = np.uint64
RUN = 2
CAPS = (2,)
#: Words lost at each end: a whole short run, then the longest symbol that a round can still merge.
LOST = RUN + sum(cap - 1 for cap in CAPS)
NONE = U64(2**64 - 1)


def symbols(name: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name, first word) of the symbols after all rounds; no symbol crosses a row."""
    n = len(name)
    if not n:
        return name, np.zeros(0, np.int64)
    name, start, length = name.copy(), np.arange(n), np.ones(n, np.int64)
    begins = np.concatenate(([True], (name[1:] != name[:-1]) | (row[1:] != row[:-1])))
    heads = np.flatnonzero(begins)
    runs = np.diff(np.append(heads, n))
    two = heads[runs == RUN]
    name[two] = texts.pair(name[two], np.full(len(two), RUN, U64))
    length[two] = RUN
    keep = np.ones(n, bool)
    keep[two + 1] = False
    name, start, length = name[keep], start[keep], length[keep]
    for turn, cap in enumerate(CAPS, 1):
        right = (texts.mix(name + U64(turn * 0x9E3779B97F4A7C15 % (1 << 64))) >> U64(63)).astype(bool)
        at = row[start]
        merge = np.flatnonzero(~right[:-1] & right[1:] & (at[:-1] == at[1:]) & (length[:-1] + length[1:] <= cap))
        name[merge] = texts.pair(name[merge], name[merge + 1])
        length[merge] += length[merge + 1]
        keep = np.ones(len(name), bool)
        keep[merge + 1] = False
        name, start, length = name[keep], start[keep], length[keep]
    return name, start


class Parsed:
    """Words, windows and anchors of a few texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int):
        start, end, self.row = texts.words(data, offsets)
        self.word = texts.window_hash(texts.prefix_sums(data), start, end)
        n = len(self.word)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))  # first word of each row, and the end
        last = n - window + 1
        self.window = window
        self.at = self.anchor = self.used = np.zeros(0, np.int64)
        self.used_hash = np.zeros(0, U64)
        if last <= 0:
            return
        self.at = np.flatnonzero(self.row[:last] == self.row[window - 1:])  # starts of windows
        name, begin = symbols(self.word, self.row)
        low, zone = LOST, 2 * window // 5
        span = window - 2 * LOST - zone + 1
        order = np.full(n + span, NONE, U64)
        order[begin] = texts.mix(name) >> U64(1)
        best, anchor = order[low:low + last].copy(), np.arange(low, low + last)
        for k in range(low + 1, low + zone):
            value = order[k:k + last]
            better = np.flatnonzero(value < best)
            best[better] = value[better]
            anchor[better] = better + k
        self.anchor = anchor[self.at]
        mark = np.zeros(n + span, bool)
        mark[self.anchor] = True
        self.used = np.flatnonzero(mark)
        spread = np.zeros(n + span + 1, U64)
        spread[begin + 1] = name
        spread *= texts.powers(n + span + 1)
        total = np.cumsum(spread)
        back = texts.powers(n + span + 1, texts.INVERSE)
        self.used_hash = texts.mix((total[self.used + span] - total[self.used]) * back[self.used])

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        n = len(self.word)
        total = np.concatenate((np.zeros(1, U64), np.cumsum(self.word * texts.powers(n))))
        return texts.mix((total[at + self.window] - total[at]) * texts.powers(n + 1, texts.INVERSE)[at])


@texts.trimmed
def _send_anchors(batches, text: str, parts: int, window: int) -> Iterator[pa.RecordBatch]:
    gid = packed.numbers()
    for batch in batches:
        k, tie = packed.names(batch)

        def find(first, data, offsets):
            p = Parsed(data, offsets, window)
            row = p.row[p.used]
            return row + first, p.used - p.first[row], p.used_hash

        for row, pos, anchor in texts.groups(batch, text, find):
            _, one, back, count = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(count[back] > 1)
            known = row[shared], pos[shared].astype("<u4")
            many = (count > 1).astype(np.uint8)
            yield packed.outgoing(parts, next(gid), k, tie, row[one], pos[one], anchor[one], lambda pick: many[pick].tobytes(), known)


def _shared(k, tie, doc, pos, hashes, aux):
    """Facts whose hash has another occurrence; one document listed twice is no other occurrence."""
    known = np.concatenate([np.frombuffer(x, np.uint8) for x in aux])
    order = np.lexsort((pos, tie[doc], k[doc], hashes))
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    group = np.cumsum(new) - 1
    different = np.concatenate(([False], ~new[1:] & (
        (k[doc][order][1:] != k[doc][order][:-1]) | (tie[doc][order][1:] != tie[doc][order][:-1]) | (pos[order][1:] != pos[order][:-1]))))
    several = np.bincount(group, weights=different + known[order]) > 0
    picked = order[several[group]]
    return picked, pos[picked].astype("<u4")


@texts.trimmed
def _send_windows(batches, parts: int, window: int) -> Iterator[pa.RecordBatch]:
    gid = packed.numbers()
    for batch in packed.opened(map(packed.with_answers, batches)):
        k, tie = packed.names(batch)
        flags = packed.replies_of(batch)

        def find(first, data, offsets):
            p = Parsed(data, offsets, window)
            shared = np.zeros(len(p.word) + window, bool)
            for r, raw in enumerate(flags[first:first + len(offsets) - 1]):
                shared[p.first[r] + np.frombuffer(raw, "<u4").astype(np.int64)] = True
            at = p.at[shared[p.anchor]]
            row = p.row[at]
            return row + first, at - p.first[row], p.window_hashes(at)

        for row, pos, hashes in texts.groups(batch, "__text", find):
            order = np.lexsort((pos, tie[row], k[row], hashes))
            h = hashes[order]
            new = np.concatenate(([True], h[1:] != h[:-1]))
            head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]  # the earliest with the same words
            later = (k[row[order]] != k[row[head]]) | (tie[row[order]] != tie[row[head]]) | (pos[order] != pos[head])
            hit = np.sort(order[later])
            known = row[hit], pos[hit].astype("<u4")
            one = np.sort(order[new])
            yield packed.outgoing(parts, next(gid), k, tie, row[one], pos[one], hashes[one], lambda pick: b"", known)


def _later(k, tie, doc, pos, hashes, aux):
    """Facts for which the same hash starts earlier."""
    order = np.lexsort((pos, tie[doc], k[doc], hashes))
    h = hashes[order]
    new = np.concatenate(([True], h[1:] != h[:-1]))
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = (k[doc[order]] != k[doc[head]]) | (tie[doc[order]] != tie[doc[head]]) | (pos[order] != pos[head])
    picked = order[later]
    return picked, pos[picked].astype("<u4")


@texts.trimmed
def _cut(batches, text: str, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in packed.opened(batches):
        n_words, n_removed, kept, spans = [], [], [], []
        raw, offsets = texts.column(batch, "__text")
        for a, b, reply in zip(offsets[:-1].tolist(), offsets[1:].tolist(), packed.replies_of(batch)):
            words = raw[a:b].tobytes().split()  # at the same six bytes as texts.SPACE
            n, own = len(words), []
            if reply:
                gone = np.zeros(n + 1, np.int64)
                at = np.unique(np.frombuffer(reply, "<u4").astype(np.int64))
                gone[at] += 1
                gone[at + window] -= 1
                own = np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(gone[:-1]) > 0, [0])))).tolist()
                edges = [0, *own, n]
                words = [w for x, y in zip(edges[::2], edges[1::2]) for w in words[x:y]]
            n_words.append(n)
            n_removed.append(n - len(words))
            kept.append(b" ".join(words).decode())
            spans.append(own)
        made = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.string()), "removed_at": pa.array(spans, pa.list_(pa.int32()))}
        yield packed.result(batch, text, made, schema)



def remove_repeated_windows(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without each word that a window covers whose words also start earlier.

    A window is `window` consecutive words (runs of bytes other than white space) of one text.
    Earlier means a smaller id, or, in the same document, an earlier start. Windows are judged
    on the input. Adds n_words, n_removed, kept_text (kept words joined by one space) and
    removed_at (first, end, first, end, .. of the removed runs, in words); columns of these
    names are replaced. Null and empty texts have no words. A null id comes after all others;
    texts with the same id are ordered by a hash of the text; rows equal in id and text are one
    document and all get its result. Texts shorter than a window stay whole.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string as ddl

    if window < 2 * LOST + 2 * max(CAPS):
        raise ValueError(f"window must be at least {2 * LOST + 2 * max(CAPS)} words")
    parts = packed.parts_for(text_bytes(docs, text))
    keyed = packed.identified(docs, id_column, text)
    whole = packed.squeezed(keyed, text)
    sent = keyed.mapInArrow(partial(_send_anchors, text=text, parts=parts, window=window), packed.ROWS)
    flags = packed.exchanged(sent, lambda t: packed.answered(t, _shared))
    sent = packed.with_replies(whole, flags).mapInArrow(partial(_send_windows, parts=parts, window=window), packed.ROWS)
    found = packed.exchanged(sent, lambda t: packed.answered(t, _later))
    out = packed.result_schema(docs, "n_words long, n_removed long, kept_text string, removed_at array<int>")
    schema = to_arrow_schema(ddl(out))
    return packed.with_replies(whole, found).mapInArrow(partial(_cut, text=text, window=window, schema=schema), out)
