"""Spelling variants of a vocabulary, by a bit-sliced position index.

Words one letter apart agree before and after a short zone. Every word is entered under
(shorter length, zone, letters before it, letters behind it), once as the shorter and once as the longer of two words, so
any two words that differ by one inserted, deleted or replaced letter meet in a cell. Zones are
halves of the word at first; a cell of many words, or with a long zone, is entered anew with its zone halved.

Whole cells are packed into blocks of at most BLOCK words. A block has one bitset over its words for each
position of the zone and letter. For all words of a block at once, recurrences over the
positions carry four bitsets each: words without an error so far (at first those of the same cell),
and words with one replaced, one missing (positions shifted back) or one additional letter (shifted ahead).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cohortwise.llm import texts
from cohortwise.llm.common import cut, stored

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a block and longest zone; cells beyond these are halved.
BLOCK, WIDE = 2048, 64
U64 = np.uint64


def runs(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): each maximal run of letters of each text, A-Z in lower case; null texts have none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RUN), F.lit(0))
    return docs.select(F.col(id_column).alias("id"), F.explode(found).alias("run")).withColumn("run", F.translate("run", UPPER, LOWER))


def vocabulary(words: DataFrame, column: str = "word", min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n): distinct words of at least `min_length` code points that occur at least `min_count` times."""
    known = words.select(F.col(column).alias("word")).where(F.length("word") >= min_length)
    return known.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _cells(words: DataFrame, level: int) -> DataFrame:
    """Rows (word, n, short, zone) with the cell's key and the zone's bounds in the word."""
    parts = 1 << level
    first, end = (F.floor(F.col("short") * z / parts).cast("int") for z in (F.col("zone"), F.col("zone") + 1))
    bounded = words.withColumns({"first": first, "end": end}).where("end > first")
    behind = F.col("short") - F.col("end")
    stop = F.length("word") - behind
    key = F.xxhash64(
        "short", F.lit(level), "zone", F.col("word").substr(F.lit(1), F.col("first")), F.col("word").substr(stop + 1, behind))
    return bounded.select("word", "n", "short", "zone", key.alias("key"), "first", stop.alias("stop"))


def _packed_bits(flags: np.ndarray, width: int) -> np.ndarray:
    """Rows of booleans as rows of `width` 64-bit words."""
    raw = np.packbits(flags, axis=1, bitorder="little")
    out = np.zeros((len(flags), width * 8), np.uint8)
    out[:, :raw.shape[1]] = raw
    return out.view(U64)


def near_in_block(zones: list[str], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), both ways, of zones of one cell that are exactly one insertion, deletion or replacement apart."""
    lengths = np.array([len(z) for z in zones])
    order = np.argsort(-lengths, kind="stable")  # those that still have a letter are the first ones
    lengths, cell = lengths[order], np.unique(cell[order], return_inverse=True)[1]
    n, longest = len(zones), int(lengths[0])
    width = (n + 63) // 64
    raw = np.frombuffer("".join(zones[i] for i in order).encode("utf-32-le"), "<u4")
    letters, code = np.unique(raw, return_inverse=True)
    grid = np.full((n, longest), -1, np.int64)
    grid[np.arange(longest) < lengths[:, None]] = code
    alphabet = np.arange(len(letters))[:, None]
    # index[p + 1]: one bitset per letter for position p; none before the first and behind the last
    nothing = np.zeros((len(letters), width), U64)
    index = [nothing] + [_packed_bits(grid[:, p] == alphabet, width) for p in range(longest)] + [nothing]
    none = _packed_bits(cell == np.arange(cell.max() + 1)[:, None], width)[cell]
    replaced, missing, added = (np.zeros((n, width), U64) for _ in range(3))
    for p in range(longest):
        k = int(np.searchsorted(-lengths, -p, "left"))  # words longer than p
        at = grid[:k, p]
        here, back, ahead = index[p + 1][at], index[p][at], index[p + 2][at]
        replaced[:k] = replaced[:k] & here | none[:k] & ~here
        missing[:k] = missing[:k] & back | none[:k]
        added[:k] = (added[:k] | none[:k]) & ahead
        none[:k] &= here
    of_length = _packed_bits(lengths == np.arange(longest + 3)[:, None] - 1, width)  # row l + 1: words of length l
    near = replaced & of_length[lengths + 1] | missing & of_length[lengths] | (added | none) & of_length[lengths + 2]
    rows = np.flatnonzero(near.any(axis=1))
    i, j = np.nonzero(np.unpackbits(near[rows].view(np.uint8), axis=1, bitorder="little"))
    return order[rows[i]], order[j]


@texts.trimmed
def _search(batches) -> Iterator[pa.RecordBatch]:
    """Near words of rows sorted by cell, block by block."""
    held: list[tuple] = []
    tail: list[tuple] = []

    def found() -> pa.RecordBatch:
        a, b = near_in_block([w[first:stop] for _, w, _, first, stop in held], np.array([h[0] for h in held], np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([held[i][1] for i in a.tolist()], pa.string()), pa.array([held[i][1] for i in b.tolist()], pa.string()),
             pa.array([held[i][2] for i in b.tolist()], pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("key", "word", "n", "first", "stop"))):
            if tail and tail[0][0] != row[0]:
                held += tail
                tail = []
            tail.append(row)
            if held and len(held) + len(tail) > BLOCK:
                yield found()
                held = []
    held += tail
    if held:
        yield found()


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n): for each word of (word, n) all words exactly one insertion, deletion or replacement of a code point away."""
    lengths = F.array(F.length("word"), F.length("word") - 1)
    words = vocab.select("word", "n", F.explode(lengths).alias("short")).where("short > 0")
    words = words.select("word", "n", "short", F.explode(F.array(F.lit(0), F.lit(1))).alias("zone"))
    level, out = 1, None
    while True:
        rows = _cells(words, level)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max(F.col("stop") - F.col("first")).alias("width")).where("size > 1")
        rows = stored(rows.join(sizes, "key"), "cells")
        # a zone of one letter has a bounded cell: an alphabet of words, or of pairs of letters
        whole = (F.col("size") <= BLOCK) & (F.col("width") <= WIDE) | (F.col("width") <= 2)
        ready = rows.where(whole).select("key", "word", "n", "first", "stop").repartition("key").sortWithinPartitions("key")
        found = ready.mapInArrow(_search, "word string, near string, near_n long")
        out = found if out is None else out.unionAll(found)
        large = rows.where(~whole)
        if large.isEmpty():
            return out.distinct()
        words = large.select("word", "n", "short", F.explode(F.array(F.col("zone") * 2, F.col("zone") * 2 + 1)).alias("zone"))
        level += 1


def variants(vocab: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of each row of (word, n); words are distinct and not null.

    n_near is the number of words exactly one inserted, deleted or replaced code point away. form is
    the most frequent of these (of equal ones the least in code-point order), if it is at least `factor` times as
    frequent as the word, else null, and form_n its count. root follows forms from the word to the
    last; a word without a form is its own root. Counts grow along forms, so there are no circles
    and the number of joins follows the logarithm of the longest chain. An empty table gives no rows.
    """
    vocab = stored(vocab.select("word", "n"), "vocabulary")
    best = near_words(vocab).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best = best.select(F.col("word").alias("of"), "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))
    chosen = F.col("near_n") >= factor * F.col("n")
    formed = vocab.join(best, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(chosen, F.col("near")).alias("form"), F.when(chosen, F.col("near_n")).alias("form_n"))
    formed = stored(formed, "forms")
    return formed.join(_last(formed).withColumnRenamed("word", "of"), F.col("word") == F.col("of"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _last(formed: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: each round doubles the distance that has been followed."""
    links = formed.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        further = links.select(F.col("word").alias("of"), F.col("root").alias("beyond"))
        moved = cut(links.join(further, F.col("root") == F.col("of"), "left").select(
            "word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        links = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return links
