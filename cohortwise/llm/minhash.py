"""Near-duplicate documents: minima of universal hashes, bands, verification, connected components.

1. A document's set of word shingles gives HASHES minima of (a x + b) mod 2**64. Documents with
   equal sets are one node. Bands of ROWS minima are hashed; nodes that share a band are
   candidates. At a similarity of 0.8 a pair misses all bands with a probability of 5e-8.
2. Each node is compared with the least node it shares a bucket with: first by the share of equal
   minima, then, exactly, by the full sets. The confirmed links are united.
3. Buckets that still hold several components compare the nodes outside the largest one with all
   others, block by block, in the same two steps; what a block unites it does not compare again. The largest component is
   not compared with itself. After that no two candidates in different components are
   unverified, so no link that bands reveal is lost.

Sets travel as compressed texts of the candidates alone. Pairs are grouped by their least node, at most
SALT at a time, and streamed; buckets are cut into blocks of BLOCK nodes. So neither a node with very
many copies nor a very common band is a large group, and no list of all pairs is ever made. A node of the
largest component is sent once for each block of the others, so a group of copies costs what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType
from zstandard import ZstdDecompressor

from cohortwise.llm import packed, texts
from cohortwise.llm.common import stored
from cohortwise.llm.components import components

U64 = np.uint64
ROWS, BANDS = 4, 32
HASHES = ROWS * BANDS
#: Pairs whose minima agree less than this much below the threshold are not checked further: five standard deviations.
DOUBT = 0.18
SALT = 256
BLOCK = 1024

_rng = np.random.default_rng(20240305)
A = _rng.integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)
B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * U64(2)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each row the distinct hashes of its runs of `words` words; with fewer words, of all it has; without words none."""
    data = texts.LOWER[data]
    start, end, row = texts.words(data, offsets)
    word = texts.window_hash(texts.prefix_sums(data), start, end)
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    joined = word
    for k in range(1, words):
        joined = texts.pair(joined[:len(word) - k], word[k:]) if len(word) > k else joined[:0]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            yield np.unique(joined[a:b - words + 1])
        elif b > a:
            whole = word[a:a + 1]
            for k in range(a + 1, b):
                whole = texts.pair(whole, word[k:k + 1])
            yield texts.mix(whole + U64(b - a))
        else:
            yield word[:0]


def minima(found: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, np.iinfo(U64).max, U64)
    for a in range(0, len(found), 1024):
        part = np.multiply.outer(A, found[a:a + 1024])
        part += B[:, None]
        np.minimum(out, part.min(axis=1), out=out)
    return out


def node_of(found: np.ndarray) -> int:
    """64-bit name of a set, as a signed number."""
    return int(texts.pair(np.array([found.sum(dtype=U64)]), np.array([np.bitwise_xor.reduce(texts.mix(found)) + U64(len(found))]))[0].view(np.int64))


@texts.trimmed
def _sign(batches, words: int) -> Iterator[pa.RecordBatch]:
    shift = np.arange(BANDS, dtype=U64)
    for batch in batches:
        ids, ties = (batch.column(batch.schema.get_field_index(x)) for x in ("__id", "__tie"))
        size, node, least, bands = [], [], [], []
        for first, _, data, offsets in texts.pieces(batch, "__text"):
            for found in shingles(data, offsets, words):
                size.append(len(found))
                if not len(found):
                    node.append(None)
                    least.append(None)
                    bands.append(None)
                    continue
                m = minima(found)
                node.append(node_of(found))
                least.append((m >> U64(48)).astype("<u2").tobytes())
                grid = m.reshape(BANDS, ROWS)
                h = texts.mix(shift + U64(1))
                for r in range(ROWS):
                    h = texts.pair(h, grid[:, r])
                bands.append(h.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [ids, ties, pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(least, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["__id", "__tie", "n_shingles", "node", "minima", "bands"])


@F.arrow_udf(DoubleType())
def agreement(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Share of equal minima."""
    for left, right in batches:
        a, b = (np.frombuffer(b"".join(x.to_pylist()), "<u2").reshape(-1, HASHES) for x in (left, right))
        yield pa.array((a == b).mean(axis=1))


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * common >= percent * (len(one) + len(other) - common)


@texts.trimmed
def _verify(batches, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Confirmed pairs of rows sorted by group, the least node first."""
    group, base, name = None, np.zeros(0, U64), 0
    for batch in packed.opened(batches):
        keys = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("a", "salt", "role", "node")]
        left, right = [], []
        for first, _, data, offsets in texts.pieces(batch, "__text"):
            for i, found in enumerate(shingles(data, offsets, words), first):
                a, salt, role, node = (k[i] for k in keys)
                if role == 0:
                    group, base, name = (a, salt), found, node
                elif group == (a, salt) and similar(base, found, percent):
                    left.append(name)
                    right.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


@texts.trimmed
def _across(batches, words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between different components, from rows sorted by bucket and pair of blocks."""
    expand = ZstdDecompressor().decompress
    held: list[dict] = []
    unit = None

    def links():
        node, part, block = (np.array([r[x] for r in held], np.int64) for x in ("node", "component", "block"))
        grid = np.frombuffer(b"".join([r["minima"] for r in held]), "<u2").reshape(-1, HASHES)
        sets: dict[int, np.ndarray] = {}

        def set_of(i):
            if i not in sets:
                raw = expand(held[i]["__z"])
                sets[i] = next(shingles(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), words))
            return sets[i]

        left, right = [], []
        other = np.flatnonzero(block == unit[2])
        for i in np.flatnonzero(block == unit[1]):
            near = other[(part[other] != part[i]) & ((other > i) | (unit[1] != unit[2]))]
            near = near[(grid[near] == grid[i]).mean(axis=1) >= percent / 100 - DOUBT]
            for j in near.tolist():
                if part[j] != part[i] and similar(set_of(i), set_of(j), percent):
                    left.append(int(node[i]))
                    right.append(int(node[j]))
                    part[part == part[j]] = part[i]
        low, high = np.minimum(left, right), np.maximum(left, right)
        return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["a", "b"])

    for batch in batches:
        for row in batch.to_pylist():
            if (row["bucket"], row["i"], row["j"]) != unit:
                if held:
                    yield links()
                unit = (row["bucket"], row["i"], row["j"])
                held = []
            held.append(row)
    if held:
        yield links()


def confirmed(pairs: DataFrame, candidates: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of `pairs` (a < b) whose full sets are similar."""
    minima_of = candidates.select("node", "minima")
    both = pairs.join(minima_of.toDF("a", "minima_a"), "a").join(minima_of.toDF("b", "minima_b"), "b")
    likely = stored(both.where(agreement("minima_a", "minima_b") >= percent / 100 - DOUBT).select("a", "b"), "pairs")
    salts = likely.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    second = likely.join(salts, "a").select("a", F.pmod("b", "salts").cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("node"))
    first = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("node"))
    rows = first.union(second).join(candidates.select("node", "__z"), "node").select("a", "salt", "role", "node", "__z")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return rows.mapInArrow(partial(_verify, words=words, percent=percent), "a long, b long")


def _mixed(members: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, component); of buckets with several components the largest one, its blocks and those of the rest."""
    labelled = members.join(whole.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    labelled = stored(labelled.select("bucket", "node", F.coalesce("component", "node").alias("component")), "labelled")
    parts = labelled.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = F.max(F.struct("size", "component"))
    mixed = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), largest.alias("top")).where("parts > 1")
    mixed = mixed.select(
        "bucket", F.col("top.component").alias("largest"),
        F.ceil(F.col("top.size") / BLOCK).cast("int").alias("its_blocks"), F.ceil((F.col("all") - F.col("top.size")) / BLOCK).cast("int").alias("blocks"))
    return labelled, mixed


def _blocks(labelled: DataFrame, mixed: DataFrame) -> DataFrame:
    """(bucket, i, j, block, node, component): each node once for every pair of blocks in which it is compared.

    A bucket's first blocks hold the nodes outside its largest component; they are compared with one another and
    with the blocks behind them, those of the largest component.
    """
    inside = labelled.join(mixed, "bucket").withColumn("of_largest", F.col("component") == F.col("largest"))
    place = F.xxhash64("node")
    inside = inside.withColumn("block", F.when(F.col("of_largest"), F.col("blocks") + F.pmod(place, "its_blocks")).otherwise(F.pmod(place, "blocks")).cast("int"))
    others = F.when(F.col("of_largest"), F.col("blocks")).otherwise(F.col("blocks") + F.col("its_blocks"))
    inside = inside.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return inside.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component")


def _united(docs: DataFrame, words: int, percent: int, id_column: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of `docs` with __id and __tie, which rows equal in id and text share; their nodes, null without shingles; linked nodes with their components)."""
    last = (1 << 63) - 1
    rows = docs.withColumns({
        "__id": F.coalesce(F.col(id_column).cast("long"), F.lit(last)), "__tie": F.xxhash64(F.col(text)), "__text": F.col(text)})
    small = rows.select("__id", "__tie", "__text")
    signed = small.mapInArrow(partial(_sign, words=words), "__id long, __tie long, n_shingles long, node long, minima binary, bands array<long>")
    signed = stored(signed, "minhash")
    nodes = signed.where("node is not null")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    least = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b")
    members = stored(banded.join(least.select("bucket", "a"), "bucket").distinct(), "buckets")
    # compressed text and minima of each candidate
    source = nodes.join(members.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("__id", "__tie")).alias("of"), F.any_value("minima").alias("minima"))
    source = source.select("node", "minima", F.col("of.__id").alias("__of"), F.col("of.__tie").alias("__with"))
    candidates = packed.squeezed(small, "__text").join(source, (F.col("__id") == F.col("__of")) & (F.col("__tie") == F.col("__with")))
    candidates = stored(candidates.groupBy("node").agg(F.any_value("__z").alias("__z"), F.any_value("minima").alias("minima")), "candidates")
    pairs = members.where("node > a").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).select("a", "b")
    links = stored(confirmed(pairs, candidates, words, percent), "links")
    whole = components(links)
    labelled, mixed = _mixed(members.select("bucket", "node"), whole)
    more = stored(_blocks(labelled, mixed).join(candidates, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(
        partial(_across, words=words, percent=percent), "a long, b long").distinct(), "across")
    if not more.isEmpty():
        whole = components(links.unionAll(more))
    return rows, signed, whole


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group that near_duplicates links: of the least id, then of the least hash of the text.

    Null ids come after all others; a group whose ids are all null keeps one row as well. Rows equal
    in id and text are one document, of which the row with the least other columns stays, so
    these must have an order. Texts without words link with nothing: each is kept, equal rows once.
    """
    rows, signed, whole = _united(docs, words, percent, id_column, text)
    group = signed.where("node is not null").join(whole.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    firsts = group.groupBy(F.coalesce("component", "node")).agg(F.min(F.struct("__id", "__tie")).alias("first"))
    chosen = firsts.select("first.*").union(signed.where("node is null").select("__id", "__tie")).toDF("__of", "__with")
    kept = rows.drop("__text").join(chosen, (F.col("__id") == F.col("__of")) & (F.col("__tie") == F.col("__with")), "left_semi")
    return kept.groupBy("__id", "__tie").agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with n_shingles, component_id and kept.

    A document's set holds its distinct runs of `words` words (A-Z in lower case, cut at white
    space); with fewer words the whole sequence. Two documents are linked if 100 times the size
    of the intersection is at least `percent` times that of the union, on full sets. Equal sets
    always are. component_id is the least id reachable, kept whether it is the row's own.
    Columns of these names are replaced.

    Null and empty texts and texts of white space have an empty set and link with nothing. A null
    id is greater than all others; its component, if no other id is in it, is null. Rows with one
    id are one document each: repeated rows all have the same result, and are all kept if their
    id is.
    """
    rows, signed, whole = _united(docs, words, percent, id_column, text)
    last = (1 << 63) - 1
    nodes = signed.where("node is not null")
    group = nodes.select("node", "__id").join(whole.withColumnRenamed("node", "__n"), F.col("node") == F.col("__n"), "left")
    group = group.select("__id", "node", F.coalesce("component", "node").alias("component"))
    lowest = group.groupBy("component").agg(F.min("__id").alias("__first"))
    ids = group.select("node", "component").distinct().join(lowest, "component").select("node", "__first")
    found = signed.select(F.col("__id").alias("__of"), F.col("__tie").alias("__with"), F.col("n_shingles").alias("__n"), "node").distinct()
    found = found.join(ids, "node", "left").select("__of", "__with", "__n", F.coalesce("__first", "__of").alias("__component"))
    names = [c for c in docs.columns if c not in ("n_shingles", "component_id", "kept")]
    out = rows.drop("__text").join(found, (F.col("__id") == F.col("__of")) & (F.col("__tie") == F.col("__with")))
    return out.select(
        *names, F.col("__n").alias("n_shingles"), F.when(F.col("__component") != last, F.col("__component")).alias("component_id"),
        (F.col("__component") == F.col("__id")).alias("kept"))
