"""Exchange of many small facts about positions in texts: packed by part on the way out, by document on the way back.

A task sends, for each part of the hash space, one row with binary columns instead of a row
for each position, and only the first of equal facts it has itself, so a hash that occurs in
a third of all texts reaches its part once per piece of text. Parts are groups of
`applyInArrow`; their number follows the bytes of all texts (`parts_for`), so one part holds
the facts of about PART_BYTES of text whatever the input. Answers go back to the group of texts they came from, are unpacked there to
rows of (__k, __tie, at), and join the documents by their ids.

A document is (__k, __tie): its id (null: after all others) and a 64-bit hash of its text. Rows that
are equal in both are one document; all of them get its result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType
from zstandard import ZstdCompressor, ZstdDecompressor

from cohortwise.llm.texts import release

PART_BYTES = 8 << 20
#: Rows whose texts a task has open at a time.
OPENED = 1000
LAST = (1 << 63) - 1

ROWS = "part int, gid long, docs binary, row binary, at binary, pos binary, hash binary, aux binary"
ROWS_ARROW = pa.schema([("part", pa.int32()), ("gid", pa.int64()), *((name, pa.binary()) for name in ("docs", "row", "at", "pos", "hash", "aux"))])
ANSWERS = "gid long, docs binary, row binary, at binary"
ANSWERS_ARROW = pa.schema([("gid", pa.int64()), ("docs", pa.binary()), ("row", pa.binary()), ("at", pa.binary())])
REPLIES = "__k long, __tie long, at binary"
REPLIES_ARROW = pa.schema([("__k", pa.int64()), ("__tie", pa.int64()), ("at", pa.binary())])


def parts_for(size: int) -> int:
    return max(1, -(-size // PART_BYTES))


def keyed(docs: DataFrame, id_column: str) -> DataFrame:
    return docs.withColumn("__k", F.coalesce(F.col(id_column).cast("long"), F.lit(LAST)))


def identified(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """`docs` with __k and __tie."""
    return keyed(docs, id_column).withColumn("__tie", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


@F.arrow_udf(BinaryType())
def squeeze(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Texts compressed one by one: a shuffle's own codec hardly shortens prose."""
    compress = ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.array([None if x is None else compress(x.encode()) for x in batch.to_pylist()], pa.binary())


def squeezed(docs: DataFrame, text: str) -> DataFrame:
    """`docs` with the compressed text in __z in place of the text."""
    return docs.withColumn("__z", squeeze(F.col(text))).drop(text)


def opened(batches) -> Iterator[pa.RecordBatch]:
    """The batches, a few rows at a time, with the text, in __z's place, as __text."""
    expand = ZstdDecompressor().decompress
    for whole in batches:
        at = whole.schema.get_field_index("__z")
        for first in range(0, whole.num_rows, OPENED):
            batch = whole.slice(first, OPENED)
            texts = pa.array([None if x is None else expand(x) for x in batch.column(at).to_pylist()], pa.large_binary())
            yield batch.set_column(at, "__text", texts)


def names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("__k", "__tie"))


def with_answers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows that have answers."""
    return batch.filter(batch.column(batch.schema.get_field_index("__ties")).is_valid())


def planes(values: np.ndarray) -> bytes:
    """uint32 values byte by byte of their significance; the zeros compress away."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def numbers() -> Iterator[int]:
    """Numbers for the groups of texts of this task; the same when the task is run again."""
    task = TaskContext.get()
    return count((task.partitionId() if task else 0) << 32)


def named(k: np.ndarray, tie: np.ndarray, row: np.ndarray) -> tuple[bytes, bytes]:
    """(documents, their number for each of `row`)."""
    rows, ordinal = np.unique(row, return_inverse=True)
    return np.stack((k[rows], tie[rows])).tobytes(), planes(ordinal)


def outgoing(
    parts: int, gid: int, k: np.ndarray, tie: np.ndarray, row: np.ndarray, pos: np.ndarray, hashes: np.ndarray,
    aux_of: Callable[[np.ndarray], bytes], known: tuple[np.ndarray, np.ndarray], own: np.ndarray | None = None,
) -> pa.RecordBatch:
    """One row per part that has facts, and one with the answers (rows, values) this group knows itself.

    Facts marked `own` go to a part of their hash alone, beyond the common ones.
    """
    part = (hashes % np.uint64(parts)).astype(np.int64)
    if own is not None:
        part = np.where(own, parts + (hashes >> np.uint64(34)).astype(np.int64), part)
    order = np.argsort(part, kind="stable")
    heads = np.flatnonzero(np.concatenate(([True], np.diff(part[order]) > 0))) if len(part) else []
    out: dict[str, list] = {name: [] for name in ROWS_ARROW.names}

    def add(**values):
        for name in out:
            out[name].append(values.get(name))

    for a, b in zip(heads, [*heads[1:], len(part)]):
        pick = order[a:b]
        docs, ordinal = named(k, tie, row[pick])
        add(part=int(part[pick[0]]), gid=gid, docs=docs, row=ordinal, pos=planes(pos[pick]),
            hash=np.ascontiguousarray(hashes[pick]).tobytes(), aux=aux_of(pick))
    if len(known[0]):
        docs, ordinal = named(k, tie, known[0])
        add(part=gid % parts, gid=gid, docs=docs, row=ordinal, at=np.ascontiguousarray(known[1]).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in ROWS_ARROW], schema=ROWS_ARROW)


def answered(table: pa.Table, decide: Callable) -> pa.Table:
    """Answers of one part: those that came along, and those `decide` finds, by the group they go to.

    `decide(k, tie, doc, pos, hashes, aux)` gets one entry per fact (`doc` numbers the entries
    of k and tie) and returns (indexes of facts to answer, numpy array with a value for each).
    """
    mine = table.column("hash").is_valid()
    rest = table.filter(compute.invert(mine)).select(ANSWERS_ARROW.names).cast(ANSWERS_ARROW)
    blobs = table.filter(mine)
    if not blobs.num_rows:
        return rest
    get = {name: blobs.column(name).to_pylist() for name in ("gid", "docs", "row", "pos", "hash", "aux")}
    docs = [np.frombuffer(x, np.int64).reshape(2, -1) for x in get["docs"]]
    base = np.cumsum([0, *(x.shape[1] for x in docs)])
    k, tie = np.concatenate(docs, axis=1)
    doc = np.concatenate([unplanes(x).astype(np.int64) + b for x, b in zip(get["row"], base)])
    pos = np.concatenate([unplanes(x) for x in get["pos"]]).astype(np.int64)
    hashes = np.concatenate([np.frombuffer(x, np.uint64) for x in get["hash"]])
    picked, values = decide(k, tie, doc, pos, hashes, get["aux"])
    order = np.argsort(doc[picked], kind="stable")
    to, values = doc[picked][order], values[order]
    made: dict[str, list] = {name: [] for name in ANSWERS_ARROW.names}
    cuts = np.searchsorted(to, base)
    for gid, a, b in zip(get["gid"], cuts[:-1], cuts[1:]):
        if b > a:
            names_, ordinal = named(k, tie, to[a:b])
            for name, value in zip(made, (gid, names_, ordinal, np.ascontiguousarray(values[a:b]).tobytes())):
                made[name].append(value)
    return pa.concat_tables([rest, pa.Table.from_arrays([pa.array(made[f.name], f.type) for f in ANSWERS_ARROW], schema=ANSWERS_ARROW)])


def by_document(table: pa.Table) -> pa.Table:
    """All answers to one group of texts, one row per document."""
    k, tie, at = [], [], []
    for docs, row, raw in zip(*(table.column(name).to_pylist() for name in ("docs", "row", "at"))):
        of, ordinal = np.frombuffer(docs, np.int64).reshape(2, -1), unplanes(row)
        values = np.frombuffer(raw, np.uint8).reshape(len(ordinal), -1)
        order = np.argsort(ordinal, kind="stable")
        cuts = np.searchsorted(ordinal[order], np.arange(of.shape[1] + 1))
        values = values[order]
        k += of[0].tolist()
        tie += of[1].tolist()
        at += [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    joined: dict[tuple[int, int], list[bytes]] = {}
    for key, raw in zip(zip(k, tie), at):
        joined.setdefault(key, []).append(raw)
    return pa.Table.from_arrays([
        pa.array([x for x, _ in joined], pa.int64()), pa.array([x for _, x in joined], pa.int64()),
        pa.array([b"".join(x) for x in joined.values()], pa.binary())], schema=REPLIES_ARROW)


def exchanged(sent: DataFrame, answer: Callable) -> DataFrame:
    """Replies to the facts in `sent`, one row per group of texts and document."""

    def answer_part(table):
        try:
            return answer(table)
        finally:
            release()

    return sent.groupBy("part").applyInArrow(answer_part, ANSWERS).groupBy("gid").applyInArrow(by_document, REPLIES)


def with_replies(docs: DataFrame, replies: DataFrame) -> DataFrame:
    """Documents with all their answers in __ties and __ats (null: none)."""
    grouped = replies.groupBy("__k").agg(F.collect_list(F.struct("__tie", "at")).alias("__r"))
    grouped = grouped.select("__k", F.col("__r.__tie").alias("__ties"), F.col("__r.at").alias("__ats"))
    return docs.join(grouped, "__k", "left")


def replies_of(batch: pa.RecordBatch) -> list[bytes]:
    """Joined answer bytes of each row."""
    ties_ = batch.column(batch.schema.get_field_index("__ties")).to_pylist()
    ats = batch.column(batch.schema.get_field_index("__ats")).to_pylist()
    return [b"".join([a for t, a in zip(ts, xs) if t == own]) if ts else b"" for ts, xs, own in zip(ties_, ats, names(batch)[1].tolist())]


def result(batch: pa.RecordBatch, text: str, made: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """The columns of the documents, the text under its own name, and those `made`."""
    for f in schema:
        if f.name not in made:
            made[f.name] = batch.column(batch.schema.get_field_index("__text" if f.name == text else f.name))
    return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def result_schema(docs: DataFrame, extra: str) -> str:
    """DDL of the columns of `docs` that `extra` does not replace, then `extra`."""
    new = {x.split()[0] for x in extra.split(", ")}
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in new]
    return ", ".join([*kept, extra])
