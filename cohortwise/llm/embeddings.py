"""Near-duplicate embeddings: cells of spherical k-means, and blocked cosine products between them.

Every vector belongs to the cell of its best centroid. It also visits each other cell in which a
vector with a cosine of at least `threshold` to it can lie: a vector of cell c is nearer to c than
to any other centroid, so one that lies further than the threshold's chord on the other side of
the plane between the two has no partner there. No pair is lost by that, and of two partners each
visits the other's cell.

Cells that lie close together are packed into blocks of bounded size, and a cell that is larger is cut over
several. A vector goes to each pair of its own block and one with a cell it visits, once however many cells
of that block it visits. There the vectors of two cells that visit the other's cell are multiplied tile
by tile: along their SHORT main axes first, which with the lengths of the rests bounds the cosine, then as a whole
where the bound allows a link. Single precision serves for both; what it leaves open is decided in double precision.

The centroids are fitted on a bounded sample; all rows are assigned and compared. Vectors of each
length have cells of their own. Vectors without any cluster structure visit many cells: then each goes to
nearly all blocks, and the products grow with the square of the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import compute
from pyspark.sql import DataFrame, functions as F

from cohortwise.llm import texts
from cohortwise.llm.common import stored
from cohortwise.llm.components import components

#: Vectors of a block at most, their bytes in single precision at most, and vectors below which more blocks are of no use.
BLOCK, BLOCK_BYTES, LEAST = 1 << 17, 32 << 20, 1024
#: Blocks to cut a small table into, for tasks to share.
SPREAD = 4
#: Vectors on each side of a product.
TILE = 1024
#: Dimensions that bound a cosine from above, with the length of what they leave out as one more.
SHORT = 16
SLACK = 1e-6


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of spherical k-means on unit vectors; at most as many as there are vectors."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1)
        centroids = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)), pa.array(flat))


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # squares of very large or small numbers stay finite
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _cells(x: np.ndarray, c: np.ndarray | None, chord: float) -> tuple[np.ndarray, np.ndarray]:
    """(cell of each vector, which cells each visits); without centroids there is one cell."""
    if c is None:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    cosine = x @ c.T
    own = cosine.argmax(axis=1)
    gap = np.sqrt(np.maximum(2 - 2 * (c @ c.T), 0))[own]  # between centroids
    return own, cosine[np.arange(len(own)), own][:, None] - cosine <= chord * gap + SLACK


def _chord(threshold: float) -> float:
    return math.sqrt(max(2 - 2 * threshold, 0.0)) + SLACK


def _by_length(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(length, rows with vectors of it), a few rows at a time."""
    for whole in batches:
        for first in range(0, whole.num_rows, TILE):
            batch = whole.slice(first, TILE)
            lengths = compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for n in np.unique(lengths).tolist():
                yield n, batch.filter(pa.array(lengths == n))


@texts.trimmed
def _assign(batches, centroids) -> Iterator[pa.RecordBatch]:
    """How many vectors each cell has, in parts."""
    for n, batch in _by_length(batches):
        own = np.zeros(len(batch), np.int64) if n not in centroids.value else (_unit(_matrix(batch.column(2))) @ centroids.value[n].T).argmax(axis=1)
        cell, count = np.unique(own, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(count)], ["length", "cell", "members"])


def _chain(c: np.ndarray) -> list[int]:
    """Centroids in an order in which each is followed by the nearest that is left."""
    order, left = [0], np.ones(len(c), bool)
    for _ in range(len(c) - 1):
        left[order[-1]] = False
        order.append(int(np.where(left, c @ c[order[-1]], -np.inf).argmax()))
    return order


def _packed(order: list[int], members: dict[int, int], most: int, first: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first block of each cell, number of blocks it is cut over, block after the last), blocks of about `most` vectors."""
    begin, pieces, block, room = np.zeros(len(order), np.int64), np.ones(len(order), np.int64), first, most
    for cell in order:
        size = members.get(cell, 0)
        if size > room and room < most:
            block, room = block + 1, most
        begin[cell], pieces[cell] = block, max(1, -(-size // most))
        room -= size
        if room <= 0:
            block, room = block + int(pieces[cell]), most
    return begin, pieces, block + (room < most)


@texts.trimmed
def _deal(batches, layout, threshold: float) -> Iterator[pa.RecordBatch]:
    """Vectors with their cell, their block and all blocks with cells they visit."""
    chord = _chord(threshold)
    for n, batch in _by_length(batches):
        c, begin, pieces = layout.value[n]
        node = batch.column(0).to_numpy(zero_copy_only=False)
        cell, near = _cells(np.empty((len(batch), 0)) if c is None else _unit(_matrix(batch.column(2))), c, chord)
        low = int(begin.min())
        holds = np.zeros((len(begin), int((begin + pieces).max()) - low), np.float32)
        for i in range(len(begin)):
            holds[i, begin[i] - low:begin[i] - low + pieces[i]] = 1
        row, to = np.nonzero(near.astype(np.float32) @ holds)
        mine = begin[cell] + node % pieces[cell]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(np.full(len(batch), n, np.int32)), pa.array(cell.astype(np.int32)), pa.array(mine.astype(np.int32)),
             _lists((to + low).astype(np.int32), np.bincount(row, minlength=len(batch)))],
            ["node", "copies", "vector", "length", "cell", "mine", "blocks"])


def _roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n things the least that links lead to."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[left], root[right])
        new = root.copy()
        for side in (left, right, root[left], root[right]):
            np.minimum.at(new, side, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class _Linker:
    """The links between the vectors of a pair of blocks."""

    def __init__(self, vectors: pa.ChunkedArray, copies: np.ndarray, threshold: float):
        self.vectors, self.copies, self.threshold = vectors, copies.astype(np.float64), threshold
        self.x = np.concatenate([self._units(vectors.slice(a, TILE)).astype(np.float32) for a in range(0, len(vectors), TILE)])
        d = self.x.shape[1]
        self.error = (d + 4) * 2.0**-23  # of a cosine in single precision, at most
        self.short = None
        if d > 2 * SHORT:
            axes = np.linalg.eigh((self.x.T @ self.x).astype(np.float64))[1][:, :-SHORT - 1:-1].astype(np.float32)
            self.short = np.empty((len(self.x), SHORT + 1), np.float32)
            self.short[:, :SHORT] = self.x @ axes
            self.short[:, SHORT] = np.sqrt(np.maximum(1 + 4 * self.error - (self.short[:, :SHORT]**2).sum(axis=1), 0))
        self.links = np.zeros(len(vectors))
        self.left, self.right, self.kept = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0

    @staticmethod
    def _units(vectors: pa.ChunkedArray) -> np.ndarray:
        return np.concatenate([_unit(_matrix(chunk)) for chunk in vectors.chunks if len(chunk)])

    def visitors(self, rows: np.ndarray, own: int, cells: np.ndarray, c: np.ndarray | None) -> np.ndarray:
        """Which of `cells` each of `rows`, of the cell `own`, visits."""
        if c is None:
            return np.ones((len(rows), len(cells)), bool)
        limit = _chord(self.threshold) * np.sqrt(np.maximum(2 - 2 * (c[cells] @ c[own]), 0)) + SLACK + 2 * self.error
        apart = (c[own] - c[cells]).astype(np.float32)
        return np.concatenate([self.x[rows[a:a + TILE]] @ apart.T <= limit for a in range(0, len(rows), TILE)])

    def multiply(self, rows: np.ndarray, cols: np.ndarray, same: bool) -> None:
        for i in range(0, len(rows), TILE):
            for j in range(i if same else 0, len(cols), TILE):
                self._tile(rows[i:i + TILE], cols[j:j + TILE], same and i == j)

    def _tile(self, rows: np.ndarray, cols: np.ndarray, diagonal: bool) -> None:
        if self.short is not None:
            most = self.short[rows] @ self.short[cols].T
            if diagonal:
                np.fill_diagonal(most, -2)
            if most.max() < self.threshold - 8 * self.error:
                return
            near = most >= self.threshold - 8 * self.error
            rows, cols = rows[near.any(axis=1)], cols[near.any(axis=0)]
        cosine = self.x[rows] @ self.x[cols].T
        if diagonal:
            cosine[rows[:, None] == cols[None, :]] = -2
        if cosine.max() < self.threshold - self.error:
            return
        linked = cosine >= self.threshold - self.error
        r, s = np.nonzero(linked & (cosine <= self.threshold + self.error))
        for a in range(0, len(r), TILE):
            one, two = (self._units(self.vectors.take(pa.array(side))) for side in (rows[r[a:a + TILE]], cols[s[a:a + TILE]]))
            linked[r[a:a + TILE], s[a:a + TILE]] = (one * two).sum(axis=1) >= self.threshold
        hit, met = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        if not len(hit):
            return
        part, rows, cols = linked[np.ix_(hit, met)], rows[hit], cols[met]
        self.links[rows] += part @ self.copies[cols]
        if not diagonal:
            self.links[cols] += self.copies[rows] @ part
        # a forest of the links: each to the least it reaches in this tile
        left, right = rows.copy(), cols.copy()
        most = len(self.x)
        while True:
            new_left = np.minimum(left, np.where(part, right[None, :], most).min(axis=1))
            new_right = np.minimum(right, np.where(part, new_left[:, None], most).min(axis=0))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        self.left += [rows, cols]
        self.right += [left, right]
        self.kept += len(rows) + len(cols)
        if self.kept > max(1 << 20, 2 * len(self.x)):
            self.forest()

    def forest(self) -> np.ndarray:
        """For each vector the least its links lead to; the links kept are cut down to these."""
        root = _roots(len(self.x), np.concatenate(self.left), np.concatenate(self.right))
        joined = np.flatnonzero(root != np.arange(len(root)))
        self.left, self.right, self.kept = [joined], [root[joined]], len(joined)
        return root


def _link(table: pa.Table, centroids: dict[int, np.ndarray], threshold: float) -> pa.Table:
    """The links of a pair of blocks, or within a block: their number for each vector, and a forest of them."""
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    mine, cell, node = (table.column(x).to_numpy() for x in ("mine", "cell", "node"))
    c = centroids.get(table.column("length")[0].as_py())
    order = np.argsort(cell, kind="stable")
    sides = []
    for block in dict.fromkeys((low, high)):
        here = order[mine[order] == block]
        cells, begin = np.unique(cell[here], return_index=True)
        sides.append((cells, np.split(here, begin[1:]) if len(here) else []))
    if all(len(cells) for cells, _ in sides):
        linker = _Linker(table.column("vector"), table.column("copies").to_numpy(), threshold)
        (a_cells, a_rows), (b_cells, b_rows) = sides[0], sides[-1]
        a_sees = [linker.visitors(rows, own, b_cells, c) for own, rows in zip(a_cells, a_rows)]
        b_sees = a_sees if low == high else [linker.visitors(rows, own, a_cells, c) for own, rows in zip(b_cells, b_rows)]
        for i, rows in enumerate(a_rows):
            for j in range(i if low == high else 0, len(b_rows)):
                linker.multiply(rows[a_sees[i][:, j]], b_rows[j][b_sees[j][:, i]], low == high and i == j)
        linked = np.flatnonzero(linker.links)
        root = linker.forest()
        joined = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({
            "node": np.concatenate((node[linked], node[joined])), "links": np.concatenate((linker.links[linked], np.zeros(len(joined)))).astype(np.int64),
            "other": pa.array(np.concatenate((np.zeros(len(linked), np.int64), node[root[joined]])), mask=np.arange(len(linked) + len(joined)) < len(linked))})
    return pa.table({x: pa.array([], pa.int64()) for x in ("node", "links", "other")})


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, sample_rows: int = 20_000, most_cells: int = 4096,
    id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """`vectors` with n_links, component_id and kept, by cosine at or above `threshold` in double precision.

    n_links is the number of other rows linked directly, component_id the least id reachable by
    links (itself included), kept whether that is the row's own id. Columns of these names are
    replaced. Null and zero vectors and those with null or non-finite components link with nothing.
    Vectors of each length are compared with one another; those of different lengths do not link. Equal vectors, repeated rows included,
    link with each other; they are compared as one and counted by their number. Rows with one id
    are one node if their vectors are equal; a null id is greater than all others.

    For each length there are half the root of the number of different vectors of cells, up to
    `most_cells`, fitted on its share of `sample_rows` vectors, the least by a hash. A kept row stands for its group.
    """
    spark = vectors.sparkSession
    numbers = F.transform(F.col(vector), lambda v: v.cast("double"))
    usable = F.coalesce(
        F.forall(numbers, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(numbers, lambda v: v != 0), F.lit(False))
    rows = vectors.withColumns({"__v": F.col(vector), "__usable": usable})
    rows = rows.withColumn("__node", F.when(F.col("__usable"), F.xxhash64("__v")))
    distinct = rows.where("__node is not null").groupBy("__node").agg(F.count(F.lit(1)).alias("__copies"), F.any_value("__v").alias("__v"))
    distinct = stored(distinct, "vectors")
    many = {r["n"]: r["count"] for r in distinct.groupBy(F.size("__v").alias("n")).count().collect()}
    if many:
        fitted = {}
        for n, count in many.items():
            cells = min(most_cells, max(1, round(math.sqrt(count) / 2)))
            if cells > 1:
                share = max(cells, round(sample_rows * count / sum(many.values())))
                # the least by a hash are among these, so no task has to order all vectors
                least = distinct.where((F.size("__v") == n) & (F.xxhash64("__node") <= min((1 << 63) - 1, int(2.0**65 * (share + 1000) / count) - (1 << 63))))
                sample = least.orderBy(F.xxhash64("__node"), "__node").limit(share).select("__v").toPandas()["__v"]
                fitted[n] = fit_centroids(_unit(np.array(sample.tolist())), cells)
        centroids = spark.sparkContext.broadcast(fitted)
        members: dict[int, dict[int, int]] = {n: {} for n in many}
        counted = distinct.mapInArrow(partial(_assign, centroids=centroids), "length int, cell int, members long")
        for r in counted.groupBy("length", "cell").agg(F.sum("members").alias("members")).collect():
            members[r["length"]][r["cell"]] = r["members"]
        layout, block = {}, 0
        for n, count in many.items():
            c = fitted.get(n)
            most = max(1, min(BLOCK, BLOCK_BYTES // (4 * n), max(LEAST, -(-count // SPREAD))))
            begin, pieces, block = _packed([0] if c is None else _chain(c), members[n], most, block)
            layout[n] = c, begin, pieces
        layout = spark.sparkContext.broadcast(layout)
        kind = vectors.schema[vector].dataType.simpleString()
        schema = f"node long, copies long, vector {kind}, length int, cell int, mine int, blocks array<int>"
        dealt = distinct.mapInArrow(partial(_deal, layout=layout, threshold=threshold), schema)
        pairs = dealt.select("node", "copies", "vector", "length", "cell", "mine", F.explode("blocks").alias("__other")).select(
            "node", "copies", "vector", "length", "cell", "mine", F.least("mine", "__other").alias("low"), F.greatest("mine", "__other").alias("high"))

        def link(table):
            try:
                return _link(table, centroids.value, threshold)
            finally:
                texts.release()

        found = stored(pairs.groupBy("low", "high").applyInArrow(link, "node long, links long, other long"), "links")
        links = found.where("other is null").groupBy(F.col("node").alias("__n")).agg(F.sum("links").alias("__links"))
        whole = components(found.where("other is not null and other != node").select("node", "other")).toDF("__m", "__c")
    else:
        links = spark.createDataFrame([], "__n long, __links long")
        whole = spark.createDataFrame([], "__m long, __c long")
    names = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    rows = rows.withColumn("__id", F.coalesce(F.col(id_column).cast("long"), F.lit((1 << 63) - 1)))
    labels = distinct.select("__node", "__copies").join(links, F.col("__node") == F.col("__n"), "left").join(
        whole, F.col("__node") == F.col("__m"), "left").select(
        F.col("__node").alias("__of"), (F.coalesce("__links", F.lit(0)) + F.col("__copies") - 1).alias("__total"), F.coalesce("__c", "__node").alias("__group"))
    least = rows.where("__node is not null").groupBy("__node").agg(F.min("__id").alias("__least")).join(
        labels, F.col("__node") == F.col("__of")).groupBy("__group").agg(F.min("__least").alias("__first")).withColumnRenamed("__group", "__g")
    out = rows.join(labels, F.col("__node") == F.col("__of"), "left").join(least, F.col("__group") == F.col("__g"), "left")
    component = F.coalesce("__first", "__id")
    return out.select(
        *names, F.coalesce("__total", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != (1 << 63) - 1, component).alias("component_id"), (component == F.col("__id")).alias("kept"))
