"""Rank correlation of every pair of genes of a study at once, from blocks of genes and chunks of samples.

Two genes are compared on the samples that both have, so a gene has a rank for each set of samples it meets. Genes of a
block that are known for the same samples form a pattern, and ranks depend on the other gene's pattern only. A task takes
two blocks over one chunk. It first counts the values of a gene among the samples of each pattern; the counts of all
chunks are added up range by range of the values and give the ranks, and a second task on the same blocks and chunk
multiplies them. The products of the chunks add up to the correlations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortwise.operators.coverage import GENE, SAMPLE
from cohortwise.operators.expression import gene_values
from cohortwise.plans.ranking import mean_ranks
from cohortwise.plans.scope import STUDY
from cohortwise.session import shared_dir

#: Genes to a block and samples to a chunk, on average, and samples to a range of a gene's values (more only if they tie).
GENES, SAMPLES, RANGE = 64, 4096, 32_768
#: Samples that are multiplied at once.
SLICE = 512

UNIT = [STUDY, "chunk", "i", "j"]
PART = [STUDY, "block", "g", "facing", "r"]


def correlation_matrix(t, study: str | None, profile: str) -> DataFrame:
    """(study, gene_a < gene_b, spearman_correlation, num_samples) of all pairs of genes that share a sample.

    The correlation is null for fewer than 3 shared samples, or where a gene does not vary on them. Of repeated values of
    a sample and gene the mean counts. The study is a column only if `study` is None.
    """
    # values, their places in blocks, and counts are read several times over below
    shared_dir(t.spark)
    values = gene_values(t, study, profile).groupBy(STUDY, SAMPLE, GENE).agg(F.avg("v").alias("v")).checkpoint()
    genes = _blocks(values)
    # the number of lesser values of the gene stands for a value
    places = mean_ranks(values, [STUDY, GENE], "v").select(STUDY, GENE, "v", F.col("n_below").alias("place"))
    chunks = values.select(STUDY, SAMPLE).distinct().groupBy(STUDY).agg(F.ceil(F.count("*") / SAMPLES).cast("int").alias("chunks"))
    packed = (
        values.join(places, [STUDY, GENE, "v"]).join(genes, [STUDY, GENE])
        .groupBy(STUDY, SAMPLE, "block").agg(F.collect_list(F.struct("g", "pattern", "place")).alias("cells"), F.max("blocks").alias("blocks"))
        .join(chunks, STUDY).withColumn("chunk", F.pmod(F.xxhash64(SAMPLE), F.col("chunks")).cast("int")).checkpoint())
    facing = packed.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = facing.select(STUDY, "chunk", F.least("block", "facing").alias("i"), F.greatest("block", "facing").alias("j"), "block", SAMPLE, "cells")
    width, step = RANGE, SLICE
    counts = sent.groupBy(*UNIT).applyInArrow(
        lambda key, table: _count(key, table, width), f"{STUDY} string, chunk int, block int, g int, facing int, r long, patterns binary, places binary, counts binary")
    added = counts.groupBy(*PART).applyInArrow(
        _add, f"{STUDY} string, chunk int, block int, g int, facing int, r long, patterns binary, places binary, twice binary, "
        "totals array<struct<pattern: int, n: bigint, ties: double>>").checkpoint()
    ranked = added.where(F.col("totals").isNull()).drop("totals").join(_scales(added), PART)
    ranked = ranked.withColumns({"i": F.least("block", "facing"), "j": F.greatest("block", "facing")})
    products = sent.groupBy(*UNIT).cogroup(ranked.groupBy(*UNIT)).applyInArrow(
        lambda key, table, ranks: _product(key, table, ranks, step), f"{STUDY} string, i int, j int, a int, b int, part double, n long")
    summed = products.groupBy(STUDY, "i", "j", "a", "b").agg(F.sum("part").alias("r"), F.sum("n").alias("num_samples"))
    named = genes.select(STUDY, "block", "g", GENE)
    found = summed.join(named.toDF(STUDY, "i", "a", "x"), [STUDY, "i", "a"]).join(named.toDF(STUDY, "j", "b", "y"), [STUDY, "j", "b"])
    known = F.when((F.col("num_samples") >= 3) & ~F.isnan("r"), F.col("r"))
    return found.select(
        *([STUDY] if study is None else []), F.least("x", "y").alias("gene_a"), F.greatest("x", "y").alias("gene_b"),
        known.alias("spearman_correlation"), "num_samples")


def _blocks(values: DataFrame) -> DataFrame:
    """(study, gene, blocks, block, g, pattern): a gene's number in its block, and the least one known for the same samples."""
    seen = F.xxhash64(SAMPLE).cast("decimal(20,0)")
    genes = values.groupBy(STUDY, GENE).agg(F.xxhash64(F.count("*"), F.sum(seen)).alias("known"))
    sizes = genes.groupBy(STUDY).agg(F.ceil(F.count("*") / GENES).cast("int").alias("blocks"))
    genes = genes.join(sizes, STUDY).withColumn("block", F.pmod(F.xxhash64(GENE), F.col("blocks")).cast("int"))
    genes = genes.withColumn("g", F.row_number().over(W.partitionBy(STUDY, "block").orderBy(GENE)) - 1)
    return genes.withColumn("pattern", F.min("g").over(W.partitionBy(STUDY, "block", "known"))).drop("known")


def _scales(added: DataFrame) -> DataFrame:
    """`scales` per part: for each pattern what to add to a rank inside the part to centre it, and one over the length of all ranks."""
    parts = added.where(F.col("totals").isNotNull()).select(*PART, F.inline("totals"))
    whole = W.partitionBy(STUDY, "block", "g", "facing", "pattern")
    base = F.coalesce(F.sum("n").over(whole.orderBy("r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.col("n_all").cast("double")
    parts = parts.withColumns({"base": base, "n_all": F.sum("n").over(whole), "ties_all": F.sum("ties").over(whole)})
    spread = n * n * n - n - F.col("ties_all")
    scale = F.when(spread > 0, F.lit(1e0) / F.sqrt(spread / 12)).otherwise(F.lit(float("nan")))
    parts = parts.select(*PART, F.struct("pattern", (F.col("base") - n / 2).alias("shift"), scale.alias("scale")).alias("one"))
    return parts.groupBy(*PART).agg(F.sort_array(F.collect_list("one")).alias("scales"))


def _grids(key: tuple[pa.Scalar, ...], table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each block of the unit: (places by gene and sample, -1 where there is none; pattern of each gene, -1 for absent ones)."""
    samples = table.column(SAMPLE).combine_chunks().dictionary_encode()
    block, lists = table.column("block").to_numpy(), table.column("cells").combine_chunks()
    cells, width = lists.flatten(), len(samples.dictionary)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    g, pattern, place = (cells.field(f).to_numpy() for f in ("g", "pattern", "place"))
    out = {}
    for b in {key[2].as_py(), key[3].as_py()}:
        mine = block[row] == b
        grid = np.full((int(g[mine].max(initial=-1)) + 1, width), -1, np.int64)
        grid[g[mine], samples.indices.to_numpy()[row[mine]]] = place[mine]
        patterns = np.full(len(grid), -1, np.int64)
        patterns[g[mine]] = pattern[mine]
        out[b] = grid, patterns
    return out


def _directions(key: tuple[pa.Scalar, ...]) -> list[tuple[int, int]]:
    i, j = key[2].as_py(), key[3].as_py()
    return [(i, j), (j, i)] if i != j else [(i, i)]


def _count(key: tuple[pa.Scalar, ...], table: pa.Table, width: int) -> pa.Table:
    """For each gene and range of its places: how often each place occurs among the samples of each pattern of the facing block."""
    grids, rows = _grids(key, table), []
    for block, facing in _directions(key):
        (grid, _), (other, patterns) = grids[block], grids[facing]
        found = np.unique(patterns[patterns >= 0])
        for g in np.flatnonzero((grid >= 0).any(axis=1)) if len(found) else ():
            here = grid[g] >= 0
            place, at = np.unique(grid[g, here], return_inverse=True)
            shared = other[found][:, here] >= 0
            counts = np.stack([np.bincount(at[s], minlength=len(place)) for s in shared], axis=1).astype(np.int32)
            ranges = place // width
            for r in np.unique(ranges).tolist():
                one = ranges == r
                rows.append((block, int(g), facing, r, found.astype(np.int32).tobytes(), place[one].tobytes(), counts[one].tobytes()))
    columns = list(zip(*rows)) or [[]] * 7
    made = dict(zip(("block", "g", "facing", "r", "patterns", "places", "counts"), columns))
    kinds = dict(block=pa.int32(), g=pa.int32(), facing=pa.int32(), r=pa.int64(), patterns=pa.binary(), places=pa.binary(), counts=pa.binary())
    return pa.table({
        STUDY: pa.array([key[0].as_py()] * len(rows), pa.string()), "chunk": pa.array([key[1].as_py()] * len(rows), pa.int32()),
        **{name: pa.array(made[name], kind) for name, kind in kinds.items()}})


def _read(row: dict, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(row[name], kind)


def _add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Twice the middle rank of each place inside the part, back in the rows of the chunks, and a row of totals."""
    rows = table.select(["chunk", "patterns", "places", "counts"]).to_pylist()
    patterns = np.unique(np.concatenate([_read(row, "patterns", np.int32) for row in rows]))
    places = np.unique(np.concatenate([_read(row, "places", np.int64) for row in rows]))
    total = np.zeros((len(places), len(patterns)), np.int64)

    def cells(row: dict) -> tuple[np.ndarray, ...]:
        return np.ix_(np.searchsorted(places, _read(row, "places", np.int64)), np.searchsorted(patterns, _read(row, "patterns", np.int32)))

    for row in rows:
        at = cells(row)
        total[at] += _read(row, "counts", np.int32).reshape(at[0].size, at[1].size)
    twice = 2 * np.cumsum(total, axis=0) - total
    ties = total.astype(np.float64)
    ties = (ties * ties * ties - ties).sum(axis=0)
    totals = [{"pattern": p, "n": n, "ties": x} for p, n, x in zip(patterns.tolist(), total.sum(axis=0).tolist(), ties.tolist())]
    n = len(rows) + 1
    kind = pa.list_(pa.struct([("pattern", pa.int32()), ("n", pa.int64()), ("ties", pa.float64())]))
    return pa.table({
        STUDY: pa.array([key[0].as_py()] * n, pa.string()), "chunk": pa.array([*(row["chunk"] for row in rows), None], pa.int32()),
        **{name: pa.array([key[k].as_py()] * n, pa.int32()) for k, name in enumerate(("block", "g", "facing"), 1)},
        "r": pa.array([key[4].as_py()] * n, pa.int64()),
        "patterns": pa.array([*(row["patterns"] for row in rows), None], pa.binary()),
        "places": pa.array([*(row["places"] for row in rows), None], pa.binary()),
        "twice": pa.array([*(twice[cells(row)].tobytes() for row in rows), None], pa.binary()),
        "totals": pa.array([*[None] * len(rows), totals], kind)})


def _ranks(ranked: pa.Table) -> dict[tuple[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """For each block and facing one, gene by gene: (places, centred ranks of unit length by place and pattern)."""
    out: dict = {}
    for row in sorted(ranked.select(["block", "g", "facing", "r", "patterns", "places", "twice", "scales"]).to_pylist(), key=lambda row: row["r"]):
        places, patterns = _read(row, "places", np.int64), _read(row, "patterns", np.int32)
        known, shift, scale = (np.array([s[f] for s in row["scales"]]) for f in ("pattern", "shift", "scale"))
        at = np.searchsorted(known, patterns)
        twice = _read(row, "twice", np.int64).reshape(len(places), len(patterns))
        out.setdefault((row["block"], row["facing"]), {}).setdefault(row["g"], []).append((places, (twice / 2 + shift[at]) * scale[at]))
    return {pair: {g: tuple(np.concatenate(x) for x in zip(*parts)) for g, parts in by.items()} for pair, by in out.items()}


def _product(key: tuple[pa.Scalar, ...], table: pa.Table, ranked: pa.Table, step: int) -> pa.Table:
    """Products of the ranks of all pairs of a gene of one block and a gene of the other over the samples of a chunk."""
    i, j = key[2].as_py(), key[3].as_py()
    grids, ranks = _grids(key, table), _ranks(ranked)
    (first, first_patterns), (second, second_patterns) = grids[i], grids[j]
    dots = np.zeros((len(first), len(second)))
    shared = (first >= 0).astype(np.float64) @ (second >= 0).astype(np.float64).T

    def vectors(block: int, facing: int, cut: slice) -> np.ndarray:
        """Ranks by pattern of the facing block, gene and sample; 0 where the gene is missing."""
        grid, patterns = grids[block][0][:, cut], grids[facing][1]
        out = np.zeros((len(np.unique(patterns[patterns >= 0])), *grid.shape))
        for g, (places, z) in ranks.get((block, facing), {}).items():
            here = np.flatnonzero(grid[g] >= 0)
            out[:, g, here] = z[np.searchsorted(places, grid[g, here])].T
        return out

    sides = [(np.unique(p[p >= 0]), p) for p in (first_patterns, second_patterns)]
    members = [[np.flatnonzero(p == one) for one in found] for found, p in sides]
    for start in range(0, first.shape[1], step):
        cut = slice(start, start + step)
        left = vectors(i, j, cut)
        right = left if i == j else vectors(j, i, cut)
        for p, a in enumerate(members[0]):
            for q, b in enumerate(members[1]):
                if i != j or p <= q:
                    dots[np.ix_(a, b)] += left[q][a] @ right[p][b].T
    keep = shared > 0
    if i == j:  # patterns were taken in one order
        dots = np.where(first_patterns[:, None] <= second_patterns[None, :], dots, dots.T)
        keep &= np.arange(len(first))[:, None] < np.arange(len(second))[None, :]
    a, b = np.nonzero(keep)
    n = len(a)
    return pa.table({
        STUDY: pa.array([key[0].as_py()] * n, pa.string()), "i": pa.array([i] * n, pa.int32()), "j": pa.array([j] * n, pa.int32()),
        "a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "part": pa.array(dots[a, b], pa.float64()),
        "n": pa.array(shared[a, b].astype(np.int64), pa.int64())})
