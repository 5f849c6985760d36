"""Toxicity: cumulative-link ordinal regression on sparse text features.

    P(grade <= k | text) = sigmoid(cut[k] - weights . features)

One weight vector is shared by all ordered thresholds. Features are the words of a text (runs of
letters, A-Z in lower case) and the words' beginnings of BEGINNINGS bytes, each present or absent.
The model is fitted on a bounded sample of labelled rows; texts are scored in whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortwise.llm import texts
from cohortwise.llm.common import stored

BEGINNINGS = (4, 5, 6)
LETTER = np.ones(256, bool)  # True: ends a word
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(128, 256)]] = False
U64 = np.uint64
TABLE_BITS = 20


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return texts.words(data, offsets, LETTER)


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all whole words, then of all beginnings of each length."""
    data = texts.LOWER[data]
    start, end, row = _words(data, offsets)
    sums = texts.prefix_sums(data)
    yield row, texts.window_hash(sums, start, end)
    for n, length in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(end - start >= length)
        yield row[long], texts.window_hash(sums, start[long], start[long] + length) + U64(n)


@dataclass
class Model:
    """Hashes of the features in order, their weights, and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def probabilities(self, total: np.ndarray) -> np.ndarray:
        """P(grade) for each sum of weights."""
        upto = 1 / (1 + np.exp(np.clip(total[:, None] - self.cuts[None, :], -500, 500)))
        return np.diff(np.concatenate((np.zeros((len(total), 1)), upto, np.ones((len(total), 1))), axis=1), axis=1)


def fit_ordinal(rows: np.ndarray, features: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, l2: float = 0.05, rounds: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """(weights, cuts) for sparse rows given as pairs (row, feature), by gradient steps with momentum.

    The cuts are kept in order by fitting the logarithms of their distances.
    """
    n, w = len(grades), np.zeros(n_features)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / n, 1e-3, 1 - 1e-3)
    cuts = np.log(share / (1 - share))
    p = np.concatenate((w, cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for t in range(1, rounds + 1):
        w, gaps = p[:n_features], np.exp(p[n_features + 1:])
        cuts = p[n_features] + np.concatenate(([0.0], np.cumsum(gaps)))
        total = np.bincount(rows, weights=w[features], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(np.concatenate((np.full((n, 1), -1e9), cuts[None, :] - total[:, None], np.full((n, 1), 1e9)), axis=1), -500, 500)))
        upper, lower = s[np.arange(n), grades + 1], s[np.arange(n), grades]
        likelihood = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / likelihood, lower * (1 - lower) / likelihood
        d_cut = np.array([du[grades == k].sum() - dl[grades == k + 1].sum() for k in range(n_grades - 1)])
        d_total = dl - du
        g = np.concatenate((
            np.bincount(features, weights=d_total[rows], minlength=n_features) - l2 * w,
            [d_cut.sum()], [d_cut[k + 1:].sum() * gaps[k] for k in range(len(gaps))])) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        p = p + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return p[:n_features], p[n_features] + np.concatenate(([0.0], np.cumsum(np.exp(p[n_features + 1:]))))


def labelled_sample(labels: DataFrame, docs: DataFrame, bound: int, id_column: str = "doc_id", label: str = "toxic", text: str = "text") -> DataFrame:
    """(id, label, text) of at most `bound` labelled ids, the least by a hash of the id; the ids are broadcast.

    An id with several labels has the greatest; ids or labels that are null are left out, and of
    repeated documents each is an example.
    """
    least = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_column).alias("__id")).agg(F.max(label).alias("__label"))
    least = least.orderBy(F.xxhash64("__id"), "__id").limit(bound)
    return docs.join(F.broadcast(least), F.col(id_column) == F.col("__id")).select("__id", "__label", F.col(text).alias("__text"))


@texts.trimmed
def _feature_rows(batches) -> Iterator[pa.RecordBatch]:
    """A row for each document and feature, and one without a feature for each document."""
    for batch in batches:
        ids, labels = (batch.column(batch.schema.get_field_index(x)) for x in ("__id", "__label"))
        labels = labels.cast(pa.int32())
        nothing = pa.nulls(batch.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([ids, labels, nothing, nothing], ["id", "label", "feature", "count"])
        for first, _, data, offsets in texts.pieces(batch, "__text"):
            found = [np.concatenate(x) for x in zip(*_features(data, offsets))]
            counted, count = np.unique(np.stack((found[0].astype(U64), found[1])), axis=1, return_counts=True)
            row = pa.array(counted[0].astype(np.int64) + first)
            yield pa.RecordBatch.from_arrays(
                [ids.take(row), labels.take(row), pa.array(counted[1].view(np.int64)), pa.array(count)], ["id", "label", "feature", "count"])


def fit(
    labels: DataFrame, docs: DataFrame, bound: int = 20_000, most_features: int = 4096, support: int = 5,
    odds: float = 8.0, steps: tuple[int, ...] = (2, 5), l2: float = 0.05, id_column: str = "doc_id", label: str = "toxic", text: str = "text",
) -> Model:
    """Ordinal model from labels 0 (clean) and 1 (toxic) of at most `bound` documents.

    Features are those in at least `support` toxic examples whose odds of being in a toxic one are
    `odds` times the average (the `most_features` in most toxic examples). Severity grades: 0 for
    clean; a toxic example has grade 1, and one more for each number of `steps` that the number
    of its associated words reaches. Without toxic or without clean examples, or without any
    associated feature, the model finds every text clean.
    """
    sample = labelled_sample(labels, docs, bound, id_column, label, text)
    found = stored(sample.mapInArrow(_feature_rows, "id long, label int, feature long, count long"), "features")
    examples = found.where("feature is null").select("id", "label").toPandas()  # a row per example
    toxic, clean = int((examples["label"] > 0).sum()), int((examples["label"] <= 0).sum())
    found = found.where("feature is not null")
    grades = 2 + len(steps)
    nothing = Model(np.zeros(0, U64), np.zeros(0), np.arange(1, grades, dtype=float) * 20)
    if not toxic or not clean:
        return nothing
    counts = found.groupBy("feature").agg(
        F.count(F.when(F.col("label") > 0, 1)).alias("toxic"), F.count(F.when(F.col("label") <= 0, 1)).alias("clean"))
    associated = counts.where(F.col("toxic") >= support).where(
        F.col("toxic") / F.lit(toxic) >= F.lit(odds) * (F.col("clean") + F.lit(1)) / F.lit(clean + 1))
    associated = associated.orderBy(F.desc("toxic"), "clean", "feature").limit(most_features)
    kept = np.array(sorted(r["feature"] for r in associated.select("feature").collect()), np.int64)
    if not len(kept):
        return nothing
    chosen = docs.sparkSession.createDataFrame([(i, f) for i, f in enumerate(kept.tolist())], "at int, feature long")
    rows = found.join(F.broadcast(chosen), "feature").select("id", "label", "at", "count").toPandas()
    order = {i: n for n, i in enumerate(examples["id"].drop_duplicates())}
    grade = np.zeros(len(order), np.int64)
    grade[[order[i] for i in examples["id"]]] = (examples["label"] > 0).to_numpy()
    at = np.array([order[i] for i in rows["id"]], np.int64)
    feature = rows["at"].to_numpy(np.int64)
    per_word = np.zeros(len(order))
    np.maximum.at(per_word, at, np.bincount(at, weights=rows["count"], minlength=len(order))[at] / (1 + len(BEGINNINGS)))
    grade = np.where(grade > 0, 1 + sum((per_word >= s).astype(np.int64) for s in steps), 0)
    both = np.unique(np.stack((at, feature)), axis=1)
    weights, cuts = fit_ordinal(both[0], both[1], grade, len(kept), grades, l2)
    hashes = kept.view(U64)
    by = np.argsort(hashes)
    return Model(hashes[by], weights[by], cuts)


@texts.trimmed
def _score(batches, model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    maybe = np.zeros(1 << TABLE_BITS, bool)
    maybe[(m.features >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
    for batch in batches:
        total = np.zeros(batch.num_rows)
        for first, _, data, offsets in texts.pieces(batch, "__text"):
            if not len(m.features):
                break
            for row, found in _features(data, offsets):
                near = np.flatnonzero(maybe[(found >> U64(64 - TABLE_BITS)).astype(np.int64)])
                at = np.minimum(np.searchsorted(m.features, found[near]), len(m.features) - 1)
                hit = m.features[at] == found[near]
                if hit.any():
                    pairs = np.unique(np.stack((row[near[hit]], at[hit])), axis=1)
                    np.add.at(total, pairs[0] + first, m.weights[pairs[1]])
        p = m.probabilities(total)
        made = {"severity_grade": pa.array(p.argmax(axis=1).astype(np.int32)), "expected_severity": pa.array(p @ np.arange(p.shape[1])),
                "p_toxic": pa.array(1 - p[:, 0])}
        for f in schema:
            if f.name not in made:
                made[f.name] = batch.column(batch.schema.get_field_index(f.name))
        yield pa.RecordBatch.from_arrays([made[f.name].cast(f.type) for f in schema], schema=schema)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """`docs` with severity_grade (most likely), expected_severity and p_toxic = P(grade >= 1).

    Columns of these names are replaced. Null and empty texts have no features. Rows are kept as
    they are. The model has a bounded number of features and is broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string as ddl

    extra = "severity_grade int, expected_severity double, p_toxic double"
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("severity_grade", "expected_severity", "p_toxic")]
    out = ", ".join([*kept, extra])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.withColumn("__text", F.col(text)).mapInArrow(partial(_score, model=shared, schema=to_arrow_schema(ddl(out))), out)
