"""Quality classifier by co-training: a text view and a metadata view teach each other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import bounded_batches, flat, steps, written

#: Labelled rows and rows without label that the classifiers are fitted on at most, by a hash of the id.
LABELLED_ROWS = 6_000
POOL_ROWS = 10_000
ROUNDS = 5
GRAM_DIMS, META_DIMS = 512, 128
_KINDS = np.zeros(256, np.int64)  # 0 other, 1 lower case or non-ASCII, 2 upper case, 3 digit, 4 space, 5 line end, 6 punctuation
_KINDS[33:127] = 6
_KINDS[97:123] = 1
_KINDS[128:] = 1
_KINDS[65:91] = 2
_KINDS[48:58] = 3
_KINDS[[9, 11, 12, 13, 32]] = 4
_KINDS[10] = 5


def text_view(texts: pa.Array) -> np.ndarray:
    """Hashed byte trigrams (square roots of shares), shares of kinds of characters, repetition.

    A null or empty text is all zeros but for the constant.
    """
    data, bounds = flat(texts)
    out = np.zeros((len(texts), GRAM_DIMS + 12), np.float32)
    for a, b in steps(bounds):
        part = data[bounds[a] : bounds[b]].astype(np.uint64)
        grams = np.zeros(len(part), np.int64)
        if len(part) > 2:
            code = (part[:-2] | part[1:-1] << np.uint64(8) | part[2:] << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15)
            grams[:-2] = (code >> np.uint64(55)).astype(np.int64)
        kinds = _KINDS[data[bounds[a] : bounds[b]]]
        for i in range(a, b):
            lo, hi = bounds[i] - bounds[a], bounds[i + 1] - bounds[a]
            row, n = out[i], int(hi - lo)
            row[-1] = 1
            if n:
                own = np.bincount(grams[lo : max(lo, hi - 2)], minlength=GRAM_DIMS)
                row[:GRAM_DIMS] = np.sqrt(own / n)
                row[GRAM_DIMS : GRAM_DIMS + 7] = np.bincount(kinds[lo:hi], minlength=7) / n
                row[GRAM_DIMS + 7] = np.log1p(n) / 10
                row[GRAM_DIMS + 8] = (own > 0).mean()
                row[GRAM_DIMS + 9] = len(zlib.compress(data[bounds[i] : bounds[i + 1]].tobytes(), 1)) / n
                spaces = int((kinds[lo:hi] == 4).sum() + (kinds[lo:hi] == 5).sum())
                row[GRAM_DIMS + 10] = min(20.0, n / (spaces + 1)) / 20
    return out


def meta_view(columns: list[tuple[str, list]]) -> np.ndarray:
    """Metadata of a row as hashed name=value pairs and pairs of them; numbers by size class. Nulls are values."""
    rows = len(columns[0][1]) if columns else 0
    out = np.zeros((rows, META_DIMS), np.float32)
    out[:, 0] = 1
    for i in range(rows):
        own = []
        for name, values in columns:
            value = values[i]
            if isinstance(value, (int, float)):
                value = "nan" if value != value else int(4 * np.log2(1 + min(abs(float(value)), 1e300)))
            own.append(f"{name}={value}")
        for item in own + [f"{a}&{b}" for k, a in enumerate(own) for b in own[k + 1 :]]:
            out[i, 1 + zlib.crc32(item.encode()) % (META_DIMS - 1)] += 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 200) -> np.ndarray:
    w = np.zeros(x.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50))) - y
        grad = x.T @ error / max(1, len(y)) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 / np.sqrt(1 + t / 20) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (slope, offset) and the weights of the combination."""

    text: np.ndarray
    meta: np.ndarray
    scales: np.ndarray
    combine: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: calibrated text view, calibrated metadata view, both combined."""
        z = np.stack([text @ self.text, meta @ self.meta], axis=1) * self.scales[:, 0] + self.scales[:, 1]
        both = z @ self.combine[:2] + self.combine[2]
        return 1 / (1 + np.exp(-np.clip(np.column_stack([z, both]), -50, 50)))


def co_train(views: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, share: float = 0.05, l2: float = 1e-4) -> CoTrained:
    """Fit both views on labelled rows and let each label rows of the pool for the other.

    Every fifth labelled row is left out of the fits for the calibrations. A round gives each
    view the pool rows that the other is surest of, ``share`` of the pool for both classes
    together and in the classes' proportion; a row is taken once. With one class only, the
    scores are its smoothed share.
    """
    test = np.arange(len(y)) % 5 == 4
    fit = ~test
    if len(np.unique(y[fit])) < 2:
        prior = np.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 0.0
        return CoTrained(np.zeros(views[0].shape[1]), np.zeros(views[1].shape[1]), np.array([[0.0, prior]] * 2), np.array([0.5, 0.5, 0.0]))
    known_x, known_y = [v[fit] for v in views], [y[fit], y[fit]]
    free = np.ones(len(pool[0]), bool)
    weights = [_logistic(x, t, l2) for x, t in zip(known_x, known_y, strict=True)]
    ones = y[fit].mean()
    for _ in range(rounds):
        for view in (0, 1):
            z = pool[view] @ weights[view]
            n = int(len(z) * share)
            order = np.flatnonzero(free)[np.argsort(z[free], kind="stable")]
            low, high = int(round(n * (1 - ones))), int(round(n * ones))
            taken0, taken1 = order[:low], order[len(order) - min(high, len(order)) :]
            taken0, taken1 = taken0[z[taken0] < 0], taken1[z[taken1] > 0]
            taken = np.concatenate([taken0, taken1])
            free[taken] = False
            other = 1 - view
            known_x[other] = np.concatenate([known_x[other], pool[other][taken]])
            known_y[other] = np.concatenate([known_y[other], np.zeros(len(taken0)), np.ones(len(taken1))])
        weights = [_logistic(x, t, l2) for x, t in zip(known_x, known_y, strict=True)]
    held = test if len(np.unique(y[test])) == 2 else np.ones(len(y), bool)
    z = np.stack([v[held] @ w for v, w in zip(views, weights, strict=True)], axis=1)
    scales = np.stack([_logistic(np.column_stack([z[:, i], np.ones(len(z))]), y[held], 1e-3) for i in (0, 1)])
    both = _logistic(np.column_stack([z * scales[:, 0] + scales[:, 1], np.ones(len(z))]), y[held], 1e-3)
    return CoTrained(weights[0], weights[1], scales, both)


def _sample(docs: DataFrame, ids: DataFrame, doc_id: str, text: str, meta: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Both views and the labels of chosen rows (``_id``, ``_y``; of bounded number)."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(meta)])
    rows = rows.join(F.broadcast(ids), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = text_view(batch.column(0))
            b = meta_view([(c, batch.column(2 + i).to_pylist()) for i, c in enumerate(meta)])
            raw = [pa.array([row.tobytes() for row in x], pa.binary()) for x in (a, b)]
            yield pa.RecordBatch.from_arrays([*raw, batch.column(1), batch.column(2 + len(meta))], ["a", "b", "y", "id"])

    columns = rows.select("_text", "_y", *[f"_m{i}" for i in range(len(meta))], F.xxhash64("_id").alias("h"))
    got = columns.mapInArrow(run, "a binary, b binary, y int, id long").toPandas().sort_values(["id", "a"], kind="stable")
    views = [np.frombuffer(b"".join(got[c]), np.float32).reshape(len(got), d).astype(np.float64) for c, d in (("a", GRAM_DIMS + 12), ("b", META_DIMS))]
    return views, got["y"].to_numpy(np.float64)


def fit(
    docs: DataFrame, labels: DataFrame, label: str, meta: list[str], doc_id: str = "doc_id", text: str = "text",
    labelled_rows: int = LABELLED_ROWS, pool_rows: int = POOL_ROWS,
) -> CoTrained:
    """Learn from at most ``labelled_rows`` rows of ``labels`` and ``pool_rows`` rows without label.

    Both samples are chosen by a hash of the id, so reruns agree, and only their ids are
    broadcast. Rows without id or with a label other than 0 and 1 teach nothing.
    """
    bounded_batches(docs.sparkSession)
    own = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where(F.col("_id").isNotNull())
    first = lambda rows, n: rows.orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = written(first(own.where(F.col("_y").isin(0, 1)), labelled_rows), "quality-labels")
    ids = docs.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull())
    pool = written(first(ids.join(own.select("_id"), "_id", "left_anti"), pool_rows).withColumn("_y", F.lit(-1)), "quality-pool")
    views, y = _sample(docs, chosen.unionByName(pool), doc_id, text, meta)
    known = y >= 0
    return co_train([v[known] for v in views], y[known], [v[~known] for v in views])


def score(docs: DataFrame, model: CoTrained, meta: list[str], text: str = "text") -> DataFrame:
    """``docs`` without the text and with ``text_score``, ``meta_score`` and ``score``.

    A null or empty text, and null metadata, are scored like others.
    """
    bounded_batches(docs.sparkSession)
    added = ["text_score", "meta_score", "score"]
    kept = [c for c in docs.columns if c not in (text, *added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            found = model.scores(text_view(column(text)), meta_view([(c, column(c).to_pylist()) for c in meta]))
            yield pa.RecordBatch.from_arrays([*(column(c) for c in kept), *(pa.array(x, pa.float64()) for x in found.T)], [*kept, *added])

    schema = docs.select(*kept).schema
    for c in added:
        schema = schema.add(c, "double")
    return docs.select(*kept, text).mapInArrow(run, schema)
