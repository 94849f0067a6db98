"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import bounded_batches, column_name, flat, steps, written

N_GRAMS = (3, 4, 5)
BITS = 18
#: Labelled rows that the model is fitted on at most, taken by a hash of their id.
TRAINING_ROWS = 20_000
#: n-grams with the largest log-count ratios that the linear model gets.
SELECTED = 30_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def training_half(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows whose labels may be learned: crc32 of the id as text modulo ``folds`` is not 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds != 0, F.lit(True))


def _grams(data: np.ndarray) -> list[np.ndarray]:
    """The hashed n-gram that starts at each byte, for each n."""
    wide = data.astype(np.uint64)
    out, code = [], np.zeros(len(data), np.uint64)
    for n in range(max(N_GRAMS)):
        part = wide[n:]
        code = (code[: len(part)] << np.uint64(8)) | part
        if n + 1 in N_GRAMS:
            h = (code + np.uint64(n + 1 << 56)) * _MULTIPLIER
            out.append((h >> np.uint64(64 - BITS)).astype(np.int32))
    return out


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[list(b"\t\n\v\f\r")] = 0x20


def documents_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of every text, lower-cased, white space as blanks.

    A null or empty text has the n-grams of a blank text only, i.e. none.
    """
    seen = np.zeros(1 << BITS, np.int32)
    data, bounds = flat(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())))
    for a, b in steps(bounds):
        part = _PLAIN[data[bounds[a] : bounds[b]]]
        grams = _grams(part)
        for i in range(a, b):
            lo, hi = bounds[i] - bounds[a], bounds[i + 1] - bounds[a]
            own = np.concatenate([g[lo : max(lo, hi - n + 1)] for n, g in zip(N_GRAMS, grams, strict=True)])
            order = np.arange(len(own), dtype=np.int32)
            seen[own] = order
            yield own[seen[own] == order]


@dataclass
class ToxicityModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of a text's distinct n-grams)))."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = np.array([self.weights[f].sum(dtype=np.float64) for f in documents_features(texts)] or [], np.float64)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -500, 500)))


def _logistic(
    column: np.ndarray, lengths: np.ndarray, y: np.ndarray, scale: np.ndarray, rounds: int, l2: float
) -> tuple[np.ndarray, float]:
    """Weights of binary features times ``scale`` by full gradient steps (Adam) that get shorter."""
    n = len(lengths)
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)
    w, bias = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(row, (scale * w).astype(np.float32)[column], n) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - y
        grad = scale * np.bincount(column, error.astype(np.float32)[row], len(scale)) / max(1, n) + l2 * w
        grad = np.append(grad, error.mean() if n else 0.0)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.1 / np.sqrt(1 + t / 5) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        bias -= step[-1]
    return w, float(bias)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    most_rows: int = TRAINING_ROWS,
    rounds: int = 250,
    strength: float = 1.0,
    most_grams: int = SELECTED,
) -> ToxicityModel:
    """Learn from at most ``most_rows`` labelled rows, all that ``labels`` holds if there are fewer.

    ``labels`` must not hold rows that are kept for testing. Rows without id or with a label
    other than 0 and 1 teach nothing; repeated rows count as often as they occur. Without any
    label, or with one class only, every score is the smoothed share of label 1.

    ``strength`` is the weight of the ridge penalty against the sum over the rows' losses, so few
    rows give a careful model. The rows are chosen by a hash of the id. Their ids (16 bytes each) are what is broadcast;
    of the n-grams seen three times, the ``most_grams`` with the largest ratios reach the model;
    counts of n-grams are summed by Spark, and the driver gets one row per hashed n-gram and,
    of the chosen rows, the selected n-grams.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    chosen = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(most_rows)
    )
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    sample = written(rows.join(F.broadcast(chosen), "_id"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            for y, f in zip(batch.column(1).to_pylist(), documents_features(batch.column(0)), strict=True):
                found[y, f] += 1
        at = np.flatnonzero(found.any(0))
        for a in range(0, len(at), 20_000):
            part = at[a : a + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (part, found[0, part], found[1, part])], ["f", "n0", "n1"])

    totals = (
        sample.select("_text", "_y").mapInArrow(count, "f long, n0 long, n1 long").groupBy("f")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    )
    share = {r["_y"]: r["n"] for r in sample.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    if not n0 or not n1:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), float(np.log((n1 + 1) / (n0 + 1))))
    in0, in1 = totals["n0"].to_numpy(), totals["n1"].to_numpy()
    ratio = np.log((in1 + 1) / (n1 + 2)) - np.log((in0 + 1) / (n0 + 2))
    often = in0 + in1 >= 3
    order = np.argsort(-np.abs(ratio) * often, kind="stable")[:most_grams]
    order = order[often[order]]
    feature, ratio = totals["f"].to_numpy()[order], ratio[order]
    place = np.full(1 << BITS, -1, np.int32)
    place[feature] = np.arange(len(feature))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(p := place[f])[p >= 0] for f in documents_features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column(1)], ["f", "y"])

    taught = sample.select("_text", "_y").mapInArrow(select, "f array<int>, y int").toArrow()
    lists = taught.column("f").combine_chunks()
    column, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    y = taught.column("y").to_numpy().astype(np.float64)
    del taught, lists
    w, bias = _logistic(column, lengths, y, ratio, rounds, strength / len(y))
    weights = np.zeros(1 << BITS, np.float32)
    weights[feature] = w * ratio
    return ToxicityModel(weights, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without the text and with ``out``, the probability of label 1.

    Null and empty texts get the model's prior. No other column is an input.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.scores(batch.column(batch.num_columns - 1)), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*kept, out])

    return docs.select(*kept, text).mapInArrow(run, docs.select(*kept).schema.add(out, "double"))


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose score is below ``threshold``, with all their columns."""
    out = column_name(docs, "toxicity")
    bounded_batches(docs.sparkSession)
    names = [*docs.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(model.scores(batch.column(batch.schema.get_field_index(text))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names)

    scored = docs.mapInArrow(run, docs.select("*").schema.add(out, "double"))
    return scored.where(F.col(out) < threshold).drop(out)
