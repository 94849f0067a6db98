"""Embeddings from text hashes and block similarity against a few query vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Default dimension and seed of the hash embedding.
DIMENSION = 384
SEED = 42

# Queries and corpus rows of one matrix product.
QUERY_BLOCK = 1024
SHARD_ROWS = 16_384

METRICS = ("cosine", "dot", "euclidean")


def hash_vector(text: str, dimension: int, prefix: str) -> np.ndarray:
    """Normal vector seeded by the first four bytes of sha256, scaled to length 1."""
    digest = hashlib.sha256((prefix + text).encode()).digest()
    seed = int.from_bytes(digest[:4], "little")
    vector = np.random.default_rng(seed).standard_normal(dimension)
    return vector / np.linalg.norm(vector)


def hash_embedding(dimension: int = DIMENSION, seed: int | None = None) -> Callable[[Column], Column]:
    """A provider: text column -> array<float> column. With a seed it is mixed in."""
    prefix = "" if seed is None else f"{seed}:"

    def of_texts(texts: pd.Series) -> np.ndarray:
        return np.array([hash_vector(t, dimension, prefix) for t in texts])

    return embedding_provider(of_texts)


def embedding_provider(of_texts: Callable[[pd.Series], np.ndarray]) -> Callable[[Column], Column]:
    """Wrap any batch function (texts -> matrix) as an Arrow column function."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            matrix = np.asarray(of_texts(texts), dtype=np.float32) if len(texts) else []
            yield pd.Series(list(matrix), index=texts.index, dtype=object)

    return embed


def _scores(block: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Similarity of every query (row) with every vector of the block (column)."""
    if metric == "euclidean":
        squares = (queries**2).sum(1)[:, None] + (block**2).sum(1)[None, :]
        distance = np.sqrt(np.maximum(squares - 2 * queries @ block.T, 0))
        return 1 / (1 + distance)
    dots = queries @ block.T
    if metric == "dot":
        return dots
    norms = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(block, axis=1)[None, :]
    return np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, equal scores by id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def scored(
    corpus: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK, shard: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, id, score, rank) of the k nearest corpus vectors per query.

    Both sides stay tables: queries are dealt to tiles of about ``block``, corpus rows to
    shards of about ``shard``, and each pair of them is one matrix product in a task of its
    own that keeps its k best per query. So what is shuffled afterwards is small, and more
    queries or rows mean more tasks and not a larger plan.
    """
    if metric not in METRICS:
        raise ValueError(f"unsupported metric: {metric}")
    wanted = queries.select(F.col("query_id").cast("string"), F.col("embedding").alias("query"))
    vectors = corpus.where(F.col("embedding").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("vector"))
    n_blocks, n_shards = max(1, -(-wanted.count() // block)), max(1, -(-vectors.count() // shard))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = wanted.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("tile"), each(n_shards).alias("shard"))
    right = vectors.select("*", each(n_blocks).alias("tile"), F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int").alias("shard"))

    def tile(a, b):
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": object, "id": object, "score": float})
        names, ids = a["query_id"].to_numpy(dtype=object), b["id"].to_numpy(dtype=object)
        rows, matrix = (np.stack(c.to_numpy()).astype(np.float64) for c in (b["vector"], a["query"]))
        # Rounding makes equal vectors tie, whatever tile they are in.
        scores = np.round(_scores(rows, matrix, metric), 12)
        best = [_top(ids, s, k) for s in scores]
        return pd.DataFrame({
            "query_id": np.repeat(names, [len(x) for x in best]),
            "id": np.concatenate([ids[x] for x in best]),
            "score": np.concatenate([s[x] for s, x in zip(scores, best)]),
        })

    parts = left.groupBy("tile", "shard").cogroup(right.groupBy("tile", "shard")).applyInPandas(
        tile, "query_id string, id string, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mean_cosine(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, pairs, mean_score): over all corpus vectors, without any pair of vectors.

    The mean of the cosines with a query is the query's unit vector times the mean of the
    corpus' unit vectors; a zero vector has the cosine 0.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = lambda c: F.transform(c, lambda x: F.when(norm(c) > 0, x.cast("double") / norm(c)).otherwise(0.0))
    rows = corpus.where(F.col("embedding").isNotNull())
    sums = rows.select(F.posexplode(unit(F.col("embedding")))).groupBy("pos").agg(F.sum("col").alias("total"))
    mean = sums.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "total"))), lambda x: x["total"]))  # one row per dimension
    n = rows.agg(F.count(F.lit(1)))
    dot = F.aggregate(F.zip_with(unit(F.col("embedding")), F.col("_mean"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return queries.withColumn("_mean", mean.scalar()).withColumn("pairs", n.scalar()).select(
        F.col("query_id").cast("string"), "pairs", (dot / F.col("pairs")).alias("mean_score")
    )
