"""Exact top-k search: tiled matrix products, a partial selection per tile, merged in a tree."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a query tile and of a corpus tile.
QUERY_ROWS = 1_024
SHARD_ROWS = 4_096


def finite(column: Column) -> Column:
    """True for arrays that are not null and hold finite numbers only."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return column.isNotNull() & ~bad


def integer_vectors(rows: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of every component, x as double; other rows take no part."""
    return rows.where(F.col(vec_id).isNotNull() & finite(F.col(vector))).select(
        F.col(vec_id).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"),
    )


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, best first."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in double precision where no sum can leave its exact range.

    Sums beyond the range of a long count as its end (and so tie there).
    """
    largest = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    most = largest[0] * largest[1] * max(1, a.shape[1])
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    end, wide = 2**63 - 1, b.T.astype(object)
    return np.concatenate([np.clip(a[i : i + 16].astype(object) @ wide, -end, end).astype(np.int64) for i in range(0, len(a), 16)])


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query_rows: int = QUERY_ROWS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The k best rows of ``corpus`` for each query by integer inner product.

    Both sides are (id long, v array<long>) as of ``integer_vectors``. Rows with the query's
    own id and vectors of another length are no candidates. A repeated query row is one query;
    repeated corpus rows are so many candidates. Components and scores beyond the range of a long count as its end. Returns query_id, rank (from 1), vec_id, score;
    a query with fewer than k candidates gets all, one without any has no row.

    Queries are dealt to tiles of about ``query_rows``; a corpus row is sent to each of them
    (their number is the queries' count over ``query_rows``), to one of its shards. Each tile
    is one matrix product that keeps k rows a query; the lists are then merged by groups of 32
    tiles, and those by the query. Only counts decide the number of tiles.
    """
    queries = queries.dropDuplicates(["id"])
    blocks = max(1, -(-queries.count() // query_rows))
    shards = max(1, -(-corpus.count() // shard_rows))
    query_block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    shard = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(shards)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("id", "v", query_block.alias("block"), each(shards).alias("shard"))
    # new names, as Spark prunes the columns of a table that is grouped together with itself
    right = corpus.select(F.col("id").alias("vec_id"), F.col("v").alias("vec"), each(blocks).alias("block"), shard.alias("shard"))

    def tile(key, a, b):
        out: list[tuple[np.ndarray, ...]] = []
        widths_b = b["vec"].map(len).to_numpy() if len(b) else np.zeros(0)
        for width, part in a.groupby(a["v"].map(len)) if len(a) and len(b) else ():
            other = b[widths_b == width]
            if not len(other) or not width:
                continue
            ids = other["vec_id"].to_numpy()
            scores = _products(np.stack(part["v"].to_list()), np.stack(other["vec"].to_list()))
            for own, row in zip(part["id"].tolist(), scores, strict=True):
                best = _best_but(own, row, ids, k)
                out.append((np.full(len(best), own), ids[best], row[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame({"query_id": columns[0], "vec_id": columns[1], "score": columns[2], "tile": key[1]})

    lists = left.groupBy("block", "shard").cogroup(right.groupBy("block", "shard"))
    found = lists.applyInPandas(tile, "query_id long, vec_id long, score long, tile int")
    by = [F.desc("score"), F.asc("vec_id")]
    if shards > 32:
        node = Window.partitionBy("query_id", F.expr("tile div 32")).orderBy(*by)
        found = found.withColumn("rank", F.row_number().over(node)).where(F.col("rank") <= k).drop("rank")
    root = Window.partitionBy("query_id").orderBy(*by)
    return found.withColumn("rank", F.row_number().over(root)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best_but(own: int, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """``best_of`` without the rows that have the query's own id."""
    mine = ids == own
    if not mine.any():
        return best_of(scores, ids, k)
    others = np.flatnonzero(~mine)
    return others[best_of(scores[others], ids[others], k)]
