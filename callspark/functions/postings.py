"""Inverted index of the words of documents, in shards that stay where their documents are.

A shard is one row: the ids of a few thousand documents, their distinct words and, per word,
the numbers of the documents that hold it. Inside a task the words of a shard are found by
what they contain: every run of one, two or three letters has the list of the words it occurs
in, and a searched word is looked up by its rarest run of three. Lists are never joined as
rows, so a word that nearly every document holds costs no more than the documents without it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import new_folder

#: Documents of a shard, and bytes of its documents beyond which it is closed before.
SHARD_DOCS, SHARD_BYTES = 4_096, 1 << 24
#: Queries that one task holds; the index is shipped once for so many.
TILE = 16_384
MOST_TASKS = 20_000
INDEX_SCHEMA = "ids array<string>, terms binary, ends binary, docs binary"
#: Code points need 21 bits, so three of them fit into one number.
_BITS = 21


def keyword_index(documents: DataFrame, id_: str = "id", text: str = "document") -> DataFrame:
    """One row per shard of documents, whose words are separated by blanks (null: none). No shuffle."""

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ids, texts = (c.combine_chunks() for c in pa.Table.from_batches(held).columns)
        # Arrow's white space is that of Unicode, like the blanks of functions.text.
        split = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
        doc = np.repeat(np.arange(len(ids)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
        words = split.flatten()
        some = pc.not_equal(words, "")
        coded = words.filter(some).dictionary_encode()
        one = lambda column: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column.cast(pa.string()))
        pairs = np.sort(coded.indices.to_numpy().astype(np.int64) << 32 | doc[some.to_numpy(zero_copy_only=False)])
        pairs = pairs[np.diff(pairs, prepend=-1) != 0]
        ends = np.cumsum(np.bincount(pairs >> 32, minlength=len(coded.dictionary)))
        lists = [pa.array([x], pa.binary()) for x in (ends.astype(np.int64).tobytes(), pairs.astype(np.int32).tobytes())]
        terms = pc.binary_join(one(coded.dictionary), " ").cast(pa.binary())
        return pa.RecordBatch.from_arrays([one(ids), terms, *lists], ["ids", "terms", "ends", "docs"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size = [], 0, 0
        for batch in batches:
            start = 0
            for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 1):
                docs, size = docs + 1, size + n
                if docs >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield shard([*held, batch.slice(start, i - start)])
                    held, docs, size, start = [], 0, 0, i
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield shard(held)

    return documents.select(F.col(id_).cast("string"), F.lower(text)).mapInArrow(build, INDEX_SCHEMA)


class Words:
    """The distinct words of a shard, found by the letters that they contain."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        sizes = np.array([len(t) for t in terms], np.int64)
        points = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(terms)), sizes)
        self.runs = {}
        self.marked = np.zeros(len(terms), bool)
        code = np.zeros(len(points), np.int64)
        for n in (1, 2, 3):
            fits = max(0, len(points) - n + 1)
            code = code[:fits] << _BITS | points[len(points) - fits :]
            inside = owner[:fits] == owner[len(points) - fits :]
            word = owner[:fits][inside]
            kind, keys = pd.factorize(code[inside])
            # Few kinds of runs are told apart by two bytes, which are sorted much sooner.
            order = np.argsort(kind.astype(np.uint16) if len(keys) <= 1 << 16 else kind, kind="stable")
            kind, word = kind[order], word[order]  # the words of a run ascend
            new = np.ones(len(kind), bool)
            new[1:] = (kind[1:] != kind[:-1]) | (word[1:] != word[:-1])
            bounds = np.append(0, np.cumsum(np.bincount(kind[new], minlength=len(keys))))
            self.runs[n] = (dict(zip(keys.tolist(), range(len(keys)), strict=True)), bounds, word[new])

    def _list(self, run: str) -> np.ndarray:
        keys, bounds, word = self.runs[len(run)]
        code = 0
        for c in run:
            code = code << _BITS | ord(c)
        at = keys.get(code)
        return word[:0] if at is None else word[bounds[at] : bounds[at + 1]]

    def holding(self, word: str) -> np.ndarray:
        """Numbers of the terms that ``word`` is a part of."""
        if len(word) <= 3:
            return self._list(word)
        lists = sorted((self._list(run) for run in {word[i : i + 3] for i in range(len(word) - 2)}), key=len)
        found = lists[0]
        for other in lists[1:]:
            if len(other) > 12 * len(found):  # then comparing the words takes less time
                break
            self.marked[found] = True
            both = other[self.marked[other]]
            self.marked[found] = False
            found = both
        return np.array([i for i in found.tolist() if word in self.terms[i]], np.int64)


class Shard:
    """An index row, ready to be searched."""

    def __init__(self, ids: np.ndarray, terms: bytes, ends: bytes, docs: bytes):
        self.ids, self.words = ids, Words(terms.decode().split(" ") if terms else [])
        self.bounds = np.append(0, np.frombuffer(ends, np.int64))
        self.docs = np.frombuffer(docs, np.int32)
        self.known: dict[str, tuple[bool, np.ndarray]] = {}

    def documents(self, word: str) -> tuple[bool, np.ndarray]:
        """(True, documents with the word) or, if most have it, (False, documents without)."""
        if word not in self.known:
            found = np.zeros(len(self.ids), bool)
            held = self.words.holding(word)
            start, size = self.bounds[held], self.bounds[held + 1] - self.bounds[held]
            before = np.cumsum(size) - size
            found[self.docs[np.arange(size.sum()) + np.repeat(start - before, size)]] = True
            rare = bool(2 * np.count_nonzero(found) <= len(found))
            self.known[word] = rare, np.flatnonzero(found if rare else ~found)
        return self.known[word]

    def counts(self, words: list[str]) -> np.ndarray:
        """Per document how many of the words, repeats included, it holds."""
        out, everywhere = np.zeros(len(self.ids), np.int64), 0
        for word in words:
            rare, docs = self.documents(word)
            if rare:
                out[docs] += 1
            else:
                everywhere += 1
                out[docs] -= 1
        return out + everywhere


def search(index: DataFrame, queries: DataFrame, k: int, tile: int = TILE) -> DataFrame:
    """(query_id, id, score, rank): the k documents with the largest share of the query's words.

    ``queries`` has query_id and ``words`` (repeats count). Score is the share of the words that
    are part of a word of the document; documents without one are no hits, ties go by id. Each
    task searches one part of the index for one tile of the queries and returns its k best per
    query, so neither postings nor hits of frequent words are shuffled.
    """
    wanted = queries.select(F.col("query_id").cast("string"), "words").where(F.size("words") > 0)
    path = new_folder(index.sparkSession, "keyword-index")
    index.write.parquet(path)
    index = index.sparkSession.read.schema(index.schema).parquet(path)
    # One number per shard, by its first id.
    numbers = index.select(F.get("ids", F.lit(0)).alias("first")).distinct()
    numbers = numbers.withColumn("part", F.row_number().over(Window.orderBy("first")) - 1)
    n_tiles, n_parts = max(1, -(-wanted.count() // tile)), max(1, index.count())
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Tasks are numbered, as their work does not show in the bytes that adaptive execution sees.
    tasks = min(4 * n_tiles * n_parts, MOST_TASKS)
    left = wanted.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_tiles)).cast("int").alias("tile"), each(n_parts).alias("part")).repartition(tasks, "tile", "part")
    numbered = index.join(numbers, F.get("ids", F.lit(0)).eqNullSafe(F.col("first"))).drop("first")
    right = numbered.select("*", each(n_tiles).alias("tile")).repartition(tasks, "tile", "part")

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": object, "id": object, "score": float})]
        asked = list(zip(a["query_id"], a["words"], strict=True))
        for row in b.itertuples():
            shard = Shard(np.asarray(row.ids, object), row.terms, row.ends, row.docs)
            for query_id, words in asked:
                counts = shard.counts(list(words))
                if len(counts) > k:  # not below the k-th best
                    at = np.flatnonzero(counts >= max(1, np.partition(counts, len(counts) - k)[len(counts) - k]))
                else:
                    at = np.flatnonzero(counts)
                at = at[np.lexsort((shard.ids[at].astype(str), -counts[at]))[:k]]
                out.append(pd.DataFrame({"query_id": query_id, "id": shard.ids[at], "score": counts[at] / len(words)}))
        return pd.concat(out, ignore_index=True)

    parts = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInPandas(best, "query_id string, id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
