"""Vector code compression: codebooks of vector parts by Lloyd's rounds over two trees.

Vectors of integers are cut into equal parts; each part position has a codebook. The parts of
a block of vectors at one position lie in a tree of boxes, whose nodes know their range of
rows and the sum of their components; the entries of the codebook lie in a small tree of boxes
as well. A round walks both trees together, level by level: of all pairs of a part node and an
entry node, those go whose smallest distance is above the largest distance to another entry
node. A part node with one entry left is assigned as a whole, by its cached sum and count.
Leaves with several entries left are uncertain: their rows are compared with these entries in
integers. Bounds are integers too, and only strictly worse entries are dropped, so assignments
are exact, ties included.

The blocks with their trees are written once and read in every round. A round returns one row
per block, position and entry, combined before the shuffle; the driver holds the codebooks
only, whose size does not depend on the data.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import join_per_key
from .batches import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and rows of a leaf of its trees; only time and memory depend on them.
BLOCK_ROWS = 8_192
LEAF_ROWS = 16


@dataclass
class Tree:
    """Boxes over the rows of one position of a block, level by level from the root.

    ``order`` has the rows in tree order; a level has the bounds of its nodes in this order
    and their least and greatest components and sums.
    """

    order: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def limit(width: int) -> int:
    """Greatest component for which squared distances of whole vectors fit into 62 bits."""
    return int((2.0**62 / max(width, 1)) ** 0.5) // 2


def integers(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); beyond ``limit`` the limit stands for a component."""
    most = limit(vectors.shape[1])
    return np.clip(np.floor(scale * vectors), -most, most).astype(np.int64)


def cuts(width: int, parts: int) -> list[int]:
    """Bounds of the parts, as equal as the width allows."""
    return [width * i // parts for i in range(parts + 1)]


def build_tree(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Halve the rows at the median of their widest component until leaves are small."""
    order = np.arange(len(points))
    bounds = np.array([0, len(points)])
    levels = []
    while True:
        low = np.minimum.reduceat(points[order], bounds[:-1])
        high = np.maximum.reduceat(points[order], bounds[:-1])
        levels.append((bounds, low, high, np.add.reduceat(points[order], bounds[:-1])))
        if np.diff(bounds).max() <= leaf_rows:
            return Tree(order, levels)
        node = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        widest = (high - low).argmax(axis=1)
        order = order[np.lexsort((points[order, widest[node]], node))]
        bounds = np.concatenate([[0], np.stack([(bounds[:-1] + bounds[1:]) // 2, bounds[1:]], axis=1).reshape(-1)])


def entry_tree(entries: np.ndarray) -> list[list[list[int]]]:
    """Levels of groups of entries: all, halves at the median of the widest component, ..., single ones."""
    levels = [[list(range(len(entries)))]]
    while any(len(g) > 1 for g in levels[-1]):
        below = []
        for group in levels[-1]:
            if len(group) == 1:
                below.append(group)
                continue
            points = entries[group]
            widest = int(np.ptp(points, axis=0).argmax())
            ranked = [group[i] for i in np.argsort(points[:, widest], kind="stable")]
            below += [sorted(ranked[: len(group) // 2]), sorted(ranked[len(group) // 2 :])]
        levels.append(below)
    return levels


def _box_distances(low: np.ndarray, high: np.ndarray, e_low: np.ndarray, e_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of each pair of boxes."""
    above, below = e_low[None] - high[:, None], low[:, None] - e_high[None]
    near = np.maximum(np.maximum(above, below), 0)
    far = np.maximum(-above, -below)
    return (near * near).sum(axis=2), (far * far).sum(axis=2)


class Assignment:
    """The nearest entry of every row of one tree (ties: lower index), found node by node."""

    def __init__(self, tree: Tree, points: np.ndarray, entries: np.ndarray, with_codes: bool):
        self.sums = np.zeros(entries.shape, np.int64)
        self.counts = np.zeros(len(entries), np.int64)
        self.codes = np.zeros(len(points), np.uint8) if with_codes else None
        self.compared = 0  # rows times entries that were compared one by one
        self.tree, self.points, self.entries = tree, points, entries
        self._walk()

    def _walk(self) -> None:
        groups = entry_tree(self.entries)
        last = len(self.tree.levels) - 1
        nodes = np.array([0])
        alive = np.ones((1, 1), bool)  # part nodes x entry groups of the level
        for depth in range(max(last + 1, len(groups))):
            level = min(depth, len(groups) - 1)
            if 0 < depth < len(groups):
                alive = alive[:, self._parents(groups[depth - 1], groups[depth])]
            bounds, low, high, sums = self.tree.levels[min(depth, last)]
            e_low = np.stack([self.entries[g].min(axis=0) for g in groups[level]])
            e_high = np.stack([self.entries[g].max(axis=0) for g in groups[level]])
            near, far = _box_distances(low[nodes], high[nodes], e_low, e_high)
            far[~alive] = np.iinfo(np.int64).max
            alive &= near <= far.min(axis=1)[:, None]
            single = np.array([len(g) == 1 for g in groups[level]])
            sure = (alive.sum(axis=1) == 1) & (alive & single).any(axis=1)
            self._whole(nodes[sure], alive[sure].argmax(axis=1), groups[level], bounds, sums)
            nodes, alive = nodes[~sure], alive[~sure]
            if not len(nodes):
                return
            if depth < last:
                nodes, alive = np.stack([2 * nodes, 2 * nodes + 1], axis=1).reshape(-1), np.repeat(alive, 2, axis=0)
        self._leaves(nodes, alive, groups[-1], bounds)

    @staticmethod
    def _parents(above: list[list[int]], below: list[list[int]]) -> list[int]:
        owner = {e: i for i, g in enumerate(above) for e in g}
        return [owner[g[0]] for g in below]

    def _whole(self, nodes: np.ndarray, group: np.ndarray, groups: list[list[int]], bounds: np.ndarray, sums: np.ndarray) -> None:
        if not len(nodes):
            return
        entry = np.array([g[0] for g in groups])[group]
        np.add.at(self.sums, entry, sums[nodes])
        np.add.at(self.counts, entry, bounds[nodes + 1] - bounds[nodes])
        if self.codes is not None:
            for a, b, e in zip(bounds[nodes].tolist(), bounds[nodes + 1].tolist(), entry.tolist(), strict=True):
                self.codes[self.tree.order[a:b]] = e

    def _leaves(self, nodes: np.ndarray, alive: np.ndarray, groups: list[list[int]], bounds: np.ndarray) -> None:
        """Compare the rows of uncertain leaves with the entries that are left, in integers."""
        single = np.array([g[0] for g in groups])
        far = np.iinfo(np.int64).max
        # Leaves with the same entries left are compared together.
        _, kind = np.unique(alive, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        for k in range(kind.max() + 1):
            mine = nodes[kind == k]
            entry = np.sort(single[alive[np.flatnonzero(kind == k)[0]]])
            rows = np.concatenate([self.tree.order[a:b] for a, b in zip(bounds[mine].tolist(), bounds[mine + 1].tolist(), strict=True)])
            points = self.points[rows]
            best, code = np.full(len(rows), far), np.zeros(len(rows), np.int64)
            for e in entry.tolist():
                diff = points - self.entries[e]
                d = np.einsum("ij,ij->i", diff, diff)
                code[d < best] = e
                best = np.minimum(best, d)
            self.compared += len(rows) * len(entry)
            np.add.at(self.sums, code, points)
            self.counts += np.bincount(code, minlength=len(self.counts))
            if self.codes is not None:
                self.codes[rows] = code


def _packed(tree: Tree) -> list[bytes]:
    """order, depth and the nodes of all levels as bytes; ``_unpacked`` is the inverse."""
    columns = [np.concatenate([level[i].reshape(-1) for level in tree.levels]) for i in range(4)]
    return [tree.order.astype(np.int32).tobytes(), *[c.astype(np.int64).tobytes() for c in columns]]


def _unpacked(order: bytes, bounds: bytes, low: bytes, high: bytes, sums: bytes, width: int) -> Tree:
    order, bounds = np.frombuffer(order, np.int32), np.frombuffer(bounds, np.int64)
    nodes = [np.frombuffer(x, np.int64).reshape(-1, width) for x in (low, high, sums)]
    levels, at, n = [], 0, 1
    while at + n <= len(nodes[0]):
        begin = at + len(levels)
        levels.append((bounds[begin : begin + n + 1], *[x[at : at + n] for x in nodes]))
        at, n = at + n, 2 * n
    return Tree(order, levels)


def kept_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is neither null nor empty and holds finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad)


def _block_schema(rows: DataFrame) -> T.StructType:
    schema = T.StructType([T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("id", "label")])
    return schema.add("points", "binary").add("trees", T.ArrayType(T.BinaryType()))


def tree_blocks(rows: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """(id, label, vector) as blocks of vectors in integers, with a tree per part position."""
    at, schema = cuts(width, parts), _block_schema(rows)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(batches).combine_chunks()
        values = held.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False)
        whole = integers(np.asarray(values, np.float64).reshape(-1, width), scale)
        trees = [x for i in range(parts) for x in _packed(build_tree(np.ascontiguousarray(whole[:, at[i] : at[i + 1]])))]
        lists = [pa.ListArray.from_arrays([0, held.num_rows], held.column(c).chunk(0)) for c in ("id", "label")]
        data = [pa.array([whole.astype(np.int32).tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays([*lists, *data], ["id", "label", "points", "trees"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                piece = batch.slice(0, BLOCK_ROWS - n)
                batch = batch.slice(piece.num_rows)
                held.append(piece)
                n += piece.num_rows
                if n == BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return rows.mapInArrow(build, schema)


def _assigned(batch: pa.RecordBatch, books: list[np.ndarray], with_codes: bool) -> Iterator[tuple[int, np.ndarray, list[Assignment]]]:
    """(row of the batch, its vectors, one assignment per part position)."""
    at = np.cumsum([0, *[b.shape[1] for b in books]])
    for i in range(batch.num_rows):
        whole = np.frombuffer(batch.column("points")[i].as_buffer(), np.int32).reshape(-1, at[-1]).astype(np.int64)
        packed = [np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column("trees")[i].values]
        out = []
        for k, book in enumerate(books):
            tree = _unpacked(*packed[5 * k : 5 * k + 5], width=book.shape[1])
            out.append(Assignment(tree, np.ascontiguousarray(whole[:, at[k] : at[k + 1]]), book, with_codes))
        yield i, whole, out


def next_codebooks(blocks: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the mean, rounded down, of the parts that are nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(b), b.shape[1] + 2), object) for b in books]
        for batch in batches:
            for _, _, found in _assigned(batch, books, with_codes=False):
                for total, one in zip(totals, found, strict=True):
                    total[:, 0] += one.counts
                    total[:, 1] += one.compared
                    total[:, 2:] += one.sums
        rows = [(p, e, j, Decimal(int(x))) for p, t in enumerate(totals) for e in range(len(t)) for j, x in enumerate(t[e])]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["part", "entry", "at", "total"])

    partial = blocks.select("points", "trees").mapInArrow(run, "part int, entry int, at int, total decimal(38,0)")
    # As many rows as the codebooks have components, whatever the data.
    summed = {(r["part"], r["entry"], r["at"]): int(r["total"]) for r in partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect()}
    out = []
    for p, book in enumerate(books):
        book = book.copy()
        for e in range(len(book)):
            if n := summed[p, e, 0]:
                book[e] = [summed[p, e, 2 + j] // n for j in range(book.shape[1])]
        out.append(book)
    return out


def codes_of(blocks: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(id, label, code, error) of every vector: hexadecimal entry numbers, squared distance."""
    schema = T.StructType([T.StructField(c, blocks.schema[c].dataType.elementType) for c in ("id", "label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, whole, found in _assigned(batch, books, with_codes=True):
                codes = np.stack([one.codes for one in found], axis=1)
                diff = whole - np.concatenate([b[codes[:, k]] for k, b in enumerate(books)], axis=1)
                digits = codes.tobytes().hex()
                step = 2 * len(books)
                shown = [digits[j : j + step] for j in range(0, len(digits), step)]
                keys = [batch.column(c)[i].values for c in ("id", "label")]
                error = np.einsum("ij,ij->i", diff, diff)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(shown, pa.string()), pa.array(error)], ["id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema.add("code", "string").add("error", "long"))


def compress(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per kept vector: the key, code, error, label_error and codebooks_sha256.

    Left out are vectors that are null or empty, that hold null or non-finite components, and
    those whose length differs from that of the smallest kept key. Codebooks start as the parts
    of the ``entries`` smallest kept keys (fewer, if there are fewer rows; null keys last, rows
    with the same key by their vector); up to 256 entries. Entries that no part is nearest to
    stay. label_error sums the error over equal labels, nulls together (null beyond 64 bits).
    Components beyond ``limit`` count as the limit, so that no distance overflows. Widths that
    ``parts`` does not divide give parts that differ by one in width.
    """
    spark = vectors.sparkSession
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits per part, so at most 256 entries")
    rows = kept_vectors(vectors, vector).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    first = [F.col("id").asc_nulls_last(), "vector"]
    head = rows.orderBy(*first).limit(entries).collect()
    width = len(head[0]["vector"]) if head else 1
    rows = rows.where(F.size("vector") == width)
    if any(len(r["vector"]) != width for r in head):
        head = rows.orderBy(*first).limit(entries).collect()
    start = integers(np.asarray([r["vector"] for r in head], np.float64).reshape(-1, width), scale)
    at = cuts(width, parts)
    books = [np.ascontiguousarray(start[:, at[i] : at[i + 1]]) for i in range(parts)]
    _small_batches(spark)
    blocks = written(tree_blocks(rows, width, parts, scale), "tree-blocks")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # a block is a few MB
    if head:
        for _ in range(rounds):
            books = next_codebooks(blocks, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()
    coded = written(codes_of(blocks, books), "vector-codes")
    _small_batches(spark)
    keys = [F.col("label").isNull().alias("_none"), F.coalesce("label", F.lit(0).cast(vectors.schema[label].dataType)).alias("_label")]
    keyed = coded.select("*", *keys)
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")
    per_label = keyed.groupBy("_none", "_label").agg(total)
    return join_per_key(keyed, per_label, ["_none", "_label"]).select(
        F.col("id").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )


def _small_batches(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
