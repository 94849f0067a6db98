"""Packing documents into sequences of bounded length by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches, column_name, written
from .tokens import tokenizer

#: Pieces that one task packs together; more of them leave no less padding.
GROUP_PIECES = 20_000


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree.

    A leaf of the tree is a capacity and holds how many open windows have just that much
    room; an inner node holds the sum of its leaves. The tightest window that takes a piece
    is the first non-empty leaf at or right of the piece's length.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, window) of the tightest open window with at least ``least`` room, removed."""
        count, node = self.count, least + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):  # up, until a right neighbour has windows
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.windows[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of every piece; lengths are from 1 to ``capacity``."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_windows, n = OpenWindows(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = open_windows.take(length)
        if found is None:
            found, n = (capacity, n), n + 1
        room, window[i] = found
        offset[i] = capacity - room
        if room > length:
            open_windows.add(room - length, int(window[i]))
    return window, offset


def cut_pieces(
    docs: DataFrame, path: str, end_id: int | None, capacity: int, text: str = "text", with_ids: bool = False
) -> DataFrame:
    """One row per piece: the columns of ``docs`` but the text, ``start``, ``length``,
    ``ids_crc32``, ``doc_tokens`` and, on demand, the piece's ``token_ids``.

    A document (null text: empty) is cut into full windows and one remainder; a document
    without any id has no piece. Columns of these names are replaced.
    """
    bounded_batches(docs.sparkSession)
    added = ["start", "length", "ids_crc32", "doc_tokens"]
    kept = [c for c in docs.columns if c not in (text, *added, "token_ids")]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist()
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, part in enumerate(words.encode(texts)):
                part += end
                for at in range(0, len(part), 4 * capacity):
                    piece = part[at : at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(part) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<i4"))
            columns = [batch.column(batch.schema.get_field_index(c)).take(pa.array(row, pa.int64())) for c in kept]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            names = [*kept, *added]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names = [*names, "token_ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = docs.select(*kept).schema
    for c in added:
        schema = schema.add(c, "long")
    if with_ids:
        schema = schema.add("token_ids", T.ArrayType(T.IntegerType()))
    return docs.select(*kept, text).mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece (``length`` from 1 to ``capacity``) a ``sequence_id`` and an ``offset``.

    A piece that fills a window is a sequence of its own. All others are dealt to groups of
    about ``group_pieces`` by a hash of the row and its number, so that repeated rows spread like
    others, and each group is packed by best-fit decreasing; only their number of rows decides the number of groups. Equal pieces may end
    up in any order among themselves. Columns of the two names are replaced. ``sequence_id`` is group * 2^40 + window.

    The pieces are written to the shared folder first, as they are read twice.
    """
    pieces = written(pieces.drop("offset", "sequence_id"), "pieces")
    full = F.col("length") >= capacity
    n = pieces.where(~full).count()
    groups = max(1, -(-n // group_pieces))
    group = column_name(pieces, "group_no")
    rest = pieces.where(~full).withColumn(group, F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        window, offset = best_fit_decreasing(pdf["length"].to_numpy(np.int64), capacity)
        numbers = pdf.pop(group).to_numpy(np.int64)
        return pdf.assign(sequence_id=(numbers << 40) + window, offset=offset)

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    alone = pieces.where(full).select(
        "*",
        (F.lit(groups) * F.lit(1 << 40) + F.monotonically_increasing_id()).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return rest.groupBy(group).applyInPandas(run, schema).select(*schema.names).unionByName(alone)


def sequences(packed: DataFrame, capacity: int, pad_id: int) -> DataFrame:
    """The padded sequences of pieces with ``token_ids``: ``sequence_id``, ``n_tokens``, ``token_ids``.

    A sequence is filled up to ``capacity`` with ``pad_id``, but not if its length is a power of two.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "token_ids")))
    ids = F.flatten(F.transform(ordered, lambda x: x["token_ids"]))
    n = F.size("token_ids")
    whole = n.bitwiseAND(n - 1) == 0
    return (
        packed.groupBy("sequence_id")
        .agg(ids.alias("token_ids"))
        .select(
            "sequence_id",
            n.alias("n_tokens"),
            F.when(whole, F.col("token_ids"))
            .otherwise(F.concat("token_ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - n)))
            .alias("token_ids"),
        )
    )
