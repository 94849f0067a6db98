"""Fill-in-middle transformation of texts by rotations in place, and its exact inverse.

A text is cut into prefix, middle and suffix at two line ends. It is laid out once in a
bytearray with a sentinel before each part, and the parts change places by rotations: two
neighbouring segments swap by reversing each and then both. The inverse finds the sentinels,
turns the rotations back and takes the sentinels out, so every text is restored byte by byte.

All work is on UTF-8 bytes; a text is never decoded. A line end is one byte in UTF-8, and
sentinels of which none overlaps with itself or another cannot arise at a seam of two parts,
so the only ones in an output are those that were put there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches, column_name, flat

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that a reversal holds beside the text.
_SWAP = 1 << 16
PLAIN, PSM, SPM = "plain", "psm", "spm"


def check_sentinels(sentinels: tuple[bytes, bytes, bytes]) -> None:
    """The inverse needs different sentinels, none of which can overlap with another."""
    marks = set(sentinels)
    seams = any(a.endswith(b[:i]) for a in marks for b in marks for i in range(1, len(b)))
    if len(marks) < 3 or b"" in marks or seams or any(a != b and a in b for a in marks for b in marks):
        raise ValueError(f"sentinels {sentinels!r} are empty, alike or can overlap")


def reverse(buffer: bytearray, start: int, end: int) -> None:
    """Reverse ``buffer[start:end]`` in place, a bounded piece from either end at a time."""
    view = np.frombuffer(buffer, np.uint8)
    while end - start > 1:
        n = min(_SWAP, (end - start) // 2)
        left = view[start : start + n].copy()
        view[start : start + n] = view[end - n : end][::-1]
        view[end - n : end] = left[::-1]
        start, end = start + n, end - n


def rotate(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Let ``buffer[start:cut]`` and ``buffer[cut:end]`` change places."""
    reverse(buffer, start, cut)
    reverse(buffer, cut, end)
    reverse(buffer, start, end)


def line_ends(data: bytes) -> np.ndarray:
    """Where each line ends, its line feed included; the last may have none."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def _points(data: bytes | memoryview) -> int:
    """Code points of UTF-8 bytes: those that do not continue one."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def rearrange(data: bytes, first: int, second: int, form: str, sentinels: tuple[bytes, bytes, bytes] = SENTINELS) -> bytearray:
    """The text with its parts, cut at bytes ``first`` and ``second``, in the order of the form."""
    p, s, m = sentinels
    buffer = bytearray(data)
    for at, mark in ((second, s), (first, m), (0, p)):
        buffer[at:at] = mark
    start_m = len(p) + first
    start_s = start_m + len(m) + second - first
    rotate(buffer, start_m, start_s, len(buffer))  # prefix, suffix, middle
    if form == SPM:
        rotate(buffer, 0, start_m, start_m + len(buffer) - start_s)  # suffix, prefix, middle
    return buffer


def restore(output: bytes, form: str, sentinels: tuple[bytes, bytes, bytes] = SENTINELS) -> bytes | bytearray:
    """The text that ``rearrange`` was given."""
    if form == PLAIN:
        return output
    p, s, m = sentinels
    buffer = bytearray(output)
    start_m = buffer.index(m)
    start_s = buffer.index(s)
    if form == SPM:
        start_p = buffer.index(p)
        rotate(buffer, 0, start_p, start_m)
        start_s = start_m - start_p
    rotate(buffer, start_s, start_m, len(buffer))  # prefix, middle, suffix
    start_m, start_s = start_s, start_s + len(buffer) - start_m
    for at, mark in ((start_s, s), (start_m, m), (0, p)):
        del buffer[at : at + len(mark)]
    return buffer


def choices(doc_id: Column, seed: int = 7) -> Column:
    """Four unsigned 32-bit numbers from the seed and the id (null: no digits), the same on every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    seed: int = 7,
    rate: int = 100,
    spm_rate: int = 50,
    sentinels: tuple[bytes, bytes, bytes] = SENTINELS,
) -> DataFrame:
    """Every row with its text (null: empty) rearranged; no shuffle, a batch of rows at a time.

    Adds n (lines), form, prefix_chars, middle_chars (code points, null if plain) and output
    (bytes); names that ``docs`` has get underscores in front. Of ``rate`` percent of the texts,
    ``spm_rate`` percent come suffix first. Empty texts and those with a sentinel stay plain.
    Rows with the same id are cut at the same numbers, rows without one like an id without digits.
    """
    check_sentinels(sentinels)
    names = [column_name(docs, c) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    whole, numbers = column_name(docs, "whole_text"), column_name(docs, "choices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(batch.num_columns - 2))
            drawn = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, 4).tolist()
            out: list[list] = [[] for _ in names]
            for i, (h1, h2, h3, h4) in enumerate(drawn):
                one = data[bounds[i] : bounds[i + 1]].tobytes()
                ends = line_ends(one)
                n = len(ends)
                if not one or h3 % 100 >= rate or any(s in one for s in sentinels):
                    row = (n, PLAIN, None, None, one)
                else:
                    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
                    a, b = (int(ends[k - 1]) if k else 0 for k in (a, b))
                    form = SPM if h4 % 100 < spm_rate else PSM
                    row = (n, form, _points(one[:a]), _points(one[a:b]), bytes(rearrange(one, a, b, form, sentinels)))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            fields = [*list(batch.schema)[:-2], *[pa.field(c, k) for c, k in zip(names, kinds, strict=True)]]
            made = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], schema=pa.schema(fields))

    bounded_batches(docs.sparkSession)
    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(names, ("long", "string", "long", "long", "binary"), strict=True):
        schema = schema.add(name, kind)
    kept = [F.col(c) for c in docs.columns]
    return docs.select(*kept, F.col(text).alias(whole), choices(F.col(doc_id), seed).alias(numbers)).mapInArrow(run, schema)


def restored(
    rows: DataFrame, output: str = "output", form: str = "form", into: str = "restored", sentinels: tuple[bytes, bytes, bytes] = SENTINELS
) -> DataFrame:
    """Adds the text (bytes) that each output was made from; needs the output and the form only."""
    name = column_name(rows, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            back = [None if o is None else bytes(restore(o, f or PLAIN, sentinels)) for o, f in pairs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(back, pa.binary())], schema=pa.schema([*list(batch.schema)[:-2], pa.field(name, pa.binary())])
            )

    bounded_batches(rows.sparkSession)
    given = rows.select(*rows.columns, F.col(output).alias(column_name(rows, "given_output")), F.col(form).alias(column_name(rows, "given_form")))
    return given.mapInArrow(run, T.StructType(list(rows.schema.fields)).add(name, "binary"))
