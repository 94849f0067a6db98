"""Helpers of the text operators: tables, row keys, Arrow batches as flat bytes, rolling hashes."""

from __future__ import annotations

from collections.abc import Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder

#: Bytes of text that one vectorised step works on; only memory depends on it.
STEP_BYTES = 1 << 19
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Hand rows to Python in batches of at most 16 MB or so many rows, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(frame: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: a cut of the lineage that
    survives the loss of executors. Shuffle files of the write go with it, and do not wait for
    the driver to collect its garbage."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(_SHUFFLE_CLEANUP, "false")
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    out = spark.read.schema(frame.schema).parquet(path)
    _folders[out] = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of tables as ``written`` returned them; others stay. Nothing that is
    still to be computed may read them."""
    for frame in frames:
        if path := _folders.pop(frame, None):
            spark = frame.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_hash(text: str = "text") -> Column:
    """Tells rows with the same id apart; rows that also share their text may stand for each other."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())


def column_name(frame: DataFrame, wanted: str) -> str:
    """``wanted``, with as many underscores in front as it takes not to clash with a column."""
    taken = {c.lower() for c in frame.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and the n + 1 bounds of its rows."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def steps(bounds: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each, one row at least."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, "right")) - 1)
        yield i, j
        i = j


_RANDOM = np.random.default_rng(20240229)
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        known[0] = 1
        known = _powers[base] = np.cumprod(known, dtype=np.uint64)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class RollingHash:
    """64-bit hash of any byte range of a text, from prefix sums."""

    def __init__(self, data: np.ndarray, values: np.ndarray = BYTE_VALUES):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers(_BASE, len(data)), out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * powers(_INVERSE, len(self.sums))[start]
        return mixed(h + np.uint64(seed & (2**64 - 1)))

    def every(self, width: int) -> np.ndarray:
        """The hash of each range of ``width`` bytes."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:-width]) * powers(_INVERSE, n))
