"""Token-ID output: ORC files of token ids, in document order, and what is read back from them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import bounded_batches, column_name, written
from .tokens import tokenizer

STRIPE_BYTES = 16 << 20
ROWS_PER_INDEX = 1_000


def _id_lists(parts: list[bytes]) -> pa.Array:
    bounds = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=bounds[1:])
    ids = np.frombuffer(b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids))


def with_token_ids(docs: DataFrame, path: str, end_id: int | None, text: str = "text", out: str = "token_ids") -> DataFrame:
    """The columns of ``docs`` without the text and with ``out``, the ids of the whole text.

    A null text counts as empty; ``end_id``, if given, is appended to every document. ``path``
    names a vocabulary file of the tokenizers library, which every executor can read.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (text, out)]
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.schema.get_field_index(text)), "").to_pylist()
            ids = _id_lists([part + end for part in words.encode(texts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in kept] + [ids], [*kept, out]
            )

    schema = docs.select(*kept).schema.add(out, T.ArrayType(T.IntegerType()))
    return docs.select(*kept, text).mapInArrow(run, schema)


def write_token_files(
    docs: DataFrame, vocabulary: str, path: str, order: list[str], files: int, end_id: int | None, text: str = "text", bloom: str | None = None
) -> None:
    """Write the token ids of ``docs`` as ``files`` ORC files in the order of ``order``.

    The rows are dealt by ranges of the order (nulls first) before they are encoded, so a text
    is encoded once, and file number ``file_no`` holds what comes before all of the next file.
    ORC codes the ids by integer run-length encoding; stripes can be read in parallel, row
    indexes and Bloom filters on the ``bloom`` column (the first of the order) let a reader
    skip stripes that do not hold a wanted document.
    """
    dealt = docs.repartitionByRange(files, *order).withColumn("file_no", F.spark_partition_id()).sortWithinPartitions(*order)
    (
        with_token_ids(dealt, vocabulary, end_id, text)
        .write.option("orc.bloom.filter.columns", bloom or order[0])
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROWS_PER_INDEX))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the written files."""
    return spark.read.orc(path)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int], key: str = "doc_id") -> DataFrame:
    """The rows of a bounded list of documents; stripes that cannot hold them are skipped."""
    return read_token_files(spark, path).where(F.col(key).isin(*doc_ids))


def ids_crc32(column: str = "token_ids") -> Column:
    """CRC-32 of ids as little-endian unsigned 32-bit integers (null: none)."""

    @F.pandas_udf("long")
    def crc(ids):
        return ids.map(lambda x: zlib.crc32(np.asarray(x, "<i4").tobytes()), na_action="ignore")

    return crc(column)


def digests(files: DataFrame, order: list[str], ids: str = "token_ids") -> DataFrame:
    """Per document of ``read_token_files``: where its ids start in the whole output, how many
    they are and their CRC-32. ``order`` is the order that the files were written in; documents
    that tie in it follow by checksum and count.

    The starts are summed within each file and over the totals of the files before it.
    """
    n, crc, at = (column_name(files, c) for c in ("n_tokens", "ids_crc32", "start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            bounds = lists.offsets.to_numpy()
            data = lists.values.to_numpy().astype("<i4", copy=False)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(np.diff(bounds).astype(np.int64)), pa.array(crcs, pa.int64())],
                [*batch.schema.names[:-1], n, crc],
            )

    bounded_batches(files.sparkSession)
    kept = [c for c in files.columns if c != ids]
    schema = files.select(*kept).schema.add(n, "long").add(crc, "long")
    # Totals and starts both need these few numbers; the files are read for them once.
    per_doc = written(files.select(*kept, ids).mapInArrow(run, schema), "token-digests")
    before = Window.partitionBy("file_no").orderBy(*order, crc, n).rowsBetween(Window.unboundedPreceding, -1)
    totals = per_doc.groupBy("file_no").agg(F.sum(n).alias("_total"))
    earlier = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    offsets = totals.select("file_no", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    return (
        per_doc.withColumn(at, F.coalesce(F.sum(n).over(before), F.lit(0)))
        .join(offsets, "file_no")
        .withColumn(at, F.col(at) + F.col("_offset"))
        .drop("_offset")
    )
