"""Tables on a shared file system: versions, batches, snapshots and the import log.

Nothing that is being read is overwritten: a table is a directory of immutable versions
plus a small manifest, and the call table is a directory of import batches.
"""

from __future__ import annotations

from datetime import date, datetime, time
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import SEQUENCE, file_inventory

MANIFEST = "name string, version bigint, path string, format string, created_at timestamp, record_count bigint"
COMPACTED = "name string, path string, batch_seq bigint, at timestamp"
FOLDED = "path string, batch_seq bigint, stamp string"
SNAPSHOTS = "name string, path string, created_at timestamp, record_count bigint"
HISTORY = (
    "filename string, timestamp timestamp, records_imported bigint, status string, error string, file_size bigint"
)


def _read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(spark: SparkSession, path: str, schema: str, row: tuple) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def save_table(
    df: DataFrame, root: str, name: str, as_of: datetime, fmt: str = "parquet", partition_by: list[str] | None = None
) -> str:
    """Write a new version of a named table and note it in the manifest; returns its path."""
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unsupported format: {fmt}")
    spark = df.sparkSession
    manifest = _read_or_empty(spark, f"{root}/_manifest", MANIFEST)
    last = manifest.where(F.col("name") == name).agg(F.max("version")).first()[0]
    version = (last or 0) + 1
    path = f"{root}/{name}/v{version}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)
    count = load_path(spark, path, fmt).count()
    _append(spark, f"{root}/_manifest", MANIFEST, (name, version, path, fmt, as_of, count))
    return path


def load_path(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return spark.read.option("header", True).csv(path) if fmt == "csv" else spark.read.parquet(path)


def load_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """Newest version of a table; None when there is none."""
    row = (
        _read_or_empty(spark, f"{root}/_manifest", MANIFEST)
        .where(F.col("name") == name)
        .orderBy(F.desc("version"))
        .first()
    )
    return load_path(spark, row["path"], row["format"]) if row else None


def by_day(df: DataFrame) -> DataFrame:
    """Adds ``call_date`` for partitioning, and brings the rows of a day together.

    The rebalance hint lets adaptive execution cut a busy day into as many tasks as its size
    asks for.
    """
    dated = df.withColumn("call_date", F.to_date("timestamp"))
    return dated.hint("rebalance", F.col("call_date"))


def load_range(df: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Rows from start to end; a bare date end lasts until 23:59:59.999999.

    The date bounds are also put on ``call_date``, which prunes directories.
    """
    if isinstance(start, date) and not isinstance(start, datetime):
        start = datetime.combine(start, time.min)
    if isinstance(end, date) and not isinstance(end, datetime):
        end = datetime.combine(end, time.max)
    for bound, test in ((start, "__ge__"), (end, "__le__")):
        if bound is None:
            continue
        value = F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")
        df = df.where(getattr(F.col("timestamp"), test)(value))
        if "call_date" in df.columns:
            df = df.where(getattr(F.col("call_date"), test)(F.lit(bound.date())))
    return df


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; null keys count as equal.

    The last order of a key is found on the key and order columns only, copies combined before
    the shuffle; the rows themselves are moved once, by the join that keeps the last ones.
    ``df`` needs distinct orders per key.
    """
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("_last"))
    same = df[key].eqNullSafe(F.col("_key"))
    for name in order:
        same = same & df[name].eqNullSafe(F.col(f"_last.{name}"))
    return df.join(last.withColumnRenamed(key, "_key"), same, "left_semi")


def upsert(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Existing rows without the keys of the new ones, and the last new row per key.

    ``existing`` has one row per key, so neither side of the join is skewed.
    """
    fresh = latest(new, key, order)
    keys = fresh.select(F.col(key).alias("_key"))
    old = existing.join(keys, existing[key].eqNullSafe(F.col("_key")), "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def rows_added(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row: net rows that an upsert adds."""
    keys = new.select(key).distinct()
    fresh = keys.join(
        existing.select(F.col(key).alias("_key")), keys[key].eqNullSafe(F.col("_key")), "left_anti"
    )
    return fresh.agg(F.count(F.lit(1)).alias("rows_added"))


def write_batch(df: DataFrame, root: str, batch_seq: int) -> str:
    """Write one import batch to its own directory; writing it again replaces only it."""
    path = f"{root}/batches/batch_seq={batch_seq}"
    df.write.mode("overwrite").parquet(path)
    return path


def read_batches(spark: SparkSession, root: str, numbers: list[int] | None = None) -> DataFrame:
    """All batches, or those with the given numbers; the files of others are not opened."""
    reader = spark.read.option("basePath", f"{root}/batches").option("mergeSchema", True)
    return reader.parquet(*([f"{root}/batches"] if numbers is None else [f"{root}/batches/batch_seq={n}" for n in numbers]))


def batch_stamps(spark: SparkSession, root: str) -> dict[int, str]:
    """Per batch a stamp of its files, from their names and sizes alone; one row per batch.

    A batch that is written again gets other files and so another stamp.
    """
    files = file_inventory(spark, f"{root}/batches", glob="*.parquet")
    number = F.regexp_extract("path", "/batch_seq=(-?[0-9]+)/", 1).try_cast("bigint")
    listed = F.array_sort(F.collect_set(F.concat_ws(":", "name", "size")))
    stamps = files.groupBy(number.alias("n")).agg(F.sha2(F.array_join(listed, "\n"), 256).alias("stamp"))
    return {r["n"]: r["stamp"] for r in stamps.where("n IS NOT NULL").collect()}


def _folded(spark: SparkSession, root: str, name: str) -> tuple[str, dict[int, str]] | None:
    """Path of the newest compacted version and the stamps of the batches in it."""
    newest = _read_or_empty(spark, f"{root}/_compacted", COMPACTED).where(F.col("name") == name).orderBy(F.desc("at")).first()
    if newest is None:
        return None
    rows = _read_or_empty(spark, f"{root}/_folded", FOLDED).where(F.col("path") == newest["path"])
    return newest["path"], {r["batch_seq"]: r["stamp"] for r in rows.collect()}


def _current(spark: SparkSession, root: str, key: str, order: list[str], name: str, stamps: dict[int, str]) -> DataFrame:
    folded = _folded(spark, root, name)
    if folded is None:
        return latest(read_batches(spark, root, sorted(stamps) or None), key, order)
    path, known = folded
    rows = spark.read.parquet(path)
    columns = [c for c in rows.columns if c != "call_date"]
    replaced = sorted(n for n in known if n in stamps and stamps[n] != known[n])
    live = sorted(n for n in stamps if known.get(n) != stamps[n])
    kept = sorted(n for n in known if stamps.get(n) == known[n])
    if replaced:
        # Calls whose last row stood in a replaced batch are found again in the batches that stay.
        gone = F.col("batch_seq").isin(replaced)
        keys = rows.where(gone).select(F.col(key).alias("_key"))
        rows = rows.where(~gone)
        if kept:
            older = read_batches(spark, root, kept)
            rows = rows.unionByName(older.join(keys, older[key].eqNullSafe(F.col("_key")), "left_semi"), allowMissingColumns=True)
    if live:
        rows = rows.unionByName(read_batches(spark, root, live), allowMissingColumns=True)
        columns += [c for c in rows.columns if c not in [*columns, "call_date"]]
    return latest(rows, key, order).select(*columns)


def current_calls(
    spark: SparkSession, root: str, key: str = "call_id", order: list[str] | None = None, name: str = "calls"
) -> DataFrame:
    """The call table: the last row per call of the newest compacted version and of the batches that are not in it.

    Batches are only ever appended or replaced, so an import costs its own size and not that of
    the table; ``compact`` folds them into a version and notes which ones, so their files are
    not opened again. A batch that arrives late is merged by its number, whatever was folded
    before. A folded batch that was replaced since takes its rows out of the version, and the
    calls they stood for are looked up in the other batches.
    """
    return _current(spark, root, key, ["batch_seq", *(order or SEQUENCE)], name, batch_stamps(spark, root))


def compact(
    spark: SparkSession, root: str, name: str, as_of: datetime, key: str = "call_id", order: list[str] | None = None
) -> str:
    """Write the current calls as a new version, partitioned by day, and note the batches in it."""
    stamps = batch_stamps(spark, root)  # batches that arrive meanwhile are not in the version
    rows = _current(spark, root, key, ["batch_seq", *(order or SEQUENCE)], name, stamps)
    path = save_table(by_day(rows), root, name, as_of, partition_by=["call_date"])
    noted = spark.createDataFrame([(path, n, stamp) for n, stamp in sorted(stamps.items())], FOLDED)
    noted.coalesce(1).write.mode("append").parquet(f"{root}/_folded")
    _append(spark, f"{root}/_compacted", COMPACTED, (name, path, max(stamps), as_of))
    return path


def create_snapshot(df: DataFrame, root: str, name: str, as_of: datetime) -> str:
    """Immutable copy named after table and time, noted in the snapshot catalog."""
    spark = df.sparkSession
    full = f"{name}_{as_of:%Y%m%d_%H%M%S}"
    path = f"{root}/snapshots/{full}"
    df.write.mode("error").parquet(path)
    count = spark.read.parquet(path).count()
    _append(spark, f"{root}/_snapshots", SNAPSHOTS, (full, path, as_of, count))
    return full


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    return _read_or_empty(spark, f"{root}/_snapshots", SNAPSHOTS)


def load_snapshot(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    row = list_snapshots(spark, root).where(F.col("name") == name).first()
    return spark.read.parquet(row["path"]) if row else None


def add_import_record(spark: SparkSession, root: str, record: dict[str, Any]) -> None:
    names = [part.split()[0] for part in HISTORY.split(", ")]
    _append(spark, f"{root}/_imports", f"kind string, at timestamp, {HISTORY}",
            ("import", record.get("timestamp"), *[record.get(n) for n in names]))


def clear_import_history(spark: SparkSession, root: str, as_of: datetime) -> None:
    """The log stays append-only: clearing adds a mark that hides the entries before it."""
    nothing = [None] * len(HISTORY.split(", "))
    _append(spark, f"{root}/_imports", f"kind string, at timestamp, {HISTORY}", ("clear", as_of, *nothing))


def import_history(spark: SparkSession, root: str) -> DataFrame:
    log = _read_or_empty(spark, f"{root}/_imports", f"kind string, at timestamp, {HISTORY}")
    cleared = log.where("kind = 'clear'").agg(F.max("at")).scalar()
    hidden = F.coalesce(F.col("at") <= cleared, F.lit(False))
    return log.where((F.col("kind") == "import") & ~hidden).drop("kind", "at")


def import_summary(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("total_imports"),
        F.coalesce(F.sum("records_imported"), F.lit(0)).alias("total_records"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def table_range(df: DataFrame) -> DataFrame:
    """Rows, first and last time."""
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.min("timestamp").alias("earliest"),
        F.max("timestamp").alias("latest"),
    )


def storage_statistics(df: DataFrame, root: str) -> DataFrame:
    """Rows, first and last time, snapshots and size of everything below ``root``."""
    spark = df.sparkSession
    size = file_inventory(spark, root).agg(F.sum("size")).scalar()
    snapshots = list_snapshots(spark, root).agg(F.count(F.lit(1))).scalar()
    megabytes = F.round(F.coalesce(size, F.lit(0)) / F.lit(1024.0 * 1024.0), 2)
    return table_range(df).withColumn("snapshots", snapshots).withColumn("storage_size_mb", megabytes)
