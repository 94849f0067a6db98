"""From files to a clean call table."""

from __future__ import annotations

import re
import tomllib
from datetime import datetime
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import (
    AUDIO_MAX_BYTES,
    AUDIO_SUFFIXES,
    DEFAULT_HEADER_PATTERNS,
    FIELD_TABLE,
    IMPORT_FORMATS,
    OPTIONAL_COLUMNS,
)
from ..functions.parsing import digits, duration_seconds, import_timestamp, try_format
from ..functions.text import strip
from ..schema import REQUIRED, MissingColumns

CORRUPT = "_corrupt_record"
SOURCE = "_source_file"
NO_HEADER = "no header"


def literal(path: str) -> str:
    """A path for a reader that takes brackets, braces, stars and question marks as patterns."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def csv_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """(file_path, header, valid_utf8) of CSV files: header is the first line that is not blank.

    A file without any text has null in both. Below a directory only names that end in
    ``.csv``, in any case and also compressed, count; a path that names a file is taken as it is.
    Paths may be patterns; ``literal`` gives that of one file whatever its name is.
    """
    paths = [path] if isinstance(path, str) else path
    pattern = r"(?i).*\.csv(\.(gz|bz2|zst|snappy|lz4|deflate))?$"
    named = F.lit(False)
    plain = F.try_url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B")))
    for p in paths:
        named = named | plain.endswith(re.sub(r"\\(.)", r"\1", p).rstrip("/"))
    wanted = named | F.col("file_path").rlike(pattern)
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(paths)
        .select(F.col("_metadata.file_path").alias("file_path")).where(wanted)
    )
    lines = spark.read.option("recursiveFileLookup", recursive).text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), "value", F.monotonically_increasing_id().alias("at"), F.col("_metadata.file_block_start").alias("block")
    )
    first = lines.where(F.trim("value") != "").groupBy("file_path").agg(
        F.min_by("value", F.struct("block", "at")).alias("header"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid_utf8"),
    )
    return listed.join(first, "file_path", "left")


def read_csv(spark: SparkSession, path: str | list[str], encoding: str | None = None, recursive: bool = False) -> DataFrame:
    """CSV with a header, every column as text, plus ``_corrupt_record`` for bad rows.

    Types are cast later, so values are not scanned for inference. Quoted fields may hold
    line ends, so a file is read by one task; many files are read side by side. Every file is
    read by its own header: files with equal headers and charsets are one scan, and the scans
    are united by column name. Without ``encoding``, files that are not valid UTF-8 are read
    as ISO-8859-1. Files without any text give no rows; ``file_errors`` names them.
    """
    return _placed(_united(spark, csv_layouts(spark, path, encoding, recursive)), keep_source=False)


def csv_layouts(
    spark: SparkSession, path: str | list[str], encoding: str | None = None, recursive: bool = False
) -> list[DataFrame]:
    """One table per header and charset of the files, with the place of each row in ``_source_file``."""
    return _layouts(spark, _listed(spark, path, recursive), encoding)


def _listed(spark: SparkSession, path: str | list[str], recursive: bool) -> list[Row]:
    """The rows of ``csv_files``, one per file, with the header as bytes."""
    return csv_files(spark, path, recursive).withColumn("header", F.col("header").cast("binary")).collect()


def _layouts(spark: SparkSession, listed: list[Row], encoding: str | None) -> list[DataFrame]:
    groups: dict[tuple[str, str], list[str]] = {}
    for row in (r for r in listed if r["header"] is not None):
        charset = encoding or ("UTF-8" if row["valid_utf8"] else "ISO-8859-1")
        groups.setdefault((bytes(row["header"]).decode(charset, "replace").strip("\ufeff\r\n"), charset), []).append(literal(unquote(row["file_path"])))
    place = F.struct(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("file_block"))
    out = []
    for (header, charset), files in sorted(groups.items()):
        reader = spark.read.options(header=True, encoding=charset, quote='"', escape='"', multiLine=True)
        whole = header.count('"') % 2 == 0  # else a quoted name goes on in the next line
        names = reader.csv(spark.sparkContext.parallelize([header], 1) if whole else files[0]).columns
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False)
        out.append(reader.schema(schema).csv(sorted(files)).select("*", place.alias(SOURCE)))
    return out


def _united(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"{CORRUPT} string, {SOURCE} struct<file_path: string, file_block: bigint>")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def _placed(rows: DataFrame, keep_source: bool) -> DataFrame:
    columns = [c for c in rows.columns if c not in (CORRUPT, SOURCE)] + [CORRUPT]
    if not keep_source:
        return rows.select(*[F.col(f"`{c}`") for c in columns])
    return rows.select(*[F.col(f"`{c}`") for c in columns], f"{SOURCE}.*", F.monotonically_increasing_id().alias("row_seq"))


def file_errors(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(file_path, error) of files that an import leaves out."""
    return csv_files(spark, path, recursive).where("header is null").select("file_path", F.lit(NO_HEADER).alias("error"))


def preview(spark: SparkSession, path: str, n: int = 5) -> DataFrame:
    return read_csv(spark, path).drop(CORRUPT).limit(n)


def read_directory(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """All CSV files below a directory, with ``file_path`` and the place of each row.

    (file_path, file_block, row_seq) is the file order: the row number only has to
    count within one file.
    """
    return _placed(_united(spark, csv_layouts(spark, path, encoding, recursive=True)), keep_source=True)


def import_files(
    spark: SparkSession, path: str | list[str], encoding: str | None = None
) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """(clean calls, rejected rows, errors per file) of all CSV files below a path.

    The headers of each layout are mapped alone, so files with other names or another order of
    columns meet in one table. A layout that lacks a required column, and files without a
    header, give an error line each and do not stop the others.
    """
    listed = _listed(spark, path, recursive=True)  # every file is searched for its header once
    errors = [(r["file_path"], NO_HEADER) for r in listed if r["header"] is None]
    good, rejected = [], [spark.createDataFrame([], "file_path string, row string")]
    for layout in _layouts(spark, listed, encoding):
        rows = _placed(layout, keep_source=True)
        try:
            good.append(clean(parse_dates(standardise(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)))))
        except MissingColumns as error:
            errors += [(r["file_path"], str(error)) for r in rows.select("file_path").distinct().collect()]
            continue
        # Spark wants a data column beside the bad-row one: an empty piece of it.
        nothing = F.substring(F.coalesce(F.col(f"`{layout.columns[0]}`"), F.lit("")), 1, 0)
        rejected.append(rows.where(F.col(CORRUPT).isNotNull()).select("file_path", F.concat(CORRUPT, nothing).alias("row")))
    table = _united(spark, good) if good else None
    return table, _united(spark, rejected), spark.createDataFrame(errors, "file_path string, error string")


def bad_row_count(rows: DataFrame) -> Column:
    """Count of rows that did not parse. Spark wants a data column beside the bad-row one."""
    data = next(c for c in rows.columns if c != CORRUPT)
    return F.count(F.when(F.col(CORRUPT).isNotNull(), F.struct(F.col(f"`{data}`"))))


def file_results(rows: DataFrame) -> DataFrame:
    """Rows and bad rows per file."""
    return rows.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), bad_row_count(rows).alias("bad_rows")
    )


def load_fields(path: str) -> list[tuple]:
    """Field table from TOML: name, label, required, aliases, patterns."""
    with open(path, "rb") as handle:
        rows = tomllib.load(handle)["fields"]["definitions"]
    return [
        (r["name"], r.get("label", r["name"]), r.get("required", False), r.get("aliases", []), r.get("patterns", []))
        for r in rows
    ]


def _plain(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def map_headers(headers: list[str], fields: list[tuple] | None = FIELD_TABLE) -> dict[str, str]:
    """Field -> header. With a field table each header is used once, names and aliases
    before patterns; without one the first header that fits a built-in pattern wins."""
    if not fields:
        first = {
            name: next((h for h in headers if re.search(pattern, h.lower())), None)
            for name, pattern in DEFAULT_HEADER_PATTERNS.items()
        }
        return {name: h for name, h in first.items() if h}
    mapping: dict[str, str] = {}
    for name, label, _, aliases, patterns in fields:
        free = [h for h in headers if h not in mapping.values()]
        exact = {_plain(x) for x in (name, label, *aliases)}
        hit = next((h for h in free if _plain(h) in exact), None)
        if hit is None:
            fits = (h for p in patterns for h in free if re.search(p, h.lower()) or re.search(p, _plain(h)))
            hit = next(fits, None)
        if hit is not None:
            mapping[name] = hit
    return mapping


def standardise(
    df: DataFrame,
    fields: list[tuple] | None = FIELD_TABLE,
    mapping: dict[str, str] | None = None,
    required: list[str] | None = None,
    strict: bool = True,
) -> DataFrame:
    """Rename to field names, normalise the rest, add absent optional columns as null.

    One ``select`` decides everything from the header; with ``strict`` a missing
    required column is an error before any job runs.
    """
    headers = [c for c in df.columns if c != CORRUPT and c not in SEQUENCE]
    mapping = map_headers(headers, fields) if mapping is None else mapping
    name_of: dict[str, str] = {}
    for field, header in mapping.items():
        # A header used twice takes the last name given to it.
        name_of[header] = field
    out: dict[str, Column] = {}
    for header in headers:
        name = name_of.get(header, header).lower().replace(" ", "_").replace("-", "_")
        out.setdefault(name, F.col(f"`{header}`"))
    if "timestamp" not in out:
        spare = next((n for n in ("start_time", "created_at", "date") if n in out), None)
        if spare:
            out["timestamp"] = out[spare]
    optional = list(OPTIONAL_COLUMNS)
    if fields:
        known = [f[0] for f in fields if not f[2]]
        optional = known + [c for c in optional if c not in known]
    for name in optional:
        out.setdefault(name, F.lit(None).cast("string"))
    wanted = required or ([f[0] for f in fields if f[2]] if fields else REQUIRED)
    missing = [c for c in wanted if c not in out]
    if missing and strict:
        raise MissingColumns("missing required columns: " + ", ".join(missing))
    order = [c for c in SEQUENCE if c in df.columns]
    return df.select(*[c.alias(n) for n, c in out.items()], *order)


DATE_COLUMNS = ["timestamp", "start_time", "end_time", "created_at", "updated_at"]


def parse_dates(df: DataFrame, whole_column: bool = False) -> DataFrame:
    """Text dates to timestamps: per row the first format that fits.

    ``whole_column`` takes a format only when it fits every row of the column; the fits
    of all formats are counted in one pass.
    """
    names = [c for c in DATE_COLUMNS if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    for name in names:
        value = import_timestamp(F.col(name))
        if whole_column:
            tries = [try_format(F.col(name), f) for f in IMPORT_FORMATS]
            fails = df.agg(
                *[F.count_if(F.col(name).isNotNull() & t.isNull()).alias(str(i)) for i, t in enumerate(tries)]
            ).first()
            fit = next((t for i, t in enumerate(tries) if fails[i] == 0), None)
            value = fit if fit is not None else F.try_to_timestamp(F.col(name))
        df = df.withColumn(name, value)
    return df


# File order of a row, written once at ingest.
SEQUENCE = ["file_path", "file_block", "row_seq"]


def drop_repeats(df: DataFrame) -> DataFrame:
    """Whole-row distinct. Where the rows carry their file order, the first copy's is kept."""
    order = [c for c in SEQUENCE if c in df.columns]
    if not order:
        return df.dropDuplicates()
    data = [f"`{c}`" for c in df.columns if c not in order]
    first = F.min(F.struct(*order)).alias("_first")
    return df.groupBy(*data).agg(first).select(*data, "_first.*")


def clean(df: DataFrame) -> DataFrame:
    """Drop repeated rows, keep phone digits, parse durations, trim, fill notes and outcome."""
    df = drop_repeats(df)
    columns: dict[str, Column] = {}
    for field in df.schema.fields:
        if field.name in SEQUENCE:
            columns[field.name] = F.col(field.name)
            continue
        c = F.col(f"`{field.name}`")
        if field.name == "phone_number":
            c = digits(F.coalesce(c.cast("string"), F.lit("")))
        elif field.name == "duration" and isinstance(field.dataType, T.StringType):
            c = duration_seconds(strip(c))
        elif isinstance(field.dataType, T.StringType):
            c = strip(c)
        columns[field.name] = c
    for name, default in (("notes", ""), ("outcome", "unknown")):
        columns[name] = F.coalesce(columns[name], F.lit(default)) if name in columns else F.lit(default)
    return df.select(*[c.alias(n) for n, c in columns.items()])


def import_table(df: DataFrame, fields: list[tuple] | None = FIELD_TABLE) -> DataFrame:
    """Header mapping, dates and cleaning of a CSV table in one plan."""
    return clean(parse_dates(standardise(df, fields)))


def error_report(quarantine: DataFrame) -> DataFrame:
    """Rejected rows per reason."""
    return quarantine.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count(F.lit(1)).alias("count")
    )


AUDIO_NUMBERS = [
    "duration",
    "duration_seconds",
    "duration_minutes",
    "handle_time_seconds",
    "after_call_work_seconds",
    "revenue",
]


def audio_metadata(df: DataFrame) -> DataFrame:
    """Records with an audio file; times and numbers typed, ``dirty`` where one is bad.

    The text of a bad value is kept in ``timestamp_text`` for the time only.
    """
    kept = df.where(F.length("audio_file") > 0)
    numbers = [n for n in AUDIO_NUMBERS if n in df.columns]
    given = lambda c: F.coalesce(F.length(c), F.lit(0)) > 0
    bad = F.lit(False)
    columns: dict[str, Column] = {"file_key": F.lower("audio_file")}
    if "timestamp" in df.columns:
        ts = F.try_to_timestamp(F.col("timestamp"))
        columns["timestamp_text"] = F.when(ts.isNull(), F.col("timestamp"))
        columns["timestamp"] = ts
        bad = bad | (given(F.col("timestamp")) & ts.isNull())
    for n in numbers:
        value = F.trim(F.col(n)).try_cast("double")
        columns[n] = value
        bad = bad | (given(F.col(n)) & value.isNull())
    return kept.withColumns({**columns, "dirty": bad})


def transcript_records(
    transcripts: DataFrame, metadata: DataFrame, base: dict[str, Any], as_of: datetime
) -> DataFrame:
    """Join transcripts (file, transcript, duration_seconds) with metadata by file name.

    Metadata wins over the base fields; the duration comes from the metadata, then from
    the transcript. Neither side has to be small: the join is on the file name.
    """
    zero_is_none = lambda c: F.nullif(c, F.lit(0.0))
    # A file named twice keeps its last metadata row, where the rows carry their order.
    order = [F.col(c) for c in SEQUENCE if c in metadata.columns] or [F.lit(0)]
    rest = [c for c in metadata.columns if c != "file_key" and c not in SEQUENCE]
    one = metadata.groupBy("file_key").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    m = one.select(F.col("file_key").alias("m_file_key"), *[F.col(f"r.{c}").alias(f"m_{c}") for c in rest])
    joined = transcripts.join(m, F.lower(transcripts["file"]) == F.col("m_file_key"), "left")

    def of(name: str) -> Column:
        return F.col(f"m_{name}") if f"m_{name}" in joined.columns else F.lit(None)

    seconds = F.coalesce(
        zero_is_none(of("duration_seconds").cast("double")),
        zero_is_none(of("duration").cast("double")),
        zero_is_none(F.col("duration_seconds").cast("double")),
        F.lit(0.0),
    )
    minutes = F.coalesce(zero_is_none(of("duration_minutes").cast("double")), seconds / 60)
    stamp = F.lit(as_of.strftime("%Y%m%d_%H%M%S"))
    columns = {
        "call_id": F.coalesce(of("call_id").cast("string"), F.concat(F.lit("audio_"), stamp, F.lit("_"), "file")),
        "phone_number": F.coalesce(of("phone_number").cast("string"), F.lit("unknown")),
        "timestamp": F.coalesce(of("timestamp").cast("timestamp"), F.lit(as_of).cast("timestamp")),
        "duration": seconds,
        "duration_minutes": minutes,
        "transcript": F.col("transcript"),
    }
    skip = {"audio_file", "transcript_file", "transcript", "file_key", "dirty", "timestamp_text"}
    skip |= {"duration_seconds", "duration_minutes", *columns}
    for name in dict.fromkeys([*base, *metadata.columns]):
        if name not in skip:
            columns[name] = F.coalesce(of(name), F.lit(base.get(name)))
    return joined.select(*[c.alias(n) for n, c in columns.items()])


def file_inventory(spark: SparkSession, path: str, with_hash: bool = False, glob: str = "*") -> DataFrame:
    """(path, name, suffix, size, modified) per file, with a content hash on demand.

    Without the hash the content column is pruned and no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, "(\\.[^.]+)$", 1))
    out = [
        F.col("path"),
        name.alias("name"),
        suffix.alias("suffix"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    ]
    if with_hash:
        out.append(F.sha2("content", 256).alias("sha256"))
    return files.select(*out)


def size_by_suffix(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")
    )


def audio_rule(inventory: DataFrame) -> DataFrame:
    """Adds ``reason``: null for a usable audio file."""
    reason = (
        F.when(~F.col("suffix").isin(AUDIO_SUFFIXES), "unknown suffix")
        .when(F.col("size") <= 0, "empty")
        .when(F.col("size") > AUDIO_MAX_BYTES, "too large")
    )
    return inventory.withColumn("reason", reason)
