"""Exports: CSV profiles, JSON lines, split CSV, summary and filtered data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import EXPORT_PROFILES
from ..operators.metrics import total

EXPORT_DATES = ["timestamp", "created_at", "updated_at", "date"]


def _is_time(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType))


def export_columns(df: DataFrame, profile: str = "standard") -> DataFrame:
    """The present columns of a profile with its date format; unknown means standard."""
    names, date_format = EXPORT_PROFILES.get(profile, EXPORT_PROFILES["standard"])
    kept = [c for c in (names or df.columns) if c in df.columns]
    shown = [
        F.date_format(c, date_format).alias(c) if c in EXPORT_DATES and _is_time(df, c) else F.col(c)
        for c in kept
    ]
    return df.select(*shown)


def export_csv(df: DataFrame, path: str, profile: str = "standard", encoding: str = "UTF-8") -> None:
    export_columns(df, profile).write.mode("overwrite").option("header", True).option(
        "encoding", encoding
    ).option("escape", '"').csv(path)


def json_columns(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if _is_time(df, c) else F.col(c)
            for c in df.columns
        ]
    )


def export_json(df: DataFrame, path: str) -> None:
    """JSON lines, one record per row."""
    json_columns(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def safe_name(value: Column) -> Column:
    """A value as part of a file name: unsafe and control characters become ``_``.

    Names end at 255 characters; one that is longer ends in a digest of the whole value, so
    different values keep different names.
    """
    cleaned = F.regexp_replace(value.cast("string"), "[<>:\"/\\\\|?*\\x00-\\x1f]", "_")
    cleaned = F.regexp_replace(cleaned, "^[. ]+|[. ]+$", "")
    digest = F.substring(F.sha2(value.cast("string"), 256), 1, 16)
    cleaned = F.when(F.length(cleaned) <= 255, cleaned).otherwise(F.concat(F.substring(cleaned, 1, 238), F.lit("_"), digest))
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(F.lit("unnamed"))


def split_rows(df: DataFrame, split_by: str) -> DataFrame:
    """Rows with a value in the split column, plus the safe name of their part.

    The rebalance hint lets adaptive execution cut a part that holds much of the table.
    """
    return (
        df.where(F.col(split_by).isNotNull())
        .withColumn("split_name", safe_name(F.col(split_by)))
        .hint("rebalance", F.col("split_name"))
    )


def export_metadata(df: DataFrame, split_by: str | None = None) -> DataFrame:
    """One row: records, columns, first and last time and the names of the parts."""
    has_time = "timestamp" in df.columns
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    one = df.agg(
        F.count(F.lit(1)).alias("total_records"),
        (iso(F.min("timestamp")) if has_time else F.lit(None).cast("string")).alias("start"),
        (iso(F.max("timestamp")) if has_time else F.lit(None).cast("string")).alias("end"),
    ).withColumn("columns", F.lit(", ".join(df.columns)))
    if split_by and split_by in df.columns:
        parts = df.where(F.col(split_by).isNotNull()).agg(F.count_distinct(safe_name(F.col(split_by))))
        return one.withColumn("parts", parts.scalar())
    return one.withColumn("parts", F.lit(1).cast("bigint"))


def export_for_analytics(df: DataFrame, path: str, split_by: str | None = None) -> None:
    """CSV below ``path``/data, one directory per split value, and a metadata record."""
    if split_by and split_by in df.columns:
        writer = split_rows(df, split_by).write.partitionBy("split_name")
    else:
        writer = df.write
    writer.mode("overwrite").option("header", True).csv(f"{path}/data")
    export_metadata(df, split_by).coalesce(1).write.mode("overwrite").json(f"{path}/metadata")


def summary(df: DataFrame) -> DataFrame:
    """(Metric, Value) rows of the call table: totals, distinct values, duration, revenue,
    and one row per outcome. Values are text."""
    lines: list[tuple[str, Column]] = [("Total Calls", F.count(F.lit(1)).cast("string"))]
    if "timestamp" in df.columns:
        span = F.concat_ws(
            " to ", F.date_format(F.min("timestamp"), "yyyy-MM-dd HH:mm:ss"),
            F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss"),
        )
        lines.append(("Date Range", span))
    for c in ("agent_id", "campaign", "outcome", "call_type"):
        if c in df.columns:
            name = f"Unique {c.replace('_', ' ').title()}s"
            lines.append((name, F.count_distinct(c).cast("string")))
    number = lambda c: F.format_string("%.4f", F.round(c, 4))
    if "duration" in df.columns:
        lines.append(("Average Duration (seconds)", number(F.avg("duration"))))
        lines.append(("Total Duration (hours)", number(total("duration") / 3600)))
    if "revenue" in df.columns:
        lines.append(("Total Revenue", number(total("revenue"))))
        lines.append(("Average Revenue", number(F.avg("revenue"))))
    one = df.agg(*[value.alias(f"v{i}") for i, (_, value) in enumerate(lines)])
    pairs = [
        F.struct(F.lit(name).alias("Metric"), F.col(f"v{i}").alias("Value"))
        for i, (name, _) in enumerate(lines)
    ]
    out = one.select(F.inline(F.array(*pairs)))
    if "outcome" in df.columns:
        counts = df.where(F.col("outcome").isNotNull()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(
            counts.select(
                F.concat(F.lit("Outcome: "), "outcome").alias("Metric"), F.col("n").cast("string").alias("Value")
            )
        )
    return out


def export_filtered(df: DataFrame, path: str, fmt: str = "csv") -> None:
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unsupported export format: {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)
