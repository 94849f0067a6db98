"""The call table: one schema, one spelling per column, typed once at ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALLS = T.StructType(
    [
        T.StructField("call_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("transcript", T.StringType()),
        T.StructField("phone_number", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("campaign", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("call_type", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("revenue", T.DoubleType()),
        T.StructField("customer_name", T.StringType()),
        T.StructField("product_name", T.StringType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("order_id", T.StringType()),
    ]
)

REQUIRED = ["call_id", "timestamp", "duration", "transcript"]

# Second spellings that older files use for the same column.
SPELLINGS = {
    "timestamp": ["start_time"],
    "duration": ["duration_seconds"],
    "revenue": ["amount"],
}


class MissingColumns(ValueError):
    """Raised before a job starts when required columns are absent."""


def require(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))


def first_present(df: DataFrame, *names: str) -> str | None:
    return next((n for n in names if n in df.columns), None)


def typed_calls(df: DataFrame) -> DataFrame:
    """Cast to the call schema in schema order; a bad value becomes null."""
    source = {f.name: first_present(df, f.name, *SPELLINGS.get(f.name, [])) for f in CALLS.fields}
    missing = [c for c in REQUIRED if source[c] is None]
    if missing:
        raise MissingColumns("missing required columns: " + ", ".join(missing))
    have = dict(df.dtypes)
    out = []
    for field in CALLS.fields:
        name = source[field.name]
        if name is None:
            col = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.TimestampType) and have[name] == "string":
            col = F.try_to_timestamp(F.col(name))
        elif isinstance(field.dataType, T.DoubleType):
            number = F.col(name).try_cast("double")
            col = F.when(~F.isnan(number), number)
        else:
            col = F.col(name).try_cast(field.dataType)
        out.append(col.alias(field.name))
    return df.select(*out)


def record_rules(df: DataFrame) -> DataFrame:
    """Trim the transcript and add ``reason``: null for a valid record.

    ``df.where("reason is null")`` is the valid table, the rest the quarantine.
    """
    from .functions.text import strip

    text = strip(F.col("transcript"))
    reason = (
        F.when(F.col("call_id").isNull(), "call_id missing")
        .when(F.col("timestamp").isNull(), "timestamp missing")
        .when(F.col("duration").isNull(), "duration missing")
        .when(F.col("duration") < 0, "duration negative")
        .when(text.isNull() | (text == ""), "transcript empty")
    )
    return df.withColumn("transcript", text).withColumn("reason", reason)
