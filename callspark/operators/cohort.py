"""Cohorts: start periods, period indices and the matrices built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import join_per_key
from ..functions.text import round_up
from ..schema import first_present

UNITS = {"Daily": "day", "Weekly": "week", "Monthly": "month"}
LABELS = {"Daily": "yyyy-MM-dd", "Weekly": "'Week of' yyyy-MM-dd", "Monthly": "yyyy-MM"}


def period_start(ts: Column, granularity: str) -> Column:
    return F.date_trunc(UNITS[granularity], ts).cast("timestamp_ntz")


def period_label(start: Column, granularity: str) -> Column:
    return F.date_format(start, LABELS[granularity])


def period_index(start: Column, cohort: Column, granularity: str) -> Column:
    """Months apart, or whole days (weeks: divided by 7) since the cohort start."""
    if granularity == "Monthly":
        months = lambda t: F.year(t) * 12 + F.month(t)
        return months(start) - months(cohort)
    days = F.datediff(start, cohort)
    return F.floor(days / 7).cast("int") if granularity == "Weekly" else days


def customer_key(df: DataFrame) -> str:
    name = first_present(df, "phone_number", "customer_id", "contact_id", "call_id")
    if name is None:
        raise ValueError("cohorts need a customer identifier")
    return name


def cohort_key(df: DataFrame, by: str) -> str:
    if by == "first_call":
        return customer_key(df)
    name = first_present(df, "campaign") if by == "campaign" else first_present(df, "agent_id", "agent")
    if name is None:
        raise ValueError(f"cohorts by {by} need that column")
    return name


def _labelled(key: str, by: str, start: Column, granularity: str) -> Column:
    label = period_label(start, granularity)
    return label if by == "first_call" else F.concat(F.col(key), F.lit(" • "), label)


def assign_cohorts(df: DataFrame, by: str = "first_call", granularity: str = "Monthly") -> DataFrame:
    """Adds cohort_start, cohort_label, period_start and period_index to every call.

    The first contact per key is an aggregate joined back; a key with very many calls
    is spread over partitions by the join.
    """
    key = cohort_key(df, by)
    dated = df.where(F.col("timestamp").isNotNull() & F.col(key).isNotNull())
    firsts = dated.groupBy(key).agg(
        F.min("timestamp").alias("first_ts"), F.count(F.lit(1)).alias("n_rows")
    )
    starts = firsts.withColumn("cohort_start", period_start(F.col("first_ts"), granularity)).drop("first_ts")
    tagged = join_per_key(dated, starts, [key]).drop("n_rows")
    begin = period_start(F.col("timestamp"), granularity)
    return (
        tagged.withColumn("cohort_label", _labelled(key, by, F.col("cohort_start"), granularity))
        .withColumn("period_start", begin)
        .withColumn(
            "period_index", period_index(F.col("period_start"), F.col("cohort_start"), granularity)
        )
    )


def _activity(df: DataFrame, by: str, granularity: str) -> DataFrame:
    """Sums per (key, customer, period): the calls are combined before any window or join."""
    key, customer = cohort_key(df, by), customer_key(df)
    dated = df.where(F.col("timestamp").isNotNull() & F.col(key).isNotNull())
    grain = [F.col(key).alias("key")]
    grain += [F.col(customer).alias("customer")] if customer != key else []
    sums = [
        F.min("timestamp").alias("first_ts"),
        F.count("call_id").alias("calls"),
        (F.sum("duration") if "duration" in df.columns else F.lit(None).cast("double")).alias("duration"),
        (F.count("duration") if "duration" in df.columns else F.lit(0)).alias("timed"),
        (F.sum("revenue") if "revenue" in df.columns else F.lit(None).cast("double")).alias("revenue"),
    ]
    begin = period_start(F.col("timestamp"), granularity)
    per = dated.groupBy(*grain, begin.alias("period_start")).agg(*sums)
    return per if customer != key else per.withColumn("customer", F.col("key"))


def _cells(df: DataFrame, by: str, granularity: str, periods: int) -> DataFrame:
    """One row per (cohort, period index) with customers, calls, duration and revenue."""
    per = _activity(df, by, granularity)
    if by == "first_call":
        # At most one row per period and customer is left, so the window is small.
        first = F.min("first_ts").over(Window.partitionBy("key"))
        placed = per.withColumn("cohort_start", period_start(first, granularity))
        placed = placed.withColumn("label", period_label(F.col("cohort_start"), granularity))
        grain = ["label", "cohort_start"]
        per_cell = placed.groupBy(*grain, "period_start").agg(*_cell_sums())
    else:
        # Campaigns and agents are combined per period first; only then is the start known.
        cells = per.groupBy("key", "period_start").agg(
            *_cell_sums(), F.min("first_ts").alias("first_ts")
        )
        first = F.min("first_ts").over(Window.partitionBy("key"))
        placed = cells.withColumn("cohort_start", period_start(first, granularity))
        per_cell = placed.withColumn("label", _labelled("key", by, F.col("cohort_start"), granularity))
    index = period_index(F.col("period_start"), F.col("cohort_start"), granularity)
    return per_cell.withColumn("i", index).where((F.col("i") >= 0) & (F.col("i") < periods))


def _cell_sums() -> list[Column]:
    return [
        F.count("customer").alias("customers"),
        F.sum("calls").alias("calls"),
        F.sum("duration").alias("duration"),
        F.sum("timed").alias("timed"),
        F.sum("revenue").alias("revenue"),
    ]


MEASURES = ["retention_rate", "average_duration", "revenue", "call_frequency"]


def cohort_matrix(
    df: DataFrame,
    measure: str,
    by: str = "first_call",
    granularity: str = "Monthly",
    periods: int = 6,
) -> DataFrame:
    """One row per cohort by start, columns ``Period 0`` .. ``Period n-1``, gaps as 0."""
    if measure not in MEASURES:
        raise ValueError(f"unknown cohort measure: {measure}")
    cells = _cells(df, by, granularity, periods)

    def at(i: int, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("i") == i, F.col(column))), F.lit(0))

    out = []
    for i in range(periods):
        if measure == "retention_rate":
            value = at(i, "customers") / F.nullif(at(0, "customers"), F.lit(0)) * 100
        elif measure == "average_duration":
            value = F.coalesce(at(i, "duration") / F.nullif(at(i, "timed"), F.lit(0)), F.lit(0.0)) / 60
        elif measure == "revenue":
            value = at(i, "revenue").cast("double")
        else:
            value = at(i, "calls").cast("double")
        out.append(round_up(value, 2).alias(f"Period {i}"))
    return (
        cells.groupBy(F.col("label").alias("cohort_label"), "cohort_start")
        .agg(*out)
        .orderBy("cohort_start", "cohort_label")
        .drop("cohort_start")
    )
