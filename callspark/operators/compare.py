"""Comparison of groups over two periods, cross-tabs and their long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import connected, rate, total

DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def group_metrics(df: DataFrame, group: str, metrics: list[str], suffix: str) -> DataFrame:
    """``count``, ``connection_rate`` or the sum of a column per non-null group."""
    out: list[Column] = []
    for m in metrics:
        if m == "count":
            value = F.count(F.lit(1)).cast("double")
        elif m == "connection_rate":
            value = rate(connected())
        elif m in df.columns:
            value = total(m)
        else:
            continue
        out.append(value.alias(f"{m}_{suffix}"))
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*out)


def merge_groups(current: DataFrame, previous: DataFrame, group: str) -> DataFrame:
    """Full outer merge on the group; what one side lacks counts as 0."""
    return current.join(previous, group, "full").fillna(0)


def compare_groups(current: DataFrame, previous: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Current, previous, delta and change % per group.

    A change is limited to +-100. Without a previous value it is the delta relative to
    the largest value of the metric in either period.
    """
    out = merge_groups(
        group_metrics(current, group, metrics, "Current"),
        group_metrics(previous, group, metrics, "Previous"),
        group,
    )
    merged = out
    for m in metrics:
        if f"{m}_Current" not in merged.columns:
            continue
        cur, prev = F.col(f"{m}_Current"), F.col(f"{m}_Previous")
        delta = cur - prev
        top = merged.agg(F.max(F.greatest(F.abs(cur), F.abs(prev)))).scalar()
        largest = F.greatest(top, F.lit(1e-9))
        new = F.signum(delta) * F.least(F.lit(100.0), F.abs(delta) / largest * 100)
        known = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), delta / F.abs(prev) * 100))
        out = out.withColumn(f"{m}_Delta", delta).withColumn(
            f"{m}_Change", F.when(prev == 0, new).otherwise(known)
        )
    return out


def comparison_long(comparison: DataFrame, group: str) -> DataFrame:
    """(group, Metric, Period, Value) rows of a comparison; nulls dropped, sorted."""
    wide = [c for c in comparison.columns if c.endswith(("_Current", "_Previous"))]
    melted = comparison.select(F.col(group).cast("string"), *[F.col(c).cast("double") for c in wide])
    name = F.col("MetricPeriod")
    return (
        melted.unpivot(group, wide, "MetricPeriod", "Value")
        .where(F.col("Value").isNotNull())
        .select(
            group,
            F.regexp_replace(name, "_(Current|Previous)$", "").alias("Metric"),
            F.when(name.endswith("_Current"), "Current").otherwise("Previous").alias("Period"),
            "Value",
        )
        .orderBy("Metric", group, "Period")
    )


def cross_tab(df: DataFrame, row: str, column: str, rows: list[str], columns: list[str]) -> DataFrame:
    """(row, column, items) for every pair of the two domains, plus an ``All`` per row.

    Zero cells come from literal domains; the table itself is only counted.
    """
    counts = (
        df.where(F.col(row).isin(rows))
        .groupBy(row)
        .agg(
            F.count(F.lit(1)).alias("n_all"),
            *[F.count_if(F.col(column) == c).alias(f"n_{i}") for i, c in enumerate(columns)],
        )
    )
    spine = df.sparkSession.createDataFrame(
        [(r, i) for i, r in enumerate(rows)], f"`{row}` string, row_order int"
    )
    cells = [
        F.struct(F.lit(c).alias(column), F.coalesce(F.col(n), F.lit(0)).alias("items"))
        for c, n in [("All", "n_all"), *[(c, f"n_{i}") for i, c in enumerate(columns)]]
    ]
    return spine.join(counts, row, "left").select(row, "row_order", F.inline(F.array(*cells)))


def board_order(df: DataFrame, status: str, priority: str, title: str, priorities: list[str]) -> DataFrame:
    """Items by status, priority rank (unknown last) and title without regard to case."""
    rank = F.lit(99)
    for i, p in enumerate(priorities):
        rank = F.when(F.col(priority) == p, i).otherwise(rank)
    return df.withColumn("priority_rank", rank).orderBy(status, "priority_rank", F.lower(title))


def hour_by_weekday(df: DataFrame) -> DataFrame:
    """Calls per hour and weekday; all seven days are present, absent ones 0."""
    day = F.date_format("timestamp", "EEEE")
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(F.hour("timestamp").alias("hour"))
        .agg(*[F.count_if(day == d).alias(d) for d in DAYS])
    )
