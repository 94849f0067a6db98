"""Predicates over the call table.

Every filter is a ``Column`` condition, so several of them fold into one conjunction
that reaches the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timedelta
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.parsing import phone_ok
from ..functions.quantiles import percentile_row
from ..functions.skew import join_per_key
from ..schema import first_present


def date_range(df: DataFrame, start: Any = None, end: Any = None, column: str = "timestamp") -> DataFrame:
    """Inclusive at both ends; an absent end is open."""
    return df.where(_range(F.col(column), start, end))


def day_range(df: DataFrame, first: date, last: date, column: str = "timestamp") -> DataFrame:
    """Whole days: from the first day 00:00 to before the day after the last."""
    return df.where(_days(column, first, last))


def in_list(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Rows whose value is in the list; an empty list or absent column keeps all."""
    if not values or column not in df.columns:
        return df
    return df.where(F.col(column).isin(list(values)))


def value_range(
    df: DataFrame, columns: list[str], low: float | None = None, high: float | None = None
) -> DataFrame:
    """Inclusive range on the first of ``columns`` that is present; null fails."""
    column = first_present(df, *columns)
    return df if column is None else df.where(_range(F.col(column), low, high))


def text_contains(df: DataFrame, query: str, columns: list[str] | None = None) -> DataFrame:
    """Literal search without regard to case over the text columns."""
    columns = columns or text_columns(df)
    needle = F.lower(F.lit(query))
    hits = [F.coalesce(F.contains(F.lower(c), needle), F.lit(False)) for c in columns if c in df.columns]
    return df.where(reduce(or_, hits)) if query and hits else df


def text_matches(df: DataFrame, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """Regex search without regard to case; a null text does not match."""
    columns = columns or ["notes", "transcript"]
    hits = _regex_hits(df, pattern, columns)
    return df.where(reduce(or_, hits)) if pattern and hits else df


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _regex_hits(df: DataFrame, pattern: str, columns: list[str]) -> list[Column]:
    return [
        F.coalesce(F.col(c).rlike("(?i)" + pattern), F.lit(False)) for c in columns if c in df.columns
    ]


def _range(column: Column, low: Any, high: Any) -> Column:
    parts = []
    if low is not None:
        parts.append(column >= F.lit(low))
    if high is not None:
        parts.append(column <= F.lit(high))
    return reduce(and_, parts) if parts else F.lit(True)


def _days(column: str, first: date, last: date) -> Column:
    return (F.col(column) >= F.lit(first.isoformat()).cast("timestamp_ntz")) & (
        F.col(column) < F.lit((last + timedelta(days=1)).isoformat()).cast("timestamp_ntz")
    )


@dataclass
class FilterSpec:
    """A stored filter: days, four selections, two ranges and a search pattern."""

    date_range: tuple[date, date] | None = None
    selected_agents: list[str] = field(default_factory=list)
    selected_campaigns: list[str] = field(default_factory=list)
    selected_outcomes: list[str] = field(default_factory=list)
    selected_types: list[str] = field(default_factory=list)
    duration_range: tuple[float, float] = (0.0, float("inf"))
    revenue_range: tuple[float, float] = (0.0, float("inf"))
    search_query: str = ""

    def to_dict(self) -> dict[str, Any]:
        days = [d.isoformat() for d in self.date_range] if self.date_range else None
        return {
            **self.__dict__,
            "date_range": days,
            "duration_range": list(self.duration_range),
            "revenue_range": list(self.revenue_range),
        }

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> FilterSpec:
        spec = cls(**{k: v for k, v in data.items() if k in cls.__dataclass_fields__})
        if spec.date_range:
            spec.date_range = tuple(
                d if isinstance(d, date) else date.fromisoformat(d) for d in spec.date_range
            )
        spec.duration_range = tuple(spec.duration_range)
        spec.revenue_range = tuple(spec.revenue_range)
        return spec

    def condition(self, df: DataFrame) -> Column:
        """The whole spec as one conjunction over the columns that ``df`` has."""
        parts: list[Column] = [F.lit(True)]
        if self.date_range and "timestamp" in df.columns:
            parts.append(_days("timestamp", *self.date_range))
        for column, values in (
            ("agent_id", self.selected_agents),
            ("campaign", self.selected_campaigns),
            ("outcome", self.selected_outcomes),
            ("call_type", self.selected_types),
        ):
            if values and column in df.columns:
                parts.append(F.col(column).isin(list(values)))
        for column, (low, high) in (
            ("duration", self.duration_range),
            ("revenue", self.revenue_range),
        ):
            if column in df.columns:
                parts.append(F.col(column).between(F.lit(float(low)), F.lit(float(high))))
        if self.search_query:
            hits = _regex_hits(df, self.search_query, ["notes", "transcript"])
            parts += [reduce(or_, hits)] if hits else []
        return reduce(and_, parts)

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.condition(df))


def complex_filter(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Filter from a configuration mapping; absent keys put no condition."""
    if "date_range" in config:
        df = date_range(df, *config["date_range"])
    for key, column in (
        ("call_types", "call_type"),
        ("outcomes", "outcome"),
        ("agents", "agent_id"),
        ("campaigns", "campaign"),
    ):
        df = in_list(df, column, config.get(key))
    if "duration_range" in config:
        df = value_range(df, ["duration_seconds", "duration"], *config["duration_range"])
    if "amount_range" in config:
        df = value_range(df, ["amount", "revenue"], *config["amount_range"])
    if config.get("search_query"):
        df = text_contains(df, config["search_query"], config.get("search_columns"))
    return df


def preset_days(preset: str, as_of: date) -> tuple[date, date]:
    """First and last day of a named range, counted from ``as_of``."""
    first_of_month = as_of.replace(day=1)
    end_of_last_month = first_of_month - timedelta(days=1)
    ranges = {
        "Today": (as_of, as_of),
        "Yesterday": (as_of - timedelta(days=1),) * 2,
        "Last 7 Days": (as_of - timedelta(days=6), as_of),
        "Last 30 Days": (as_of - timedelta(days=29), as_of),
        "Last 90 Days": (as_of - timedelta(days=89), as_of),
        "This Month": (first_of_month, as_of),
        "Last Month": (end_of_last_month.replace(day=1), end_of_last_month),
        "This Year": (as_of.replace(month=1, day=1), as_of),
        "today": (as_of, as_of),
        "yesterday": (as_of - timedelta(days=1),) * 2,
        "last_week": (as_of - timedelta(days=7), as_of),
        "last_month": (as_of - timedelta(days=30), as_of),
    }
    return ranges.get(preset, (as_of, as_of))


PRESETS = [
    "Today", "Yesterday", "Last 7 Days", "Last 30 Days", "Last 90 Days",
    "This Month", "Last Month", "This Year",
]


def preset_counts(df: DataFrame, as_of: date) -> DataFrame:
    """Rows per named range in one pass: a row is emitted for each range it is in."""
    names = [
        F.when(_days("timestamp", *preset_days(p, as_of)), F.lit(p)) for p in PRESETS
    ]
    return (
        df.select(F.explode(F.array_compact(F.array(*names))).alias("preset"))
        .groupBy("preset")
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def filter_report(df: DataFrame, condition: Column) -> DataFrame:
    """Original rows, kept rows and the reduction in percent, in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("original_count"), F.count_if(condition).alias("filtered_count")
    )
    gone = F.col("original_count") - F.col("filtered_count")
    percent = F.when(F.col("original_count") > 0, gone * 100.0 / F.col("original_count"))
    return counts.withColumn("reduction_percentage", F.coalesce(percent, F.lit(0.0)))


def quick_predicate(name: str, as_of: date | None = None) -> Column:
    """Named predicates of the filter bar."""
    predicates = {
        "connected": lambda: F.col("outcome") == "connected",
        "failed": lambda: F.col("outcome").isin("failed", "no_answer"),
        "long": lambda: F.col("duration") > 300,
        "revenue": lambda: F.col("revenue") > 0,
        "today": lambda: _days("timestamp", as_of, as_of),
    }
    return predicates[name]()


QUICK = ["connected", "failed", "long", "revenue", "today"]


def segments(df: DataFrame, as_of: datetime) -> DataFrame:
    """One row per (segment, call): a call can be in several segments.

    The thresholds are scalar subqueries. Only the segment of frequent callers needs a join:
    calls with a phone number meet the numbers that an aggregate has found often.
    """
    high_revenue = percentile_row(df, "revenue", [75]).scalar()
    long_call = percentile_row(df, "duration", [75]).scalar()
    per_phone = (
        df.where(F.col("phone_number").isNotNull())
        .groupBy("phone_number")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where("n_rows > 3")
    )
    recent = F.lit((as_of - timedelta(days=7)).isoformat()).cast("timestamp_ntz")
    rules = [
        ("high_value", F.col("revenue") > high_revenue),
        ("long_calls", F.col("duration") > long_call),
        ("failed_calls", F.col("outcome").isin("failed", "no_answer", "busy")),
        ("recent_calls", F.col("timestamp") > recent),
    ]
    names = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules]))
    frequent = join_per_key(df, per_phone.select("phone_number"), ["phone_number"], "left_semi")
    return df.withColumn("segment", F.explode(names)).unionByName(
        frequent.withColumn("segment", F.lit("frequent_callers"))
    )


def phone_split(df: DataFrame, region: str = "US") -> DataFrame:
    """Adds ``phone_valid``; filter on it for the kept rows and the quarantine."""
    return df.withColumn("phone_valid", phone_ok(F.col("phone_number"), region))


def valid_phones(df: DataFrame, skip_invalid: bool = True, region: str = "US") -> DataFrame:
    """Rows with a valid phone; strict mode raises when there is any other row."""
    tagged = phone_split(df, region)
    if not skip_invalid and not tagged.where("not phone_valid").isEmpty():
        raise ValueError("invalid phone numbers; allow skipping them to continue")
    return tagged.where("phone_valid").drop("phone_valid")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)
