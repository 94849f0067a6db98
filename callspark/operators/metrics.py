"""KPI aggregates. One scan per result, with every shuffle after a partial aggregate."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import METRIC_ALIASES
from ..functions.quantiles import log_cell, percentile_name, percentile_row, select_from_cells
from ..functions.text import round_up


def connected() -> Column:
    """Connected test of the group tables: exact text, null counts as not connected."""
    return F.coalesce(F.col("outcome") == "connected", F.lit(False))


def rate(condition: Column) -> Column:
    """Share of all rows in percent; 0 without rows."""
    percent = F.count_if(condition) * 100.0 / F.nullif(F.count(F.lit(1)), F.lit(0))
    return F.coalesce(percent, F.lit(0.0))


def total(column: str | Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0.0))


def _basic_columns(df: DataFrame) -> list[Column]:
    out = [F.count(F.lit(1)).alias("total_calls")]
    if "outcome" in df.columns:
        any_case = F.coalesce(F.lower("outcome") == "connected", F.lit(False))
        out += [F.count_if(any_case).alias("connected_calls"), rate(any_case).alias("connection_rate")]
    if "duration" in df.columns:
        out += [F.avg("duration").alias("avg_duration"), total("duration").alias("total_duration")]
    if "revenue" in df.columns:
        out += [total("revenue").alias("total_revenue"), F.avg("revenue").alias("avg_revenue")]
    return out


def _revenue_per_minute() -> Column:
    return F.when(
        F.col("total_duration") > 0, F.col("total_revenue") / (F.col("total_duration") / 60)
    ).otherwise(F.lit(0.0))


def basic_kpis(df: DataFrame) -> DataFrame:
    """One row: totals, connection rate, duration and revenue figures."""
    out = df.agg(*_basic_columns(df))
    if "duration" in df.columns:
        median = percentile_row(df, "duration", [50]).scalar()
        out = out.withColumn("median_duration", median)
        if "revenue" in df.columns:
            out = out.withColumn("revenue_per_minute", _revenue_per_minute())
    return out


def _long(row: DataFrame, section: str, names: list[str]) -> DataFrame:
    """One row of numbers as (section, metric, value, text_value) rows."""
    pairs = [
        F.struct(
            F.lit(section).alias("section"),
            F.lit(n).alias("metric"),
            F.col(n).cast("double").alias("value"),
            F.lit(None).cast("string").alias("text_value"),
        )
        for n in names
        if n in row.columns
    ]
    return row.select(F.inline(F.array(*pairs)))


def all_kpis(df: DataFrame, percents: tuple[float, ...] = (25, 50, 75, 90, 95)) -> DataFrame:
    """Long table (section, metric, value, text_value) of every KPI group.

    One wide aggregate feeds the overview, duration, revenue, time and entity sections.
    An empty table gives the three overview zeros only.
    """
    stats = df.agg(
        *_basic_columns(df),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.count_distinct("agent_id").alias("unique_agents"),
        F.count_distinct("campaign").alias("active_campaigns"),
    )
    points = percentile_row(df, "duration", list(percents))
    point = points.select(F.struct("*")).scalar()
    median = percentile_row(df, "duration", [50]).scalar() if 50 not in percents else point["p50"]
    filled = F.col("total_calls") > 0
    days = F.greatest(F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")), F.lit(0)) + 1
    stats = (
        stats.withColumn("median_duration", median)
        .withColumn("revenue_per_minute", _revenue_per_minute())
        .withColumn("active_days", days)
        .withColumn("calls_per_day", F.col("total_calls") / F.col("active_days"))
    )
    for p in percents:
        name = percentile_name(p)
        stats = stats.withColumn(name, point[name])

    def entry(section: str, name: str, value: Column | None = None, text: Column | None = None) -> Column:
        number = (F.col(name) if value is None and text is None else value)
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(name).alias("metric"),
            (number.cast("double") if number is not None else F.lit(None).cast("double")).alias("value"),
            (text if text is not None else F.lit(None).cast("string")).alias("text_value"),
        )

    overview = [entry("overview", n) for n in ("total_calls", "connected_calls", "connection_rate")]
    rest = [entry("duration_metrics", n) for n in ("avg_duration", "median_duration", "total_duration")]
    rest += [entry("duration_metrics", percentile_name(p)) for p in percents]
    rest += [entry("revenue_metrics", n) for n in ("total_revenue", "avg_revenue", "revenue_per_minute")]
    times = [entry("time_metrics", n) for n in ("active_days", "calls_per_day")]
    times += [
        entry("time_metrics", "first_call", text=F.date_format("first_ts", "yyyy-MM-dd")),
        entry("time_metrics", "last_call", text=F.date_format("last_ts", "yyyy-MM-dd")),
    ]
    rest += [entry("entity_metrics", n) for n in ("unique_agents", "active_campaigns")]
    empty = F.filter(F.array(overview[0]), lambda e: F.lit(False))
    wide = stats.select(
        F.inline(
            F.concat(
                F.array(*overview),
                F.when(filled, F.array(*rest)).otherwise(empty),
                F.when(F.col("first_ts").isNotNull(), F.array(*times)).otherwise(empty),
            )
        )
    )
    shares = outcome_distribution(df)
    outcomes = shares.select(
        F.inline(
            F.array(
                _entry("outcome_distribution", F.concat("outcome", F.lit("_calls")), F.col("calls")),
                _entry(
                    "outcome_distribution_percentage",
                    F.concat("outcome", F.lit("_pct")),
                    F.col("percentage"),
                ),
            )
        )
    )
    return wide.unionByName(outcomes)


def _entry(section: str, metric: Column, value: Column) -> Column:
    return F.struct(
        F.lit(section).alias("section"),
        metric.alias("metric"),
        value.cast("double").alias("value"),
        F.lit(None).cast("string").alias("text_value"),
    )


def percentiles(df: DataFrame, column: str, percents: list[float]) -> DataFrame:
    """Rows (percentile, value) with linear interpolation."""
    row = percentile_row(df, column, percents)
    pairs = [
        F.struct(F.lit(percentile_name(p)).alias("percentile"), F.col(percentile_name(p)).alias("value"))
        for p in percents
    ]
    return row.select(F.inline(F.array(*pairs)))


def approx_percentiles(df: DataFrame, column: str, percents: list[float], accuracy: int = 10000) -> DataFrame:
    """Approximate form for interactive use; one pass, bounded memory."""
    values = df.agg(F.approx_percentile(column, [p / 100 for p in percents], accuracy).alias("v"))
    pairs = [
        F.struct(F.lit(percentile_name(p)).alias("percentile"), F.get("v", F.lit(i)).alias("value"))
        for i, p in enumerate(percents)
    ]
    return values.select(F.inline(F.array(*pairs)))


def time_span(df: DataFrame) -> DataFrame:
    """Active days (whole days between first and last call, plus 1) and calls per day."""
    span = df.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.min("timestamp").alias("a"),
        F.max("timestamp").alias("b"),
    ).where("a is not null")
    days = F.greatest(F.timestamp_diff("DAY", F.col("a"), F.col("b")), F.lit(0)) + 1
    return span.select(
        days.alias("active_days"),
        (F.col("total_calls") / days).alias("calls_per_day"),
        F.date_format("a", "yyyy-MM-dd").alias("first_call"),
        F.date_format("b", "yyyy-MM-dd").alias("last_call"),
    )


def entity_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        count("agent_id").alias("unique_agents"), count("campaign").alias("active_campaigns")
    )


def agent_table(df: DataFrame) -> DataFrame:
    """Per agent: calls, duration, revenue and connection rate, most calls first."""
    return (
        df.where(F.col("agent_id").isNotNull())
        .groupBy("agent_id")
        .agg(
            F.count("call_id").alias("total_calls"),
            F.avg("duration").alias("duration_mean"),
            total("duration").alias("duration_sum"),
            total("revenue").alias("revenue_sum"),
            F.avg("revenue").alias("revenue_mean"),
            rate(connected()).alias("connection_rate"),
        )
        .orderBy(F.desc("total_calls"), "agent_id")
    )


def campaign_table(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("campaign").isNotNull())
        .groupBy("campaign")
        .agg(
            F.count("call_id").alias("total_calls"),
            rate(connected()).alias("connection_rate"),
            F.avg("duration").alias("avg_duration"),
            total("revenue").alias("revenue_sum"),
            F.avg("revenue").alias("revenue_mean"),
        )
        .orderBy(F.desc("total_calls"), "campaign")
    )


def outcome_distribution(df: DataFrame) -> DataFrame:
    """Calls per outcome and their share of the calls that have an outcome."""
    counts = (
        df.where(F.col("outcome").isNotNull())
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    share = F.col("calls") * 100.0 / F.sum("calls").over(Window.partitionBy())
    return counts.withColumn("percentage", share).orderBy(F.desc("calls"), "outcome")


def _period_columns() -> list[Column]:
    return [
        F.count("call_id").alias("calls"),
        rate(connected()).alias("connection_rate"),
        F.avg("duration").alias("avg_duration"),
        total("revenue").alias("total_revenue"),
    ]


def hourly_table(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(F.hour("timestamp").alias("hour"))
        .agg(*_period_columns())
        .orderBy("hour")
    )


PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}


def trends(df: DataFrame, period: str = "daily") -> DataFrame:
    """KPIs per day, Monday week or month; the period column holds its first day."""
    if period not in PERIODS:
        raise ValueError(f"invalid period: {period}")
    start = F.date_format(F.date_trunc(PERIODS[period], "timestamp"), "yyyy-MM-dd")
    return (
        df.where(F.col("timestamp").isNotNull())
        .groupBy(start.alias("period"))
        .agg(*_period_columns())
        .orderBy("period")
    )


DEFAULT_STAGES = ["attempted", "connected", "qualified", "converted"]


def funnel(df: DataFrame, stages: list[str] = DEFAULT_STAGES) -> DataFrame:
    """Calls per stage and their share of the stage before (the first: of all calls).

    All stages are counted in one pass; a stage list is short, so no join is needed.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == s).alias(f"s{i}") for i, s in enumerate(stages)],
    )
    rows = []
    for i, stage in enumerate(stages):
        base = F.col("total") if i == 0 else F.col(f"s{i - 1}")
        share = F.when(base > 0, F.col(f"s{i}") * 100.0 / base).otherwise(F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(i + 1).alias("stage_no"),
                F.lit(stage).alias("stage"),
                F.col(f"s{i}").alias("count"),
                share.alias("percentage"),
                share.alias("conversion_rate"),
            )
        )
    return counts.select(F.inline(F.array(*rows)))


def compare_kpis(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current, previous, change and change % of every KPI with previous not 0."""
    now = current.withColumn("is_current", F.lit(True))
    return _compared(now.unionByName(previous.withColumn("is_current", F.lit(False)), allowMissingColumns=True))


def compare_periods(df: DataFrame, first: date, last: date) -> DataFrame:
    """``compare_kpis`` of the period and of the one before it, each row read once per pass."""
    return _compared(_both_periods(df, first, last))


def _compared(tagged: DataFrame) -> DataFrame:
    """KPIs of the rows with ``is_current`` beside those of the others, in three passes.

    The first pass aggregates by period and cell of the duration: these rows give the counts
    and sums of both periods, and are the first counting pass of both medians.
    """
    has = {c: c in tagged.columns for c in ("outcome", "duration", "revenue")}
    x = F.col("duration").cast("double") if has["duration"] else F.lit(None).cast("double")
    rows = tagged.withColumn("x", x)
    known = F.col("x").isNotNull() & ~F.isnan("x")
    parts = [F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    if has["outcome"]:
        parts.append(F.count_if(F.coalesce(F.lower("outcome") == "connected", F.lit(False))).alias("connected"))
    for c in ("duration", "revenue"):
        if has[c]:
            parts += [F.count(c).alias(f"n_{c}"), F.sum(F.col(c).cast("double")).alias(f"sum_{c}")]
    cells = rows.groupBy("is_current", F.when(known, log_cell("x")).alias("c1")).agg(*parts)
    medians = select_from_cells(
        rows.where(known).select("is_current", "x"), cells.where("c1 is not null").select("is_current", "c1", "n", "lo", "hi"), [50], ("is_current",)
    )
    median = medians.agg(F.max_by("p50", F.when(F.col("is_current"), 1)).alias("cur"), F.max_by("p50", F.when(~F.col("is_current"), 1)).alias("prev"))
    median = median.select(F.struct("*")).scalar()
    counted = [c for c in cells.columns if c not in ("is_current", "c1", "lo", "hi")]
    tags = {"cur": F.col("is_current"), "prev": ~F.col("is_current")}
    one = cells.agg(*[F.sum(F.when(mine, F.col(c))).alias(f"{tag}_{c}") for tag, mine in tags.items() for c in counted])

    def kpis(tag: str) -> dict[str, Column]:
        get = lambda c: F.col(f"{tag}_{c}")
        n = F.coalesce(get("n"), F.lit(0))
        out = {"total_calls": n}
        if has["outcome"]:
            out["connected_calls"] = F.coalesce(get("connected"), F.lit(0))
            out["connection_rate"] = F.coalesce(get("connected") * 100.0 / F.nullif(n, F.lit(0)), F.lit(0.0))
        for c in ("duration", "revenue"):
            if has[c]:
                out[f"total_{c}"] = F.coalesce(get(f"sum_{c}"), F.lit(0.0))
                out[f"avg_{c}"] = get(f"sum_{c}") / F.nullif(get(f"n_{c}"), F.lit(0))
        if has["duration"]:
            out["median_duration"] = median[tag]
            if has["revenue"]:
                minutes = out["total_duration"] / 60
                out["revenue_per_minute"] = F.when(minutes > 0, out["total_revenue"] / minutes).otherwise(F.lit(0.0))
        return out

    now, before = kpis("cur"), kpis("prev")
    pairs = [
        F.struct(F.lit(k).alias("metric"), now[k].cast("double").alias("current"), before[k].cast("double").alias("previous")) for k in now
    ]
    change = F.col("current") - F.col("previous")
    return (
        one.select(F.inline(F.array(*pairs)))
        .where((F.col("previous") != 0) & F.col("current").isNotNull())
        .withColumn("change", change)
        .withColumn("change_percentage", F.col("change") / F.col("previous") * 100)
    )


def previous_period(first: date, last: date) -> tuple[date, date]:
    """The period of the same length that ends the day before ``first``."""
    prev_last = first - timedelta(days=1)
    return prev_last - (last - first), prev_last


def _in_days(first: date, last: date) -> Column:
    from .filters import _days

    return F.coalesce(_days("timestamp", first, last), F.lit(False))


def _both_periods(df: DataFrame, first: date, last: date) -> DataFrame:
    """Rows of the period and of the one before, in one scan with an ``is_current`` flag."""
    prev_first, _ = previous_period(first, last)
    return df.where(_in_days(prev_first, last)).withColumn("is_current", _in_days(first, last))


def call_block(df: DataFrame, first: date, last: date) -> DataFrame:
    """Call KPIs of a period with the change from the period before."""

    def part(cur: bool) -> list[Column]:
        here = F.col("is_current") == cur
        tag = "cur" if cur else "prev"
        return [
            F.count_if(here).alias(f"{tag}_total"),
            F.count_if(here & connected()).alias(f"{tag}_connected"),
            (F.avg(F.when(here, F.col("duration"))) / 60).alias(f"{tag}_duration"),
        ]

    one = _both_periods(df, first, last).agg(*part(True), *part(False))
    for tag in ("cur", "prev"):
        share = F.when(F.col(f"{tag}_total") > 0, F.col(f"{tag}_connected") * 100.0 / F.col(f"{tag}_total"))
        one = one.withColumn(f"{tag}_rate", F.coalesce(share, F.lit(0.0)))
    metrics = [
        ("total_calls", "total"), ("connected_calls", "connected"),
        ("connection_rate", "rate"), ("avg_duration_minutes", "duration"),
    ]
    return _delta_rows(one, metrics)


def revenue_block(df: DataFrame, first: date, last: date) -> DataFrame:
    """Revenue KPIs of a period with the change; the average is over all rows."""

    def part(cur: bool) -> list[Column]:
        here = F.col("is_current") == cur
        tag = "cur" if cur else "prev"
        return [
            F.count_if(here).alias(f"{tag}_n"),
            F.coalesce(F.sum(F.when(here, F.col("revenue"))), F.lit(0.0)).alias(f"{tag}_revenue"),
            F.count_if(here & (F.col("revenue") > 0)).alias(f"{tag}_calls"),
        ]

    one = _both_periods(df, first, last).agg(*part(True), *part(False))
    for tag in ("cur", "prev"):
        n = F.nullif(F.col(f"{tag}_n"), F.lit(0))
        one = one.withColumn(f"{tag}_avg", F.coalesce(F.col(f"{tag}_revenue") / n, F.lit(0.0)))
        one = one.withColumn(
            f"{tag}_conversion", F.coalesce(F.col(f"{tag}_calls") * 100.0 / n, F.lit(0.0))
        )
    one = one.withColumn("prev_total", F.col("prev_n"))
    metrics = [
        ("total_revenue", "revenue"), ("revenue_calls", "calls"),
        ("avg_revenue_per_call", "avg"), ("conversion_rate", "conversion"),
    ]
    return _delta_rows(one, metrics)


def _delta_rows(one: DataFrame, metrics: list[tuple[str, str]]) -> DataFrame:
    """(metric, value, delta); without a previous row every delta is 0."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(f"cur_{tag}").cast("double").alias("value"),
            F.when(
                F.col("prev_total") > 0,
                F.col(f"cur_{tag}").cast("double") - F.col(f"prev_{tag}").cast("double"),
            ).otherwise(F.lit(0.0)).alias("delta"),
        )
        for name, tag in metrics
    ]
    return one.select(F.inline(F.array(*rows)))


def column_summary(df: DataFrame, column: str, percents: tuple[float, ...] = (25, 50, 75, 95)) -> DataFrame:
    """One row: count, mean, std, min, max, sum, percentiles, range and cv in percent."""
    stats = df.agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
        total(column).alias("sum"),
    )
    point = percentile_row(df, column, list(percents)).select(F.struct("*")).scalar()
    for p in percents:
        stats = stats.withColumn(percentile_name(p), point[percentile_name(p)])
    cv = F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100).otherwise(F.lit(0.0))
    return stats.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", cv)


def dataset_statistics(df: DataFrame, status: str = "connection_status") -> DataFrame:
    """Long table (section, metric, value): totals, three breakdowns, duration, entities."""
    one = df.agg(
        F.count(F.lit(1)).alias("total_calls"),
        rate(F.coalesce(F.col(status) == "Connected", F.lit(False))).alias("connected_percentage"),
        F.avg("duration").alias("mean"),
        F.min("duration").alias("min"),
        F.max("duration").alias("max"),
        F.count_distinct("agent_id").alias("unique_agents"),
        F.count_distinct("campaign").alias("unique_campaigns"),
    ).withColumn("median", percentile_row(df, "duration", [50]).scalar())
    plan = [("total", n) for n in ("total_calls", "connected_percentage", "unique_agents", "unique_campaigns")]
    plan += [("duration", n) for n in ("mean", "median", "min", "max")]
    totals = one.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(s).alias("section"),
                        F.lit(n).alias("metric"),
                        F.col(n).cast("double").alias("value"),
                    )
                    for s, n in plan
                ]
            )
        )
    )
    return totals.unionByName(breakdowns(df, [status, "call_type", "outcome"]))


def breakdowns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts per value of several columns in one scan; nulls are left out."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("metric")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .where(F.col("metric").isNotNull())
        .groupBy("section", "metric")
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


AGGREGATES = {
    "sum": total,
    "mean": F.avg,
    "count": F.count,
    "min": F.min,
    "max": F.max,
}


def ad_hoc(df: DataFrame, group: str, column: str, function: str) -> DataFrame:
    """One of sum, mean, median, count, min, max of a column per group."""
    if function != "median" and function not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {function}")
    kept = df.where(F.col(group).isNotNull())
    if function == "median":
        return group_medians(kept, group, column)
    return kept.groupBy(group).agg(AGGREGATES[function](F.col(column)).cast("double").alias("value"))


def group_medians(df: DataFrame, group: str, column: str) -> DataFrame:
    """Exact median per group without holding a group's values in one buffer.

    Three counting passes over (group, cell) keys, each a hash aggregate: the cell that
    holds the middle rank is found, then its parts, then its values.
    """
    from ..functions.quantiles import _keep_hit, _next_hits, inner_cell, log_cell

    x = df.select(F.col(group).alias("g"), F.col(column).cast("double").alias("x")).where(
        "x is not null and not isnan(x)"
    )
    grid = log_cell("x")
    cells = x.groupBy("g", grid.alias("c1")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    running = Window.partitionBy("g").orderBy("c1").rowsBetween(Window.unboundedPreceding, 0)
    place = (F.col("total") - 1) / 2
    hit1 = _keep_hit(
        cells.withColumn("end", F.sum("n").over(running))
        .withColumn("start", F.col("end") - F.col("n"))
        .withColumn("total", F.sum("n").over(Window.partitionBy("g")))
        .withColumn("ranks", F.array(F.floor(place), F.ceil(place))),
        "start",
        "end",
    ).select("g", "c1", "lo", "hi", "start", "total", "ranks")
    # Only rows of the one or two cells per group that hold a middle rank are counted by value.
    parts = (
        x.withColumn("c1", grid)
        .join(hit1, ["g", "c1"])
        .groupBy("g", "c1", inner_cell().alias("c2"), "start", "total", "ranks", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit2 = _next_hits(
        parts.groupBy("g", "c1", "c2", "start", "total", "ranks").agg(F.sum("n").alias("n")),
        ["g", "c1"],
        "c2",
    ).select("g", "c1", "c2", "start", "total", "ranks")
    values = parts.select("g", "c1", "c2", "x", "n").join(hit2, ["g", "c1", "c2"])
    found = _next_hits(values, ["g", "c1", "c2"], "x")
    middle = found.select("g", "x", F.explode("ranks").alias("rank")).distinct()
    return middle.groupBy(F.col("g").alias(group)).agg(F.avg("x").alias("value"))


def top_agents(df: DataFrame, metric: str = "calls", n: int = 10) -> DataFrame:
    """Top n agents by calls, hours or revenue; an unknown metric counts calls."""
    measure = {
        "duration": total("duration") / 3600,
        "revenue": total("revenue"),
    }.get(metric, F.count(F.lit(1)).cast("double"))
    return (
        df.where(F.col("agent_id").isNotNull())
        .groupBy("agent_id")
        .agg(measure.alias("value"))
        .orderBy(F.desc("value"), "agent_id")
        .limit(n)
    )


def campaign_compare(df: DataFrame) -> DataFrame:
    return (
        df.where(F.col("campaign").isNotNull())
        .groupBy("campaign")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            rate(connected()).alias("connection_rate"),
            (F.avg("duration") / 60).alias("avg_minutes"),
            total("revenue").alias("revenue"),
        )
    )


def ranked_agents(df: DataFrame) -> DataFrame:
    """Agent table with rank 1..n by calls and the mean number of calls per agent.

    The window runs over one row per agent, not over the calls.
    """
    agents = (
        df.where(F.col("agent_id").isNotNull())
        .groupBy("agent_id")
        .agg(
            F.count(F.lit(1)).alias("total_calls"),
            rate(connected()).alias("connection_rate"),
            (F.avg("duration") / 60).alias("avg_duration"),
            total("revenue").alias("total_revenue"),
            F.avg("revenue").alias("avg_revenue"),
        )
    )
    order = Window.orderBy(F.desc("total_calls"), "agent_id")
    return agents.withColumn("rank", F.row_number().over(order)).withColumn(
        "mean_calls_per_agent", F.avg("total_calls").over(Window.partitionBy())
    )


def agent_answer(df: DataFrame) -> DataFrame:
    """Calls, mean duration and revenue per agent, rounded for an answer."""
    return (
        df.where(F.col("agent_id").isNotNull())
        .groupBy("agent_id")
        .agg(
            F.count("call_id").alias("calls"),
            round_up(F.avg("duration"), 2).alias("avg_duration"),
            round_up(total("revenue"), 2).alias("revenue"),
        )
    )


def compare_answer(df: DataFrame, what: str = "agents") -> DataFrame:
    """Agents by calls and connection rate, or campaigns by calls and revenue."""
    if what == "agents":
        kept = df.where(F.col("agent_id").isNotNull()).groupBy("agent_id")
        return kept.agg(
            F.count("call_id").alias("calls"),
            round_up(rate(connected()), 2).alias("connection_rate"),
        )
    kept = df.where(F.col("campaign").isNotNull()).groupBy("campaign")
    return kept.agg(
        F.count("call_id").alias("calls"), round_up(total("revenue"), 2).alias("revenue")
    )


def metric_name(name: str | None) -> str:
    """Canonical name of a metric alias; ``general`` when unknown."""
    wanted = (name or "").lower()
    hits = [k for k, aliases in METRIC_ALIASES.items() if wanted == k or wanted in aliases]
    return hits[0] if hits else "general"


def metric_answer(df: DataFrame, metric: str | None = None) -> DataFrame:
    """(metric, value) rows for one asked metric, or the general set."""
    one = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_calls"),
        (F.avg("duration") / 60).alias("average_duration"),
        rate(connected()).alias("connection_rate"),
        total("revenue").alias("total_revenue"),
    )
    name = metric_name(metric)
    names = list(one.columns) if name == "general" else [name]
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names]
    return one.select(F.inline(F.array(*pairs)))


def duration_histogram(df: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width bins of the duration in minutes, with zero bins, mean and median."""
    minutes = df.where(F.col("duration").isNotNull()).select((F.col("duration") / 60).alias("m"))
    edge = minutes.agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.avg("m").alias("mean"))
    edge = edge.where("lo is not null").withColumn(
        "median", percentile_row(df, F.col("duration") / 60, [50]).scalar()
    )
    bounds = edge.select(F.struct("lo", "hi")).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    width = (hi - lo) / bins
    number = F.when(width > 0, F.least(F.floor((F.col("m") - lo) / width), F.lit(bins - 1)))
    counts = minutes.groupBy(F.coalesce(number, F.lit(0)).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("calls")
    )
    step = (F.col("hi") - F.col("lo")) / bins
    spine = edge.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).select(
        "bin",
        (F.col("lo") + step * F.col("bin")).alias("low"),
        (F.col("lo") + step * (F.col("bin") + 1)).alias("high"),
        "mean",
        "median",
    )
    return spine.join(counts, "bin", "left").withColumn("calls", F.coalesce("calls", F.lit(0)))


def labelling_report(df: DataFrame) -> DataFrame:
    """Counts per label in long form, mean confidence and rows below 0.6."""
    one = df.agg(
        F.count(F.lit(1)).alias("total_calls"),
        F.avg("labeling_confidence").alias("average_confidence"),
        F.count_if(F.col("labeling_confidence") < 0.6).alias("low_confidence_count"),
    )
    names = ["total_calls", "average_confidence", "low_confidence_count"]
    totals = _long(one, "total", names).drop("text_value")
    return totals.unionByName(breakdowns(df, ["connection_status", "call_type", "outcome"]))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: rows beyond the first of each set of equal rows.

    Rows are compared by a 256-bit digest of all their values, so that no transcript is
    shuffled for a count. Each value is preceded by its length, a null is a dash.
    """
    values = [F.col(f"`{c}`").cast("string") for c in df.columns]
    parts = [F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    same = df.groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("n"))
    return same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def quality_score(df: DataFrame, required: list[str]) -> DataFrame:
    """(metric, value) rows of the data quality check and its score from 0 to 100."""
    present = [c for c in required if c in df.columns]
    checks = [F.count(F.lit(1)).alias("total_rows")]
    checks += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in present]
    short = F.length("phone_number") < 10 if "phone_number" in df.columns else F.lit(False)
    negative = F.col("duration") < 0 if "duration" in df.columns else F.lit(False)
    checks += [
        F.count_if(short).alias("invalid_phone_numbers"),
        F.count_if(negative).alias("negative_durations"),
    ]
    one = df.agg(*checks).withColumn("duplicate_rows", duplicate_rows(df).scalar())
    rows = F.nullif(F.col("total_rows"), F.lit(0))
    lost = reduce(
        lambda a, b: a + b,
        [F.coalesce(F.col(f"missing_{c}") / rows * 20, F.lit(0.0)) for c in present],
        F.lit(0.0),
    )
    score = (
        F.lit(100.0)
        - lost
        - F.when(F.col("invalid_phone_numbers") > 0, 5).otherwise(0)
        - F.when(F.col("negative_durations") > 0, 10).otherwise(0)
    )
    one = one.withColumn("quality_score", F.greatest(F.lit(0.0), score))
    pairs = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in one.columns
    ]
    return one.select(F.inline(F.array(*pairs)))


def frame_profile(
    df: DataFrame, required: list[str], types: dict[str, str] | None = None
) -> DataFrame:
    """(column_name, check_name, value, severity) rows: counts, nulls, duplicates, findings."""
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in df.columns],
    ).withColumn("_dup", duplicate_rows(df).scalar())

    def line(column: str, check: str, value: Column, severity: Column | str) -> Column:
        return F.struct(
            F.lit(column).alias("column_name"),
            F.lit(check).alias("check_name"),
            value.cast("double").alias("value"),
            (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        )

    rows = F.col("_rows")
    lines = [
        line("*", "row_count", rows, F.when(rows == 0, "error").otherwise("info")),
        line("*", "column_count", F.lit(len(df.columns)), "info"),
        line("*", "duplicate_rows", F.col("_dup"), "info"),
    ]
    for c in df.columns:
        nulls = F.col(f"_null_{c}")
        bad = F.when(nulls * 100.0 > 50.0 * rows, "warning").otherwise("info")
        lines.append(line(c, "null_count", nulls, bad))
    have = dict(df.dtypes)
    lines += [line(c, "missing_column", F.lit(1), "error") for c in required if c not in have]
    lines += [
        line(c, "type_mismatch", F.lit(1), "warning")
        for c, t in (types or {}).items()
        if c in have and have[c] != t
    ]
    return one.select(F.inline(F.array(*lines)))
