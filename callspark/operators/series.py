"""Time series with filled gaps, moving averages, ranks, newest rows and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: Bucket of each step, and its length in a unit.
STEPS = {
    "hourly": ("hour", "hour", 1),
    "daily": ("day", "day", 1),
    "weekly": ("week", "day", 7),
    "monthly": ("month", "month", 1),
}

#: Buckets that one array holds while a span is filled.
PIECE = 1_000


def _spine(spans: DataFrame, keys: list[str], unit: str, count: int, name: str) -> DataFrame:
    """Every bucket from ``a`` to ``b`` as a row, in pieces, so that no span becomes one array."""
    step = lambda n: F.expr(f"interval {n * count} {unit}")
    pieces = spans.select(*keys, "b", F.explode(F.sequence("a", "b", step(PIECE))).alias("piece"))
    end = F.least(F.col("b"), F.col("piece") + step(PIECE - 1))
    return pieces.select(*keys, F.explode(F.sequence("piece", end, step(1))).alias(name))


def volume_series(df: DataFrame, step: str = "daily", group: str | None = None) -> DataFrame:
    """Calls per bucket with empty buckets as 0; each group spans its own first to last.

    Weeks are labelled by their Sunday, months by their last day.
    """
    unit, of, count = STEPS.get(step, STEPS["daily"])
    keys = [group] if group else []
    dated = df.where(F.col("timestamp").isNotNull())
    if group:
        dated = dated.where(F.col(group).isNotNull())
    start = F.date_trunc(unit, "timestamp").cast("timestamp_ntz")
    counts = dated.groupBy(*keys, start.alias("start")).agg(F.count(F.lit(1)).alias("calls"))
    spans = counts.groupBy(*keys).agg(F.min("start").alias("a"), F.max("start").alias("b")).where("a is not null")
    spine = _spine(spans, keys, of, count, "start")
    label = {
        "week": F.date_format(F.date_add("start", 6), "yyyy-MM-dd"),
        "month": F.date_format(F.last_day("start"), "yyyy-MM-dd"),
        "hour": F.date_format("start", "yyyy-MM-dd HH:mm"),
    }.get(unit, F.date_format("start", "yyyy-MM-dd"))
    filled = spine.join(counts, [*keys, "start"], "left")
    return filled.select(*keys, label.alias("bucket"), F.coalesce("calls", F.lit(0)).alias("calls"))


def moving_averages(
    df: DataFrame, column: str = "calls", windows: tuple[int, ...] = (7, 30)
) -> DataFrame:
    """Daily value (calls, or the mean of a column) and its trailing means.

    The window runs over one row per day.
    """
    day = F.to_date("timestamp")
    value = F.count(F.lit(1)).cast("double") if column == "calls" else F.avg(column)
    dated = df.where(F.col("timestamp").isNotNull())
    daily = dated.groupBy(day.alias("day")).agg(value.alias("value"))
    spans = daily.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null")
    spine = _spine(spans, [], "day", 1, "day").withColumn("day", F.col("day").cast("date"))
    series = spine.join(daily, "day", "left")
    if column == "calls":
        series = series.fillna(0.0, ["value"])
    out = series
    for w in windows:
        frame = Window.orderBy("day").rowsBetween(-(w - 1), 0)
        out = out.withColumn(f"ma_{w}", F.avg("value").over(frame))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def rank_groups(groups: DataFrame, measure: str, key: str) -> DataFrame:
    """Rank 1..n by a measure over an aggregated table (one row per group)."""
    return _ranked(groups, [F.col(measure).desc_nulls_last(), F.col(key)], "rank").withColumn("rank", F.col("rank").cast("int"))


def _ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Adds the place in a global order, from 1.

    The rows are sorted by range over all partitions and written to the checkpoint folder;
    the place is then the row's place in its partition plus the sizes of the partitions
    before it, so no task holds more than its range.
    """
    place = F.monotonically_increasing_id()
    # The checkpoint fixes which row is in which partition before sizes are counted.
    placed = checkpointed(rows.orderBy(*order).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    # One row per partition of the sort, at most spark.sql.shuffle.partitions of them.
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    in_part = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.withColumn(rank, F.col("_offset") + in_part + 1).drop("_place", "_part", "_offset")


def newest(df: DataFrame, n: int = 10) -> DataFrame:
    """The n most recent rows: a top-n per partition, then of those."""
    return df.orderBy(F.col("timestamp").desc_nulls_last(), "call_id").limit(n)


def page_info(df: DataFrame, size: int, page: int) -> DataFrame:
    """One row: rows, pages and the page index clamped to them."""
    rows = F.col("total_rows")
    pages = F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("bigint")
    one = df.agg(F.count(F.lit(1)).alias("total_rows"))
    return one.select(
        "total_rows",
        pages.alias("total_pages"),
        F.greatest(F.lit(0), F.least(F.lit(page), pages - 1)).cast("bigint").alias("page"),
    )


def page_rows(df: DataFrame, size: int, page: int, column: str = "timestamp") -> DataFrame:
    """Rows of one page, last value of ``column`` first, the call id deciding between equal ones.

    The sort moves (column, call id) only, for a column of any type and a page of any depth;
    the rows of the page are then looked up by the at most ``size`` pairs that it holds.
    """
    order = [F.col(column).desc_nulls_last(), F.col("call_id")]
    first = page_info(df, size, page).first()["page"] * size
    keys = _ranked(df.select(F.col(column).alias("_value"), F.col("call_id").alias("_call")),
                   [F.col("_value").desc_nulls_last(), F.col("_call")], "_rank")
    keys = keys.where((F.col("_rank") > first) & (F.col("_rank") <= first + size)).select("_value", "_call").distinct()
    found = df.join(F.broadcast(keys), df[column].eqNullSafe(F.col("_value")) & df["call_id"].eqNullSafe(F.col("_call")), "left_semi")
    return found.orderBy(*order).limit(size)
