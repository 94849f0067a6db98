"""Exact percentiles of one column without gathering its values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS_PER_LOG = 64
INNER_CELLS = 65_536


def percentile_row(df: DataFrame, column: str | Column, percents: list[float]) -> DataFrame:
    """One row p25, p50, ... with linear interpolation; null when there is no value.

    The built-in ``percentile`` keeps every distinct value of a group in one buffer, so the
    order statistics are narrowed down with three counting passes instead.
    """
    value = F.col(column) if isinstance(column, str) else column
    return select_by_counting(df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)"), percents)


def log_cell(x: str) -> Column:
    """Cell of a value on a grid with 64 cells per unit of ln|x|; infinite values have cells of their own."""
    finite = F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS_PER_LOG)
    far = 1 << 20
    return F.when(F.col(x) == float("inf"), far).when(F.col(x) == float("-inf"), -far).otherwise(finite).cast("int")


def inner_cell() -> Column:
    """Part of a cell from ``lo`` to ``hi`` that ``x`` falls in."""
    share = (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return F.when(F.col("hi") > F.col("lo"), F.floor(share * (INNER_CELLS - 1))).otherwise(F.lit(0)).cast("int")


def percentile_name(p: float) -> str:
    return f"p{int(p)}" if float(p).is_integer() else f"p{p}".replace(".", "_")


def select_by_counting(x: DataFrame, percents: list[float], tags: tuple[str, ...] = ()) -> DataFrame:
    """Order statistics of column ``x`` by counting in ever smaller cells, for each value of ``tags`` if there are any.

    Pass 1 counts cells of a logarithmic grid (at most 64 per unit of ln|x|, whatever
    the table size). Pass 2 cuts the few cells that hold a wanted rank into 65,536
    parts, pass 3 counts the distinct values of the parts hit. Every pass aggregates
    before the shuffle, so a value that fills a third of the table is one row. ``tags`` are
    not null and have few values, as all tags' hits are broadcast together.
    """
    cells = x.groupBy(*tags, log_cell("x").alias("c1")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    return select_from_cells(x, cells, percents, tags)


def select_from_cells(x: DataFrame, cells: DataFrame, percents: list[float], tags: tuple[str, ...] = ()) -> DataFrame:
    """Passes 2 and 3 of ``select_by_counting``; ``cells`` (tags, c1, n, lo, hi) is its pass 1."""
    grid = log_cell("x")
    running = Window.partitionBy(*tags).orderBy("c1").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.select(
        *tags,
        "c1",
        "lo",
        "hi",
        (F.sum("n").over(running) - F.col("n")).alias("start"),
        F.sum("n").over(running).alias("end"),
        F.sum("n").over(Window.partitionBy(*tags)).alias("total"),
    )
    ranks = []
    for p in percents:
        place = (F.col("total") - 1) * F.lit(p / 100)
        ranks += [F.floor(place), F.ceil(place)]
    hit1 = _keep_hit(cells.withColumn("ranks", F.array(*ranks)), "start", "end")
    hit1 = hit1.select(*tags, "c1", "lo", "hi", "start", "total", "ranks")

    inner = inner_cell()
    # At most two rows per percentile and tag, so the broadcast is bounded by the parameters.
    parts = (
        x.withColumn("c1", grid)
        .join(F.broadcast(hit1), [*tags, "c1"])
        .groupBy(*tags, "c1", "start", "total", "ranks", inner.alias("c2"), "lo", "hi")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    hit2 = _next_hits(parts, [*tags, "c1"], "c2").select(
        *tags, "c1", "c2", "lo", "hi", "start", "total", "ranks"
    )

    values = (
        x.withColumn("c1", grid)
        .join(F.broadcast(hit2), [*tags, "c1"])
        .where(F.col("c2") == inner)
        .groupBy(*tags, "c1", "c2", "start", "total", "ranks", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    found = _next_hits(values, [*tags, "c1", "c2"], "x")
    table = found.select(*tags, "total", "x", F.explode("ranks").alias("rank")).groupBy(*tags).agg(
        F.map_from_entries(F.collect_set(F.struct("rank", "x"))).alias("at"),
        F.max("total").alias("total"),
    )
    out = []
    for p in percents:
        place = (F.col("total") - 1) * F.lit(p / 100)
        low, high = F.col("at")[F.floor(place)], F.col("at")[F.ceil(place)]
        between = low + (high - low) * (place - F.floor(place))
        out.append(F.when(low == high, low).otherwise(between).alias(percentile_name(p)))
    return table.select(*tags, *out)


def _keep_hit(df: DataFrame, start: str, end: str) -> DataFrame:
    inside = F.filter("ranks", lambda r: (r >= F.col(start)) & (r < F.col(end)))
    return df.withColumn("ranks", F.array_distinct(inside)).where(F.size("ranks") > 0)


def _next_hits(df: DataFrame, within: list[str], order: str) -> DataFrame:
    running = (
        Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    counted = df.withColumn("end", F.col("start") + F.sum("n").over(running)).withColumn(
        "start", F.col("end") - F.col("n")
    )
    return _keep_hit(counted, "start", "end")
