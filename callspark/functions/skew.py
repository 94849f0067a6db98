"""Joins that keep working when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a task where each row costs much work and few bytes.
ROWS_PER_TASK = 100_000


def spread_rows(scan: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Deal a scan to tasks of about ``rows`` rows, and to every core at least.

    For tables of narrow rows with much work each: their splits are cut by bytes, so that a
    task's time would grow with the table. The count reads the footers of the files only.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, -(-scan.count() // rows))
    return scan.repartition(tasks) if scan.rdd.getNumPartitions() < tasks else scan


def spread_scan(scan: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer splits than cores.

    A large table has more splits than that and is returned as it is. Only for a plain
    scan: asking another plan for its partitions would run its shuffles.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a table of rows with an aggregate that has one row per key, or with a part of it.

    ``how`` is inner, left or left_semi. Adaptive execution cuts partitions of ``rows`` that a
    hot key makes large and sends each piece the key's one row, as many pieces as their size
    asks for. Rows with a null key match nothing and stay out of the join.
    """
    null = F.lit(False)
    for key in keys:
        null = null | F.col(key).isNull()
    joined = rows.where(~null).join(per_key, keys, how)
    return joined.unionByName(rows.where(null), allowMissingColumns=True) if how == "left" else joined
