"""KPI rollups of the call table that are refreshed from new batches alone.

A rollup is a list of layers of mergeable partial aggregates per hour and key: counts, and sums
as decimals, which can be added and taken back exactly. A refresh looks at the calls of the
batches that are not in the rollup yet: what they counted for before is taken back, what they
count for now is added, and the difference is one more layer. Windows, days, weeks and months
are sums over the layers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import PERIODS, connected
from ..session import new_folder
from .ingest import SEQUENCE
from .store import _read_or_empty, batch_stamps, latest, read_batches

LAYERS = "name string, generation bigint, layer bigint, path string, batch_seq bigint, stamp string"
MEASURES = ("duration", "revenue")
#: Sums are kept to nine decimal places; a number that is not finite or beyond this counts as missing.
AMOUNT = "decimal(38,9)"
#: Layers that are summed into one when there are more.
MOST_LAYERS = 32


def _partials(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """Signed counts and sums per hour and key; rows without a time belong to no period."""
    counts = [F.count(F.lit(1)).alias("n"), F.count("call_id").alias("calls"), F.count_if(connected()).alias("connected_calls")]
    for m in MEASURES:
        amount = F.col(m).try_cast(AMOUNT)
        counts += [F.count(amount).alias(f"n_{m}"), F.coalesce(F.sum(amount), F.lit(0)).cast(AMOUNT).alias(f"sum_{m}")]
    cells = rows.where("timestamp is not null").groupBy(F.date_trunc("hour", "timestamp").alias("hour"), *keys).agg(*counts)
    return cells if sign > 0 else cells.select("hour", *keys, *[(-F.col(c)).cast(t).alias(c) for c, t in cells.dtypes if c not in ("hour", *keys)])


def _summed(layers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per hour and key; cells that every call has left are gone."""
    kinds = {c: t for c, t in layers.dtypes if c not in ("hour", *keys)}
    return layers.groupBy("hour", *keys).agg(*[F.sum(c).cast(t).alias(c) for c, t in kinds.items()])


def _layers(spark: SparkSession, root: str, name: str) -> tuple[int, dict[int, str], dict[int, str]]:
    """Newest generation of a rollup, its layers' paths, and the stamps of the batches in it."""
    rows = _read_or_empty(spark, f"{root}/_rollups", LAYERS).where(F.col("name") == name)
    newest = rows.agg(F.max("generation")).first()[0]
    if newest is None:
        return 0, {}, {}
    noted = rows.where(F.col("generation") == newest).collect()
    return newest, {r["layer"]: r["path"] for r in noted}, {r["batch_seq"]: r["stamp"] for r in noted}


def _write_layer(cells: DataFrame, root: str, name: str, generation: int, layer: int, batches: dict[int, str]) -> None:
    """Write a layer, then note it and its batches; a layer that is not noted is never read."""
    spark = cells.sparkSession
    path = f"{root}/rollups/{name}/{generation}-{layer}"
    cells.write.mode("overwrite").parquet(path)
    noted = spark.createDataFrame([(name, generation, layer, path, n, s) for n, s in sorted(batches.items())], LAYERS)
    noted.coalesce(1).write.mode("append").parquet(f"{root}/_rollups")


def refresh_rollup(
    spark: SparkSession, root: str, name: str, keys: tuple[str, ...] = ("agent_id",), order: list[str] | None = None, most_layers: int = MOST_LAYERS
) -> list[int]:
    """Bring a rollup of the batches below ``root`` up to date; returns the batches it took in.

    Only calls of new batches are aggregated. What they counted for before is looked up in the
    other batches by their ids, on the few columns that a rollup needs. A late batch counts
    only where no later one has the call. A batch that was written again, or is gone, has left
    nothing to take back from, so the rollup is then built anew as a new generation. The
    driver gets one row per batch and layer. ``keys`` must stay the same for a name.
    """
    keys, order = list(keys), ["batch_seq", *(order or SEQUENCE)]
    stamps = batch_stamps(spark, root)
    generation, paths, known = _layers(spark, root, name)
    if any(stamps.get(n) != s for n, s in known.items()):
        generation, paths, known = generation + 1, {}, {}
    fresh = {n: s for n, s in stamps.items() if n not in known}
    if not fresh:
        return []
    columns = list(dict.fromkeys(["call_id", "timestamp", "outcome", *MEASURES, *keys, *order]))
    new = read_batches(spark, root, sorted(fresh)).select(*columns)
    if known:
        ids = new.select(F.col("call_id").alias("_id")).distinct()
        older = read_batches(spark, root, sorted(known)).select(*columns)
        older = older.join(ids, older["call_id"].eqNullSafe(F.col("_id")), "left_semi")
        folder = new_folder(spark, "rollup-calls")
        latest(older, "call_id", order).write.parquet(folder)
        before = spark.read.parquet(folder)
        now = latest(before.unionByName(new), "call_id", order)
        cells = _summed(_partials(now, keys, 1).unionByName(_partials(before, keys, -1)), keys)
        counted = [c for c in cells.columns if c not in ("hour", *keys)]
        cells = cells.where(" or ".join(f"{c} <> 0" for c in counted))
    else:
        cells = _partials(latest(new, "call_id", order), keys, 1)
    layer = max(paths, default=0) + 1
    _write_layer(cells, root, name, generation, layer, fresh)
    if len(paths) + 1 > most_layers:
        _write_layer(_cells(spark, root, name, keys), root, name, generation + 1, 1, {**known, **fresh})
    return sorted(fresh)


def _cells(spark: SparkSession, root: str, name: str, keys: list[str]) -> DataFrame:
    _, paths, _ = _layers(spark, root, name)
    if not paths:
        raise ValueError(f"no rollup {name}: refresh it first")
    return _summed(spark.read.parquet(*paths.values()), keys).where("n > 0")


def _average(measure: str) -> Column:
    return F.when(F.col(f"n_{measure}") > 0, F.col(f"sum_{measure}").cast("double") / F.col(f"n_{measure}"))


def rollup_kpis(spark: SparkSession, root: str, name: str, keys: tuple[str, ...] = ("agent_id",)) -> DataFrame:
    """The KPIs per hour and key, as ``window_kpis`` gives them for the current calls."""
    revenue = F.when(F.col("n_revenue") > 0, F.col("sum_revenue").cast("double"))
    return _cells(spark, root, name, list(keys)).select(
        F.col("hour").alias("window_start"), *keys, "calls", "connected_calls",
        _average("duration").alias("avg_duration"), revenue.alias("total_revenue"),
    )


def rollup_trends(spark: SparkSession, root: str, name: str, period: str = "daily", keys: tuple[str, ...] = ("agent_id",)) -> DataFrame:
    """The KPIs per day, week or month, as ``trends`` gives them for the current calls."""
    if period not in PERIODS:
        raise ValueError(f"invalid period: {period}")
    start = F.date_format(F.date_trunc(PERIODS[period], "hour"), "yyyy-MM-dd")
    cells = _cells(spark, root, name, list(keys))
    counted = [c for c in cells.columns if c not in ("hour", *keys)]
    return (
        cells.groupBy(start.alias("period")).agg(*[F.sum(c).alias(c) for c in counted])
        .select(
            "period", "calls", (F.col("connected_calls") * 100.0 / F.col("n")).alias("connection_rate"),
            _average("duration").alias("avg_duration"), F.col("sum_revenue").cast("double").alias("total_revenue"),
        )
        .orderBy("period")
    )
