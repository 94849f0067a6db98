"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import column_name, text_hash, written

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that one group of the reduction tree rounds against each other.
GROUP_DOCS = 128
_EPSILON = 1e-9
_ITEM = ("id", "h", "size", "m", "sure")
#: Rows that one step writes out of the count of a repeated row.
_CHUNK = 10_000


def word_count(text: str = "text") -> Column:
    """Number of words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], most_repeats: float) -> DataFrame:
    """source, source_size, target of each source of ``sizes`` (source, source_size).

    Sources in the order of their code points, null last, get ``weights`` in turn and share the
    sum of all sizes by weight. A target stops at ``most_repeats`` times its source's size, and
    the excess is shared again. With the sources in the order of cap per weight, those that
    reach their cap come first, so the share per weight of the others follows from two running
    sums. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", listed[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))])
    cap = F.col("source_size") * F.lit(float(most_repeats))
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    earlier, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(rest)
    return (
        ranked.withColumn("_cap", cap)
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_level", level)
        .withColumn("_free", F.when(F.col("_level") <= F.col("_ratio"), F.col("_level")))
        .withColumn("_shared", F.first("_free", ignorenulls=True).over(everything))
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_shared") * F.col("weight"), F.col("_cap"))))
        .select("source", "source_size", "target")
    )


def _uniform(*columns: Column) -> Column:
    """A number from 0 to 1 that only depends on the values."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def _fold(items: Column, seed: int) -> Column:
    """Round an array of (id, h, size, m, sure, p) against each other, one after the other.

    The open item carries its fractional probability along. With the next item, mass goes from
    one to the other, weighed by size so that the sum of size * p stays, until one of them is 0
    or 1; which way is drawn so that every expected p stays. The one that became whole is done,
    the other is carried on. Gives struct(open, done array of the same, p being 0 or 1).
    """
    item = lambda y, p: F.struct(*[y[c].alias(c) for c in _ITEM], p.alias("p"))

    def step(state: Column, x: Column) -> Column:
        a = state["open"]
        room = lambda y: (F.lit(1.0) - y["p"]) * y["size"]
        mass = lambda y: y["p"] * y["size"]
        to_x, to_a = F.least(mass(a), room(x)), F.least(mass(x), room(a))
        forward = _uniform(F.lit(seed), a["h"], x["h"], a["id"], x["id"]) * (to_x + to_a) < to_a
        moved = F.when(forward, to_x).otherwise(-to_a)
        snapped = lambda p: F.when(p < _EPSILON, 0.0).when(p > 1 - _EPSILON, 1.0).otherwise(p)
        pa, px = snapped(a["p"] - moved / a["size"]), snapped(x["p"] + moved / x["size"])
        a_done = (pa == 0.0) | (pa == 1.0)
        # where rounding errors leave neither whole, the nearer one is taken as such
        a_done = a_done | ~((px == 0.0) | (px == 1.0)) & (F.abs(pa - 0.5) >= F.abs(px - 0.5))
        new_a, new_x = item(a, pa), item(x, px)
        whole = lambda y, p: item(y, F.round(p))
        return F.when(
            a.isNull(), F.struct(x.alias("open"), state["done"].alias("done"))
        ).otherwise(
            F.struct(
                F.when(a_done, new_x).otherwise(new_a).alias("open"),
                F.concat(state["done"], F.array(F.when(a_done, whole(a, pa)).otherwise(whole(x, px)))).alias("done"),
            )
        )

    kind = f"struct<{', '.join(f'{c}: bigint' for c in _ITEM)}, p: double>"
    start = F.from_json(F.lit('{"open": null, "done": []}'), f"struct<open: {kind}, done: array<{kind}>>")
    return F.aggregate(items, start, step)


def round_copies(parts: DataFrame, seed: int = 11, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Decide rows (source, id, h, size > 0, p strictly between 0 and 1): adds ``up``, 0 or 1.

    Groups of about ``group_docs`` rows of a source are rounded; what each leaves open goes on
    to the next level of the tree, until a source has one open row, which is rounded. A
    source with more rows has more groups and, per factor ``group_docs``, one more level, so no
    source is held by one task. Within a group large rows come first, so that what stays open
    is small if the group has small rows. The sum of size * up differs from the sum of size * p
    by half a row's size at most.

    Repeated rows are counted first: of ``m`` equal rows the whole part of m * p is 1, and one
    row with the rest goes into the tree, so a row that is repeated any number of times is one
    item. They are written out again in chunks that are dealt over the tasks.
    """
    share = F.col("m") * F.col("p")
    counted = (
        parts.groupBy("source", "id", "h", "size", "p").agg(F.count("*").alias("m"))
        .withColumn("sure", F.floor(share + _EPSILON))
        .withColumn("p", F.greatest(share - F.col("sure"), F.lit(0.0)))
    )
    counted = written(counted.select("source", *_ITEM, "p"), "mix-rows")
    open_rows = F.col("p") >= _EPSILON
    decided, todo, level = counted.where(~open_rows).withColumn("p", F.lit(0.0)), counted.where(open_rows), 0
    n = todo.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while n:
        last = n <= group_docs
        if last:
            groups = todo.withColumn("group", F.lit(0).cast("long"))
        else:
            count = -(-n // group_docs)
            groups = todo.withColumn("group", F.pmod(F.xxhash64(F.lit(seed + level), "id", "h", "size"), F.lit(count)))
        rows = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("large_first"), _uniform(F.lit(seed - 1 - level), F.col("id"), F.col("h")).alias("u"), *_ITEM, "p")))
        items = F.transform(rows, lambda x: F.struct(*[x[c].alias(c) for c in (*_ITEM, "p")]))
        folded = written(
            groups.groupBy("source", "group").agg(items.alias("items")).select("source", _fold(F.col("items"), seed + level).alias("state")), "mix"
        )
        decided = decided.unionByName(folded.select("source", F.explode("state.done").alias("x")).select("source", "x.*"))
        todo = folded.where(F.col("state.open").isNotNull()).select("source", "state.open.*")
        if last:
            decided = decided.unionByName(todo.withColumn("p", F.round("p")))
            break
        n, level = todo.groupBy("source").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0, level + 1
    decided = decided.withColumn("ups", F.col("sure") + F.col("p").cast("long"))
    once = decided.where("m = 1").select("source", "id", "h", "size", F.col("ups").cast("int").alias("up"))
    chunks = decided.where("m > 1").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / _CHUNK))))
    chunks = chunks.repartition(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "h", "chunk")
    low = F.col("chunk") * _CHUNK
    each = chunks.withColumn("nth", F.explode(F.sequence(low, F.least(low + _CHUNK, F.col("m")) - 1)))
    return once.unionByName(each.select("source", "id", "h", "size", (F.col("nth") < F.col("ups")).cast("int").alias("up")))


def mix_plan(docs: DataFrame, weights: list[int], most_repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each row of ``docs``: doc_id, h, source, size, source_size, target, copies.

    ``size`` is the number of words. A source's rows are wanted target / source_size times: the
    whole part is taken of each, the fraction is decided by ``round_copies``. Rows without words
    are taken 0 times. Repeated rows (same id and text, as told by ``h``) are so many rows, and
    equal among themselves. Needs no order and gives the same result on every run.
    """
    rows = written(
        docs.select(F.col(doc_id).cast("long").alias("id"), text_hash(text).alias("h"), F.col(source).alias("source"), word_count(text).alias("size")),
        "mix-sizes",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, weights, most_repeats), "mix-targets")
    named = targets.select(F.col("source").alias("_source"), "source_size", "target")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sized = (
        rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_x", wanted)
        .withColumn("_whole", F.floor(F.col("_x") + _EPSILON))
        .withColumn("p", F.greatest(F.col("_x") - F.col("_whole"), F.lit(0.0)))
        .withColumn("p", F.when((F.col("p") < _EPSILON) | (F.col("size") == 0), 0.0).otherwise(F.col("p")))
    )
    ups = round_copies(sized.where(F.col("p") > 0)).select("source", "id", "h", "size", F.col("up").alias("copies_more"))
    settled = sized.where(F.col("p") == 0).select("source", "id", "h", "size", F.lit(0).alias("copies_more"))
    return (
        settled.unionByName(ups).join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("copies", F.when(F.col("size") > 0, F.floor(wanted + _EPSILON) + F.col("copies_more")).otherwise(0).cast("int"))
        .select(F.col("id").alias("doc_id"), "h", "source", "size", "source_size", "target", "copies")
    )


def mix(docs: DataFrame, weights: list[int], most_repeats: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of the mix: every row of ``docs`` as often as ``mix_plan`` takes it.

    Rows that agree in id and text share their copies; where they differ in another column,
    the copies go to them in turn.
    """
    h, n, k, key, key_h, rows, times, copy = (
        column_name(docs, c) for c in ("text_tag", "copies", "place", "mix_id", "mix_tag", "mix_rows", "mix_times", "mix_copy")
    )
    total = mix_plan(docs, weights, most_repeats, doc_id, text, source).groupBy("doc_id", "h").agg(
        F.sum("copies").alias(n), F.count("*").alias(rows)
    )
    total = total.select(F.col("doc_id").alias(key), F.col("h").alias(key_h), n, rows).where(F.col(n) > 0)
    keyed = docs.withColumn(h, text_hash(text))
    joined = keyed.join(total, F.col(doc_id).cast("long").eqNullSafe(F.col(key)) & (F.col(h) == F.col(key_h)))
    single = joined.where(F.col(rows) == 1).withColumn(times, F.col(n))
    in_turn = Window.partitionBy(key, key_h).orderBy(*[F.col(c) for c in docs.columns if c not in (doc_id, text)] or [F.lit(0)])
    several = (
        joined.where(F.col(rows) > 1).withColumn(k, F.row_number().over(in_turn) - 1)
        .withColumn(times, F.floor(F.col(n) / F.col(rows)) + (F.col(k) < F.pmod(F.col(n), F.col(rows))).cast("int"))
        .drop(k)
    )
    return (
        single.unionByName(several).where(F.col(times) > 0)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
        .select(*docs.columns)
    )
