"""Document fingerprints by winnowing, in DataFrame functions only.

Every gram of ``GRAM`` code points of a text is hashed; of each window of ``WINDOW``
consecutive grams the one with the smallest hash is kept, the rightmost of equal ones,
together with its position. Two texts that share a passage of WINDOW + GRAM - 1 code points
or more share a kept gram; passages shorter than GRAM are never matched.

A text is laid out in four bytes per code point, so a gram is a byte range at a known place.
Texts are worked off in blocks of windows, so that the work grows with the length of a text
and no array is longer than a block; kept positions are the same as without blocks. A text
with fewer grams than a window is one window; a text shorter than a gram is one gram; an
empty text (null: empty) has none. The gram slides by one code point, but its hash is taken
afresh by the built-in function: updating it from its neighbour needs a state that higher-order
functions carry at several times the cost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import join_per_key
from ..functions.text import let
from .batches import column_name, text_hash, written

GRAM = 25
WINDOW = 100
#: Windows that are worked off together; only memory depends on it.
BLOCK = 1_024
#: Grams that lie below the bound of small hashes, per window on average, and how many of them
#: are looked at first; only time depends on them.
SMALL_PER_WINDOW = 8
LOOK = 16
_WIDTH = 4
_LOW = (1 << 31) - 1


def _gram_hash(points: Column, place: Column, gram: int) -> Column:
    return F.hash(F.substring(points, place, F.lit(_WIDTH * gram)))


def _code(points: Column, place: Column, gram: int) -> Column:
    """Hash and position in one number; the smaller one has the smaller hash, then the later position."""
    later = F.lit(_LOW) - F.shiftright(place, 2)
    return F.shiftleft(_gram_hash(points, place, gram).cast("bigint"), 32).bitwiseOR(later.cast("bigint"))


def position(code: Column) -> Column:
    return (F.lit(_LOW) - code.bitwiseAND(F.lit(_LOW))).cast("int")


def gram_hash(code: Column) -> Column:
    return F.shiftright(code, 32).cast("int")


def _places(first: Column, last: Column) -> Column:
    """Byte places of the grams ``first`` to ``last``."""
    return F.when(first <= last, F.sequence(_WIDTH * first + 1, _WIDTH * last + 1, F.lit(_WIDTH))).otherwise(F.array().cast("array<int>"))


def _minima(points: Column, first: Column, last: Column, gram: int, window: int) -> Column:
    """Codes of the grams ``first`` to ``last`` that are the minimum of a window of them.

    From a kept gram the next one is found by a jump: the first smaller code among the next
    ``window`` grams and, if there is none, their minimum. Grams with a small hash decide that
    among themselves, and they are few; only where a window has none of them are all of its
    grams looked at. The number of steps is that of kept grams, about 2 in ``window + 1``;
    twice as many are tried first, then as many as there are grams.
    """
    bound = min((1 << 31) - 1, -(1 << 31) + (1 << 32) * SMALL_PER_WINDOW // window)
    codes = lambda places: F.transform(places, lambda x: _code(points, x, gram))
    few = codes(F.filter(_places(first, last), lambda x: _gram_hash(points, x, gram) < bound))

    def run(small: Column) -> Column:
        def ahead(code: Column) -> Column:
            """Codes that decide on the next kept gram."""
            edge = code.bitwiseAND(F.lit(_LOW)) - window
            every = codes(_places(position(code) + 1, F.least(position(code) + window, last)))

            def among(at: Column) -> Column:
                def within(e: Column) -> Column:
                    near = F.filter(F.slice(small, at + 1, F.lit(LOOK)), lambda x: x.bitwiseAND(F.lit(_LOW)) >= e)
                    rest = F.filter(F.slice(small, at + 1, F.lit(window)), lambda x: x.bitwiseAND(F.lit(_LOW)) >= e)
                    return let(near, lambda x: F.when(F.size(x) < LOOK, x).otherwise(rest))

                found = let(edge, within)
                return F.when(at > 0, let(found, lambda x: F.when(F.size(x) > 0, x).otherwise(every))).otherwise(every)

            return let(F.array_position(small, code).cast("int"), among)

        def step(s: Column, _: Column) -> Column:
            def chosen(a: Column) -> Column:
                def next_one(least: Column) -> Column:
                    smaller = F.filter(a, lambda x: x < s["code"])[0]
                    return F.when(least < s["code"], smaller).when(position(s["code"]) + window <= last, least)

                return let(F.array_min(a), next_one)

            moved = lambda c: F.struct(c.alias("code"), F.when(c.isNull(), s["kept"]).otherwise(F.array_append(s["kept"], c)).alias("kept"))
            return F.when(s["code"].isNull(), s).otherwise(let(let(ahead(s["code"]), chosen), moved))

        end = F.least(first + window - 1, last)
        in_first = F.filter(small, lambda x: position(x) <= end)
        least = F.coalesce(F.array_min(in_first), F.array_min(codes(_places(first, end))))
        begin = let(least, lambda c: F.struct(c.alias("code"), F.array(c).alias("kept")))
        steps = lambda state, n: F.aggregate(F.sequence(F.lit(1), n), state, step)
        usual = steps(begin, F.floor(4 * (last - first) / window).cast("int") + 8)
        return let(usual, lambda s: F.when(s["code"].isNull(), s).otherwise(steps(s, last - first + 1)))["kept"]

    return let(few, run)


def kept_grams(
    text: Column, gram: int = GRAM, window: int = WINDOW, begin: Column | int = 0, block: int = BLOCK
) -> Column:
    """Codes of the grams kept in the windows from ``begin`` on, by position (see ``position``, ``gram_hash``)."""
    text = F.coalesce(text, F.lit(""))
    begin = F.lit(begin) if isinstance(begin, int) else begin

    def whole(d: Column) -> Column:
        def one(start: Column) -> Column:
            last = F.least(start + block, d["windows"]) + window - 2
            place = F.struct(d["points"].alias("points"), start.alias("first"), F.least(last, d["grams"] - 1).alias("last"))

            def kept(b: Column) -> Column:
                fields = [b["points"], b["first"], b["last"]]
                return let(fields[0], lambda p: let(fields[1], lambda i: let(fields[2], lambda j: _minima(p, i, j, gram, window))))

            return let(place, kept)

        starts = F.sequence(d["begin"], d["windows"] - 1, F.lit(block))
        return F.array_distinct(F.flatten(F.transform(starts, one)))

    grams = F.greatest(F.length(text) - gram + 1, F.least(F.length(text), F.lit(1)))
    windows = F.when(grams > 0, F.greatest(grams - window + 1, F.lit(1))).otherwise(0)
    frame = F.struct(
        F.encode(text, "UTF-32").alias("points"), grams.alias("grams"), begin.cast("int").alias("begin"), windows.alias("windows")
    )
    none = F.array().cast("array<bigint>")
    return let(frame, lambda d: F.when(d["begin"] < d["windows"], whole(d)).otherwise(none))


def fingerprint_text(kept: Column) -> Column:
    """``position:hash`` of every kept gram, hashes in hexadecimal digits."""
    shown = lambda x: F.concat(position(x).cast("string"), F.lit(":"), F.lpad(F.hex(F.shiftrightunsigned(x, 32)), 8, "0"))
    return F.lower(F.array_join(F.transform(kept, shown), " "))


def hashes(kept: Column) -> Column:
    """The hashes of kept grams as a set."""
    return F.array_distinct(F.transform(kept, gram_hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def with_fingerprint(docs: DataFrame, text: str = "text", gram: int = GRAM, window: int = WINDOW, into: str = "kept") -> DataFrame:
    """Adds the codes of the kept grams (null text: none), see ``kept_grams``; no shuffle."""
    return docs.withColumn(column_name(docs, into), kept_grams(F.col(text), gram, window))


def up_to_window(kept: Column, windows: Column, window: int) -> Column:
    """Of all kept codes of a text, those that its first ``windows`` windows keep."""

    def found(n: Column) -> Column:
        last = F.array_min(F.filter(kept, lambda x: position(x).between(n - 1, n + window - 2)))
        return let(position(last), lambda p: F.filter(kept, lambda x: position(x) <= p))

    # The number is taken once per row, not once per code.
    return F.when(windows > 0, let(windows, found)).otherwise(F.array().cast("array<bigint>"))


KEY = ["_has_id", "_id", "_hash"]


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows with the same id and text are one document."""
    return docs.select(
        F.col(doc_id).isNotNull().alias("_has_id"),  # false, so first, for null ids
        F.coalesce(F.col(doc_id), F.lit(0)).alias("_id"),
        text_hash(text).alias("_hash"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )


def predecessors(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """For every document the one before it by id (before the first: the last) and its length.

    Only ids, hashes and lengths are sorted, by range over all partitions. The row that a
    partition's first one follows is the last of the partition before: one row per partition.
    """
    keys = _keyed(docs, doc_id, text).groupBy(*KEY).agg(F.max(F.length("_text")).alias("_n"))
    dealt = keys.repartitionByRange(*KEY).withColumn("_part", F.spark_partition_id())
    placed = written(dealt, "document-order")  # fixes which row lies in which partition
    row = F.struct(*KEY, "_n")
    lasts = placed.groupBy("_part").agg(F.max(row).alias("_last"))  # at most one row per partition
    parts = Window.orderBy("_part")
    very_last = F.last("_last").over(parts.rowsBetween(0, Window.unboundedFollowing))
    lasts = lasts.select("_part", F.coalesce(F.lag("_last").over(parts), very_last).alias("_before"))
    before = F.coalesce(F.lag(row).over(Window.partitionBy("_part").orderBy(*KEY)), F.col("_before"))
    joined = placed.join(F.broadcast(lasts), "_part").withColumn("_before", before)
    return joined.select(*KEY, *[F.col(f"_before.{c}").alias(f"_before{c}") for c in [*KEY, "_n"]])


def edited_likeness(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """One row per row of ``docs``: the fingerprints of its text and of its edited text.

    In the edited text the last half of the code points (rounded down) gives way to the first
    as many, or all, of the next document by id; after the last comes the first. Columns:
    the id, n_chars, edited_sha256, fingerprint, edited_fingerprint (see ``fingerprint_text``),
    near_edited and near_next (``likeness`` to the edited and to the next text). Rows without
    an id come first; rows with the same id and text are one document with one next document,
    those with the same id and other texts follow by a hash of their text. A single document
    is its own next one. A null text is empty.

    Texts are shuffled once by document, repeated ones combined before, together with the grams
    they keep; the start of each text and its hashes are sent on to the document before it.
    Windows in the half that stays are the same in both texts and not searched again.
    """
    once = _keyed(docs, doc_id, text).withColumn("_kept", kept_grams(F.col("_text"), gram, window))
    once = once.groupBy(*KEY).agg(F.any_value(F.struct("_text", "_kept")).alias("_doc")).select(*KEY, "_doc.*")
    sent = once.join(predecessors(docs, doc_id, text), KEY).select(
        *[F.col(f"_before{c}").alias(c) for c in KEY],
        F.substring("_text", F.lit(1), F.floor(F.col("_before_n") / 2).cast("int")).alias("_start"),
        hashes(F.col("_kept")).alias("_next"),
    )
    head = F.length("_text") - F.floor(F.length("_text") / 2).cast("int")
    common = F.greatest(head - (gram + window - 1) + 1, F.lit(0))
    both = (
        once.join(sent, KEY)
        .withColumn("_edited", F.concat(F.substring("_text", F.lit(1), head), F.col("_start")))
        .withColumn("_new", F.array_union(up_to_window(F.col("_kept"), common, window), kept_grams(F.col("_edited"), gram, window, common)))
        .withColumn("_hashes", hashes(F.col("_kept")))
    )
    per_document = both.select(
        *KEY,
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint_text(F.col("_kept")).alias("fingerprint"),
        fingerprint_text(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_hashes"), hashes(F.col("_new"))).alias("near_edited"),
        likeness(F.col("_hashes"), F.col("_next")).alias("near_next"),
    )
    rows = _keyed(docs, doc_id, text).select(*KEY)
    shown = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return join_per_key(rows, per_document, KEY).select(F.when(F.col("_has_id"), F.col("_id")).alias(doc_id), *shown)
