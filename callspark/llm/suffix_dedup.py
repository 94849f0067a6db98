"""Repeated byte strings across documents, from a sparse suffix array sorted deep and shallow.

A string of ``window`` bytes that occurs twice must be found wherever it starts, but not every
suffix has to be sorted for it. Each window of a text chooses an anchor, its gram (``gram``
bytes) with the smallest hash, so equal windows choose equal grams at equal places. An anchor
row stands for the run of windows that chose it; their bytes are its context. Only anchors
whose gram occurs again can belong to a repeated window, and only these are sorted:

1. Equal contexts are counted before anything is shuffled by content; a context that occurs
   twice is repeated as a whole, and one of its occurrences stands for all.
2. Different contexts of a gram are sorted by what follows and by what precedes it, reversed:
   multikey quicksort to a shallow depth, then blind tries for what still shares a prefix. The
   longest common prefixes of the two orders tell which windows occur in another context.
3. A gram with many contexts is divided by where its windows start: all windows of one part
   share a longer string, which is the gram of the next round. A round quarters the range of
   starts, so there are at most log4(window) + 1 rounds, and no task gets more than
   ``group_contexts`` contexts of one gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import RollingHash, bounded_batches, column_name, dropped, flat, mixed, steps, text_hash, written

WINDOW = 400
GRAM = 128
GROUP_CONTEXTS = 200
#: Bytes that multikey quicksort looks at, so many at a time; longer common prefixes go to blind tries.
SHALLOW, DIGIT = 16, 4
#: Ranges of starts that a gram with many contexts is divided into each round.
PARTS = 4
#: A longer text is searched in parts of so many bytes that overlap by a window.
PART_BYTES = 1 << 23
_PLACE_BITS = np.uint64(24)
_PLACE = np.uint64((1 << 24) - 1)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` values in a row, from running minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, place of the anchor after it, gram hash, context hash).

    ``data`` holds the texts with the given bounds one after the other.
    """
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < window:
        return none
    rolling = RollingHash(data)
    hashes = rolling.every(gram)
    key = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (_sliding_least(key, window - gram + 1) & _PLACE).astype(np.int64)
    valid = np.zeros(len(chosen) + 1, np.int32)
    long_enough = np.flatnonzero(np.diff(bounds) >= window)
    valid[bounds[long_enough]] += 1
    valid[bounds[long_enough + 1] - window + 1] -= 1
    valid = np.cumsum(valid[:-1]) > 0
    new = valid & np.concatenate([[True], (chosen[1:] != chosen[:-1]) | ~valid[:-1]])
    first = np.flatnonzero(new)
    last = np.flatnonzero(valid & np.concatenate([new[1:] | ~valid[1:], [True]]))
    at = chosen[first]
    offset = at - first
    context = rolling.at(first, last + window) ^ mixed(offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    row = np.searchsorted(bounds, first, "right") - 1
    return row, first - bounds[row], last - first + 1, offset, hashes[at], context


class _Trie:
    """A blind trie: branching places only; strings are compared once, at the leaf they lead to."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [None, None, [first]]  # depth, children by byte (-1: the string ends), leaf members

    def insert(self, i: int) -> None:
        new, path, node = self.strings[i], [], self.root
        while node[1] is not None:
            path.append(node)
            depth = node[0]
            node = node[1].get(new[depth] if depth < len(new) else -1) or next(iter(node[1].values()))
        leaf = self.strings[node[2][0]]
        depth = common_prefix(new, leaf)
        if depth == len(new) == len(leaf):
            node[2].append(i)
            return
        node, parent = self.root, None
        while node[1] is not None and node[0] < depth:
            parent, node = node, node[1][new[node[0]] if node[0] < len(new) else -1]
        byte = new[depth] if depth < len(new) else -1
        fresh = [None, None, [i]]
        if node[1] is not None and node[0] == depth:
            node[1][byte] = fresh
            return
        branch = [depth, {byte: fresh, (leaf[depth] if depth < len(leaf) else -1): node}, None]
        if parent is None:
            self.root = branch
        else:
            parent[1][new[parent[0]] if parent[0] < len(new) else -1] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node[1] is None:
                out.extend(node[2])
            else:
                stack.extend(node[1][b] for b in sorted(node[1], reverse=True))
        return out


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """The order of ``strings``: multikey quicksort to the shallow depth, blind tries below it."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            out += group
        elif depth >= shallow:
            trie = _Trie(strings, group[0])
            for i in group[1:]:
                trie.insert(i)
            out += trie.order()
        else:
            digits = [strings[i][depth : depth + DIGIT] for i in group]
            pivot = sorted(digits)[len(digits) // 2]
            less = [i for i, d in zip(group, digits, strict=True) if d < pivot]
            same = [i for i, d in zip(group, digits, strict=True) if d == pivot]
            more = [i for i, d in zip(group, digits, strict=True) if d > pivot]
            if more:
                stack.append((more, depth))
            if len(pivot) == DIGIT:
                stack.append((same, depth + DIGIT))
            else:  # they end here and are equal
                stack.append((same, shallow))
            if less:
                stack.append((less, depth))
    return out


def _prefix_matrix(strings: list[bytes]) -> np.ndarray:
    """Common prefixes of all strings of a bounded group, from the neighbours in their order."""
    order = deep_shallow(strings)
    n = len(order)
    next_one = [common_prefix(strings[a], strings[b]) for a, b in zip(order[:-1], order[1:], strict=True)]
    out = np.zeros((n, n), np.int64)
    for i in range(n - 1):
        run = np.minimum.accumulate(next_one[i:])
        out[order[i], order[i + 1 :]] = run
        out[order[i + 1 :], order[i]] = run
    return out


def repeated_starts(contexts: list[tuple[int, int, bytes]], low: int, high: int) -> list[list[tuple[int, int]]]:
    """For each (least, most, bytes) of a group: ranges of starts whose windows occur in another one.

    A start s is the number of bytes from a window's first byte to the anchor; ``low`` to
    ``high`` is the range that the group stands for, ``least`` to ``most`` what a context has.
    """
    window = len(contexts[0][2]) - (contexts[0][1] - contexts[0][0])
    rights = [c[most - high + window :] for _, most, c in contexts]
    lefts = [c[: most - low][::-1] for _, most, c in contexts]
    right, left = _prefix_matrix(rights), _prefix_matrix(lefts)
    least = np.array([c[0] for c in contexts])
    most = np.array([c[1] for c in contexts])
    a = np.maximum(high - right, np.maximum(least[:, None], least[None, :]))
    b = np.minimum(low + left, np.minimum(most[:, None], most[None, :]))
    np.fill_diagonal(b, low - 1)
    x, y = np.nonzero(a <= b)
    marks = np.zeros((len(contexts), high - low + 2), np.int64)
    np.add.at(marks, (x, a[x, y] - low), 1)
    np.add.at(marks, (x, b[x, y] - low + 1), -1)
    on = np.cumsum(marks, axis=1)[:, :-1] > 0
    out = []
    for row in on:
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        out.append([(int(i) + low, int(j) - 1 + low) for i, j in zip(edges[::2], edges[1::2], strict=True)])
    return out


_NAMES = ["key", "sub", "gram", "context", "c0", "c1", "least", "most", "copies", "bytes"]
_SCHEMA = "key long, sub long, gram long, context long, c0 int, c1 int, least int, most int, copies long, bytes binary"
_KINDS = [*[pa.int64()] * 4, *[pa.int32()] * 4, pa.int64(), pa.binary()]


def _hash64(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _sort_groups(rows: DataFrame) -> DataFrame:
    """(gram, context, low, high) of contexts that occur once: starts that occur in another one."""
    names, kinds = ["gram", "context", "low", "high"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flagged() -> list[tuple]:
            if len(group) < 2:
                return []
            found = repeated_starts([(g[5], g[6], g[8]) for g in group], group[0][3], group[0][4])
            return [(g[1], g[2], a, b) for g, ranges in zip(group, found, strict=True) if g[7] == 1 for a, b in ranges]

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][0] != row[0]:
                    out += flagged()
                    group.clear()
                group.append(row)
            yield _batch(out, names, kinds)
        yield _batch(flagged(), names, kinds)

    ordered = rows.select("key", "gram", "context", "c0", "c1", "least", "most", "copies", "bytes")
    ordered = ordered.repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "gram long, context long, low int, high int")


def _divided(rows: DataFrame, window: int) -> DataFrame:
    """The ``PARTS`` parts of each context, keyed by the bytes that all windows of the part share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for gram, context, low, high, least, most, copies, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                step = -(-(high - low + 1) // PARTS)
                for c0 in range(low, high + 1, step):
                    c1 = min(high, c0 + step - 1)
                    a, b = max(least, c0), min(most, c1)
                    if a <= b:
                        part, core = data[most - b : most - a + window], data[most - c0 : most - c1 + window]
                        key = _hash64(b"%d " % c0, core)
                        out.append((key, _hash64(b"%d %d " % (a, b), part), gram, context, c0, c1, a, b, copies, part))
            yield _batch(out, _NAMES, _KINDS)

    return rows.select("gram", "context", "c0", "c1", "least", "most", "copies", "bytes").mapInArrow(run, _SCHEMA)


def _collapse(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for all equal contexts of a key with several, and the starts of those that are equal.

    Equal parts of contexts are counted by their hash before rows are moved.
    """
    per_sub = rows.groupBy("key", "sub").agg(F.sum("copies").alias("total"), F.min(F.struct("gram", "context")).alias("first"))
    per_key = per_sub.groupBy("key").agg(F.count("*").alias("n_subs"), F.sum("total").alias("n")).where("n > 1")
    subs = per_sub.select(F.col("key").alias("_key"), F.col("sub").alias("_sub"), "total", "first")
    rows = rows.join(subs, (F.col("key") == F.col("_key")) & (F.col("sub") == F.col("_sub"))).drop("_key", "_sub")
    equal = rows.where("copies = 1 and total > 1").select("gram", "context", F.col("least").alias("low"), F.col("most").alias("high"))
    firsts = rows.where("gram = first.gram and context = first.context").withColumn("copies", F.col("total")).drop("total", "first")
    return firsts.join(per_key.where("n_subs > 1").select("key", "n_subs"), "key"), equal


def repeated_in_contexts(contexts: DataFrame, window: int, gram: int, group_contexts: int) -> DataFrame:
    """(gram, context, low, high): repeated starts of contexts that occur once.

    ``contexts`` has one row per distinct context of a gram, as ``_contexts`` makes them.
    """
    held = written(contexts, "contexts")
    sizes = held.groupBy("key").agg(F.count("*").alias("n_subs"))
    rows, width, found = held.join(sizes, "key"), window - gram, []
    while True:  # each round is written by a job of its own, so that no plan grows with the rounds
        found.append(written(_sort_groups(rows.where(F.col("n_subs") <= group_contexts)), "sorted-starts"))
        large = rows.where(F.col("n_subs") > group_contexts)
        if not width or large.isEmpty():
            break
        divided = written(_divided(large, window), "divided")
        dropped(held)
        rows, equal = _collapse(divided)
        rows, width = written(rows, "divided-contexts"), width // PARTS
        found.append(written(equal, "equal-starts"))
        dropped(divided)
        held = rows
    dropped(held)
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _anchor_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, tag, start, n, place, gram, context) of every anchor of (doc_id, tag, text)."""
    names = ["start", "n", "place", "gram", "context"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = flat(batch.column(2))
            for a, b in steps(bounds):
                found = []
                if bounds[b] - bounds[a] > PART_BYTES:  # one long text
                    for at in range(0, int(bounds[b] - bounds[a]), PART_BYTES):
                        part = data[bounds[a] + at : min(bounds[b], bounds[a] + at + PART_BYTES + window - 1)]
                        row, start, *rest = anchors(part, np.array([0, len(part)]), window, gram)
                        found.append((row, start + at, *rest))
                else:
                    found.append(anchors(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], window, gram))
                for row, start, n, place, g, c in found:
                    at = pa.array(row + a)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at)]
                        + [pa.array(x) for x in (start, n.astype(np.int32), place.astype(np.int32), g.view(np.int64), c.view(np.int64))],
                        ["doc_id", "tag", *names],
                    )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, tag long, start long, n int, place int, gram long, context long")


def _contexts(candidates: DataFrame, window: int, gram: int) -> DataFrame:
    """The bytes of one occurrence of each distinct context, of texts with their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                out = []
                for x in found:
                    least, most = x["place"] - x["n"] + 1, x["place"]
                    part = data[x["start"] : x["start"] + x["n"] - 1 + window]
                    out.append((x["gram"], x["context"], x["gram"], x["context"], 0, window - gram, least, most, x["copies"], part))
                    if len(out) == 2_000:
                        yield _batch(out, _NAMES, _KINDS)
                        out = []
                yield _batch(out, _NAMES, _KINDS)

    firsts = F.filter("anchors", lambda x: x["first"])
    rows = candidates.select("text", firsts.alias("anchors")).where(F.size("anchors") > 0)
    return rows.mapInArrow(run, _SCHEMA)


def removed_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", group_contexts: int = GROUP_CONTEXTS
) -> DataFrame:
    """What remains of texts that hold a repeated string: doc_id, tag, n_removed, n_spans, kept (binary).

    Every byte is removed that is covered by a string of ``window`` bytes of the UTF-8 text
    that starts anywhere else too, in the same text or another one. Texts without such a byte,
    null, empty and shorter ones have no row. ``tag`` is ``text_hash``: rows that agree in id
    and text have one row in the result, and are each other's repeats.

    Only rows of numbers are shuffled for all texts; texts meet their anchors in one join, and
    bytes of contexts move only where different contexts of a gram have to be sorted. Each
    intermediate table is dropped as soon as what reads it is written.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("tag"), F.col(text).alias("text"))
    own = written(_anchor_rows(narrow.where(F.octet_length("text") >= window), window, gram), "anchors")
    per_gram = own.groupBy("gram").agg(F.count("*").alias("_n"), F.min("context").alias("_low"), F.max("context").alias("_high"))
    per_gram = per_gram.where("_n > 1").select(F.col("gram").alias("_gram"), "_n", (F.col("_low") != F.col("_high")).alias("_several"))
    per_gram = written(per_gram, "grams-again")  # a scan of its own, so that a hot gram's rows can be split in the join
    again = written(own.join(per_gram, F.col("gram") == F.col("_gram")).drop("_gram"), "anchors-again")
    dropped(own, per_gram)
    same = again.where(~F.col("_several")).withColumns({"copies": F.col("_n"), "first": F.lit(False)})
    each = again.where("_several").groupBy("gram", "context").agg(
        F.count("*").alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "start")).alias("_first")
    )
    each = written(each, "contexts-of-grams")
    several = again.where("_several").join(each.withColumnsRenamed({"gram": "_gram", "context": "_context"}), (F.col("gram") == F.col("_gram")) & (F.col("context") == F.col("_context")))
    is_first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("tag") == F.col("_first.tag")) & (F.col("start") == F.col("_first.start"))
    columns = ["doc_id", "tag", "start", "n", "place", "gram", "context", "copies", "first"]
    marked = same.select(*columns).unionByName(several.withColumn("first", is_first).select(*columns))
    lists = marked.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*columns[2:])).alias("anchors"))
    lists = lists.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "anchors")
    on = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))
    candidates = written(narrow.join(lists, on).drop("_id", "_tag"), "texts-with-anchors")
    dropped(again, each)
    starts = repeated_in_contexts(_contexts(candidates, window, gram), window, gram, group_contexts)
    spread = candidates.select("doc_id", "tag", F.explode("anchors").alias("x")).select("doc_id", "tag", "x.*")
    whole = spread.where("copies > 1").select("doc_id", "tag", F.col("start").alias("a"), (F.col("start") + F.col("n") + window - 1).alias("b"))
    parts = spread.where("copies = 1").join(
        starts.withColumnsRenamed({"gram": "_gram", "context": "_context"}), (F.col("gram") == F.col("_gram")) & (F.col("context") == F.col("_context"))
    )
    at = F.col("start") + F.col("place")
    parts = parts.select("doc_id", "tag", (at - F.col("high")).alias("a"), (at - F.col("low") + window).alias("b"))
    spans = whole.unionByName(parts).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    spans = written(spans.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "spans"), "repeat-spans")
    texts = candidates.select("doc_id", "tag", "text").join(spans, on).drop("_id", "_tag")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, n_spans, kept = [], [], []
            for value, ranges in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                data, out, end, count = value.encode(), [], -1, 0
                for a, b in sorted((r["a"], r["b"]) for r in ranges):
                    if a > end:
                        out.append(data[max(end, 0) : a])
                        count += 1
                    end = max(end, b)
                out.append(data[end:])
                kept.append(b"".join(out))
                removed.append(len(data) - len(kept[-1]))
                n_spans.append(count)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "tag", "n_removed", "n_spans", "kept"],
            )

    kind = dict(narrow.dtypes)["doc_id"]
    found = texts.mapInArrow(cut, f"doc_id {kind}, tag long, n_removed long, n_spans long, kept binary")
    found = written(found.dropDuplicates(["doc_id", "tag"]), "texts-cut")
    dropped(candidates, spans)
    return found


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", **settings: int) -> DataFrame:
    """``docs`` with the repeated strings cut out of their texts, and ``n_chars``, if there, counted again.

    All rows stay. A character that a cut splits is left out as a whole.
    """
    taken = {c: column_name(docs, c) for c in ("cut_id", "cut_tag", "cut_text")}
    found = removed_repeats(docs, doc_id=doc_id, text=text, **settings)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], list(taken.values()))

    kind = dict(found.dtypes)["doc_id"]
    cuts = found.select("doc_id", "tag", "kept").mapInArrow(decode, f"{taken['cut_id']} {kind}, {taken['cut_tag']} long, {taken['cut_text']} string")
    on = F.col(doc_id).eqNullSafe(F.col(taken["cut_id"])) & (text_hash(text) == F.col(taken["cut_tag"]))
    joined = docs.join(cuts, on, "left")
    new = {text: F.coalesce(F.col(taken["cut_text"]), F.col(text))}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col(taken["cut_text"]).isNull(), F.col(n_chars)).otherwise(F.length(taken["cut_text"])).cast(dict(docs.dtypes)[n_chars])
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
