"""Join of near-equal texts by the Jaccard similarity of their word n-grams, with count-vector R-trees.

Candidates meet under a shared n-gram. In any fixed order of n-grams, two sets of similarity
t share one of the first n - ceil(t * n) + 1 n-grams of each, so only those are keys. Under a
key, the texts are points: the numbers of their n-grams in each of a number of hash groups. An
R-tree over the points finds those whose overlap with a text, bounded by the sum of the
coordinate minima, can be large enough. Texts that such surviving pairs connect form a cluster;
the sets of its texts are brought together once and its surviving pairs are verified on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import SPACES, RollingHash, bounded_batches, column_name, dropped, flat, mixed, steps, text_hash, written
from .components import components

#: Hash groups of a set, and of a set with more than LARGE n-grams, which needs a finer bound.
GROUPS, LARGE_GROUPS, LARGE = 64, 512, 1_024
LEAF = 16
TILE_ROWS = 1_024
#: Documents whose n-grams decide which ones are frequent, and frequent n-grams that are known at
#: most. Both only decide the order of n-grams, i.e. the work, never the result.
ORDER_DOCS = 2_000
ORDER_GRAMS = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_PLACE = np.random.default_rng(99).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams.

    A text with fewer words is one n-gram, a text without words (or null) has none.
    """
    data, bounds = flat(texts)
    for a, b in steps(bounds):
        part = _LOWER[data[bounds[a] : bounds[b]]]
        own = bounds[a : b + 1] - bounds[a]
        if not len(part):
            yield from (np.zeros(0, np.uint64) for _ in range(a, b))
            continue
        word = ~_SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[own] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
        ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
        hashes = RollingHash(part).at(starts, ends)
        first = np.searchsorted(starts, own)
        grams = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for k in range(words):
            grams += hashes[k : k + len(grams)] * _PLACE[k]
        grams = mixed(grams + np.uint64(words))
        for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if j - i >= words:
                yield np.unique(grams[i : j - words + 1])
            elif j > i:
                yield mixed(np.array([(hashes[i:j] * _PLACE[: j - i]).sum(dtype=np.uint64)], np.uint64) + np.uint64(j - i))
            else:
                yield np.zeros(0, np.uint64)


def prefix_length(n: int, percent: int) -> int:
    """How many n-grams of a set of n two sets of at least ``percent`` similarity must share one of."""
    return n - -(-n * percent // 100) + 1


class RTree:
    """Points (count vectors) packed into leaves of LEAF, these into nodes of LEAF, and so on.

    Points are packed by size first and by their most varying coordinate second. A node keeps
    the largest coordinates and the smallest size of what lies below it.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        slices = max(1, int(np.sqrt(len(sizes) / LEAF)))
        order = np.argsort(sizes, kind="stable")
        axis = int(np.argmax(counts.var(axis=0)))
        parts = [p[np.argsort(counts[p, axis], kind="stable")] for p in np.array_split(order, slices)]
        self.order = np.concatenate(parts)
        self.levels = [(counts[self.order], sizes[self.order])]
        while len(self.levels[-1][1]) > LEAF:
            upper, least = self.levels[-1]
            at = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at)))

    def near(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose overlap with ``point`` may reach the similarity."""
        at = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            if depth < len(self.levels) - 1:
                at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
                at = at[at < len(least)]
            bound = np.minimum(upper[at], point).sum(axis=1)
            at = at[bound * (100 + percent) >= percent * (size + least[at])]
        return self.order[at]


def group_counts(grams: np.ndarray) -> np.ndarray:
    """Numbers of n-grams per hash group; the groups of a large set fold into those of a small one."""
    groups = GROUPS if len(grams) <= LARGE else LARGE_GROUPS
    return np.bincount((grams & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


class Survivors:
    """The pairs of a group of texts that the bound lets through, found by R-trees.

    Sets of up to LARGE n-grams, and those that are just large enough to be near one, are
    compared by few groups, larger ones by many.
    """

    def __init__(self, counts: list[np.ndarray], sizes: np.ndarray, right: np.ndarray, percent: int):
        self.percent, self.sizes = percent, sizes
        self.small = np.stack([c.reshape(-1, GROUPS).sum(axis=0) for c in counts])
        self.large = {i: c for i, c in enumerate(counts) if sizes[i] > LARGE}
        low, high = right[sizes[right] * percent <= LARGE * 100], right[sizes[right] > LARGE]
        self.low = (low, RTree(self.small[low], sizes[low])) if len(low) else None
        self.high = (high, RTree(np.stack([self.large[i] for i in high.tolist()]), sizes[high])) if len(high) else None

    def of(self, i: int) -> np.ndarray:
        size, found = int(self.sizes[i]), []
        if self.low and size * self.percent <= LARGE * 100:
            rows, tree = self.low
            found.append(rows[tree.near(self.small[i], size, self.percent)])
        if self.high and size > LARGE:
            rows, tree = self.high
            found.append(rows[tree.near(self.large[i], size, self.percent)])
        out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return out[out != i]


def connected(survivors: Survivors, left: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the surviving pairs of ``left``."""
    label, links = np.arange(n), []
    for i in left.tolist():
        found = survivors.of(i)
        for j in found[label[found] != label[i]].tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def linked(percent: int, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of ``left`` with ``right``, verified on the sets.

    Pairs that earlier links have brought together already are not verified again.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    survivors = Survivors([group_counts(s) for s in sets], sizes, right, percent)
    label, links = np.arange(len(sets)), []
    for i in left.tolist():
        found = survivors.of(i)
        found = found[label[found] != label[i]]
        while len(found):
            j, found = int(found[0]), found[1:]
            both = np.concatenate([sets[i], sets[j]])
            both.sort()
            overlap = int((both[1:] == both[:-1]).sum())
            if 100 * overlap >= percent * (sizes[i] + sizes[j] - overlap):
                links.append((i, j))
                label[label == label[j]] = label[i]
                found = found[label[found] != label[i]]
    return links


def _by_group(rows: DataFrame, keys: list[str], links: Callable[[tuple, list[tuple]], list[tuple[int, int]]]) -> DataFrame:
    """(a, b) links that ``links`` gives for the rows of each group; a group is gathered in one task.

    Many small groups share a task, so the rows are sorted by key and read one after the other.
    """
    columns = [*keys, *[c for c in rows.columns if c not in keys]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        n = len(keys)

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and group[0][:n] != row[:n]:
                    out += links(group[0][:n], group)
                    group = []
                group.append(row)
            yield batch_of(out)
        yield batch_of(links(group[0][:n], group) if group else [])

    ordered = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "a long, b long")


def _tiled(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a group with several ``tiles``, once for each pair of tiles that their own belongs to."""
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    pair = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high")]
    return rows.select(key, *pair, "tile", *[c for c in rows.columns if c not in (key, "other", "tiles", "tile")])


def _packed(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint8 if counts.max(initial=0) < 256 else np.uint32).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    groups = GROUPS if n <= LARGE else LARGE_GROUPS
    return np.frombuffer(raw, np.uint8 if len(raw) == groups else np.uint32).astype(np.int64)


def _frequent(docs: DataFrame, words: int, doc_id: str, text: str) -> np.ndarray:
    """n-grams that a part of the documents shares, of a bounded sample by a hash of the id."""
    chosen = docs.select(F.col(doc_id).alias("_id")).where(F.col("_id").isNotNull()).orderBy(F.xxhash64("_id"), "_id").limit(ORDER_DOCS)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(0), words))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["g"])

    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen.distinct()), "_id").select("_text")
    often = sample.mapInArrow(grams, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n >= 8").orderBy(F.desc("n"), "g").limit(ORDER_GRAMS)
    return np.sort(np.array([r["g"] for r in often.select("g").collect()], np.int64).view(np.uint64))


def groups_of(
    docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """Per row of ``docs``: doc_id, tag (hash of the text), n_shingles, component_id, kept.

    ``component_id`` is the smallest id that is reached by links of at least ``percent``
    similarity, the own one included; ``kept`` marks the rows of one document of each group
    (smallest id, then tag; repeated rows of it are all marked). Rows without words are linked
    with nothing and kept. Equal sets stand for each other. A row without id takes part, and
    has a null component if all that it reaches have none.

    Every text is read whole. Texts that share frequent n-grams only seldom meet, as frequent
    ones come last in the order. Keys with the same texts are one key. Under a key move 64 to 512
    counts per text; the sets move once, and only those of texts with a surviving pair. A key or
    cluster with more than ``tile_rows`` texts is joined tile by tile in tasks of their own, each
    of which returns a spanning forest and no pairs. Only the result's narrow rows stay on disk.
    """
    bounded_batches(docs.sparkSession)
    frequent = _frequent(docs, words, doc_id, text)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("tag"), F.col(text).alias("text"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, fp2, prefixes, counts = [], [], [], [], []
            for s in shingle_sets(batch.column(2), words):
                n.append(len(s))
                counts.append(_packed(group_counts(s)))
                fp.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                fp2.append(int(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)))
                if len(frequent) and len(s):
                    at = np.searchsorted(frequent, s)
                    last = frequent[np.minimum(at, len(frequent) - 1)] == s
                    if last.any():
                        s = np.concatenate([s[~last], s[last]])
                prefixes.append(s[: prefix_length(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, fp, fp2)), pa.array(counts, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                ["doc_id", "tag", "n", "fp", "fp2", "counts", "prefix"],
            )

    kind = dict(narrow.dtypes)["doc_id"]
    sets = narrow.mapInArrow(keys, f"doc_id {kind}, tag long, n long, fp long, fp2 long, counts binary, prefix array<long>")
    sets = written(sets.withColumn("row", F.monotonically_increasing_id()), "shingle-keys")
    same = ["n", "fp", "fp2"]
    classes = written(
        sets.where("n > 0").groupBy(*same).agg(
            F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first")
        ),
        "shingle-classes",
    )
    nodes = sets.join(classes.select("node"), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "doc_id", "tag", "prefix")
    postings = nodes.select(F.explode("prefix").alias("key"), "node")
    shared = postings.groupBy("key").agg(
        F.count("*").alias("n_nodes"), F.min("node").alias("low"), F.max("node").alias("high"), F.bit_xor(F.xxhash64("node")).alias("who")
    ).where("n_nodes > 1")
    shared = shared.groupBy("n_nodes", "low", "high", "who").agg(F.min("key").alias("key"))
    shared = written(
        shared.select(F.col("key").alias("_key"), F.ceil(F.col("n_nodes") / tile_rows).cast("long").alias("tiles")), "shingle-shared"
    )
    met = written(postings.join(shared, F.col("key") == F.col("_key")).select("key", "tiles", "node"), "shingle-postings")
    dropped(shared)
    wanted = met.groupBy("node").agg(F.collect_list(F.struct("key", "tiles")).alias("keys")).withColumnRenamed("node", "_node")

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            bounds, values = lists.offsets.to_numpy(), lists.values
            row = np.repeat(np.arange(len(batch)), np.diff(bounds))
            for i in range(0, len(row), 20_000):
                at = pa.array(row[i : i + 20_000])
                own = values.slice(bounds[0] + i, len(at))
                yield pa.RecordBatch.from_arrays(
                    [pc.struct_field(own, 0), pc.struct_field(own, 1), *(batch.column(c).take(at) for c in range(3))],
                    ["key", "tiles", "node", "n", "counts"],
                )

    keyed = sets.join(wanted, F.col("row") == F.col("_node")).select("row", "n", "counts", "keys")
    keyed = keyed.mapInArrow(points, "key long, tiles long, node long, n long, counts binary")

    def surviving(key: tuple, group: list[tuple]) -> list[tuple[int, int]]:
        sizes = np.array([r[5] for r in group], np.int64)
        if len(group) < 2 or sizes.min() * 100 < percent * sizes.max() and len(group) == 2:
            return []
        counts = [_unpacked(r[6], r[5]) for r in group]
        tile = np.array([r[3] for r in group])
        left, right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        if not len(left) or not len(right):
            return []
        found = connected(Survivors(counts, sizes, right, percent), left, len(group))
        return [(group[i][4], group[j][4]) for i, j in found]

    pairs = _by_group(_tiled(keyed, "key"), ["key", "low", "high"], surviving)
    pairs = written(pairs, "surviving-pairs")
    dropped(met)
    clusters = components(pairs)
    tiles = clusters.groupBy("root").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("tiles")).withColumnRenamed("root", "cluster")
    members_of = written(clusters.join(tiles, F.col("root") == F.col("cluster")).select("node", "cluster", "tiles"), "shingle-clusters")
    dropped(pairs)
    placed = nodes.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"))
    placed = placed.join(members_of, F.col("_node") == F.col("node")).select("_id", "_tag", "node", "cluster", "tiles")
    texts = narrow.join(placed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag"))).select("text", "node", "cluster", "tiles")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([x.tobytes() for x in shingle_sets(batch.column(0), words)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (1, 2, 3)), raw], ["node", "cluster", "tiles", "grams"])

    members = texts.mapInArrow(gather, "node long, cluster long, tiles long, grams binary")

    def verified(key: tuple, group: list[tuple]) -> list[tuple[int, int]]:
        group = list({r[4]: r for r in group}.values())  # repeated rows have one node
        tile = np.array([r[3] for r in group])
        left, right = np.flatnonzero(tile == key[1]), np.flatnonzero(tile == key[2])
        if len(group) < 2 or not len(left) or not len(right):
            return []
        found = linked(percent, [np.frombuffer(r[5], np.uint64) for r in group], left, right)
        return [(group[i][4], group[j][4]) for i, j in found]

    links = written(_by_group(_tiled(members, "cluster"), ["cluster", "low", "high"], verified), "shingle-links")
    dropped(members_of)
    roots = components(links)
    placed = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min("first").alias("best"))
    named = placed.join(best, "root").select(*[F.col(c).alias("_" + c) for c in same], "best")
    on = (F.col("n") == F.col("_n")) & (F.col("fp") == F.col("_fp")) & (F.col("fp2") == F.col("_fp2"))
    empty = sets.where("n = 0").select("doc_id", "tag", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    full = sets.where("n > 0").join(named, on).select(
        "doc_id", "tag", "n", F.col("best.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("tag") == F.col("best.tag"))).alias("kept"),
    )
    groups = written(full.unionByName(empty).select("doc_id", "tag", F.col("n").alias("n_shingles"), "component_id", "kept"), "shingle-groups")
    dropped(sets, classes, links)
    return groups


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``groups_of`` keeps, one row of each group, all columns as they are.

    Of repeated rows the one with the smallest other values stays; rows without words all stay.
    Texts are shuffled once: the key of the join, in which null ids are equal, is that of the window.
    """
    own, place, key, all_rows = (column_name(docs, c) for c in ("text_key", "place", "kept_key", "kept_all"))
    kept = groups_of(docs, words, percent, doc_id, text).where("kept").select(
        F.struct(F.col("doc_id").alias("id"), "tag").alias(key), (F.col("n_shingles") == 0).alias(all_rows)
    ).distinct()
    same = F.struct(F.col(doc_id).alias("id"), text_hash(text).alias("tag")).cast(kept.schema[key].dataType)  # else the join casts it
    rows = docs.withColumn(own, same).join(kept, F.col(own) == F.col(key))
    order = Window.partitionBy(own).orderBy(*[F.col(c) for c in docs.columns if c not in (doc_id, text)] or [F.lit(0)])
    return rows.withColumn(place, F.row_number().over(order)).where(F.col(all_rows) | (F.col(place) == 1)).select(*docs.columns)
