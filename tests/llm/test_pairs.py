"""Near-duplicate operators against brute force, and the components below them."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from callspark.llm import cap_filters, jaccard
from callspark.llm.components import components


def _roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5), (1, 2), (2, 1)]
    links += [(700, 701 + i) for i in range(200)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    want = _roots({x for pair in links for x in pair}, links)
    assert len({r["node"] for r in found}) == len(found)
    assert {r["node"]: r["root"] for r in found} == {n: r for n, r in want.items() if any(n in p and p[0] != p[1] for p in links)}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


VECTORS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
    T.StructField("node", T.StringType()),
])


def _vectors():
    rng = np.random.default_rng(1)
    rows = []
    for label in (0, 1):
        centres = rng.standard_normal((6, 16))
        for i in range(120):
            v = centres[i % 6] + rng.standard_normal(16) * (0.2 if i % 3 else 0.45)
            rows.append((v.astype(np.float32).tolist(), label))
    rows += [(rows[0][0], 0), (rows[0][0], 0), (rows[0][0], 1), (rows[0][0], None), (None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0)]
    rows += [([float("inf")] + [1.0] * 15, 1), ([None] + [1.0] * 15, 1), ([1.0, 2.0], 0), ([2.0, 4.0], 0), ([], 0), ([3.0], 0), ([5.0], 0)]
    return [(i * 3 % len(rows) if len(rows) % 3 else i, v, label, "x") for i, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("settings", [{}, {"filter_rows": 8, "tile_rows": 5}])
def test_cap_filters_equal_brute_force(spark, settings):
    rows = _vectors()
    found = {r["vec_id"]: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, VECTORS), **settings).collect()}
    assert len(found) == len(rows)
    good = [
        (i, np.array(v, np.float64), label) for i, v, label, _ in rows
        if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)
    ]
    links = [
        (a, b) for n, (a, v, x) in enumerate(good) for b, w, y in good[n + 1 :]
        if x == y and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93
    ]
    assert len(links) > 300
    degree = {i: sum(i in pair for pair in links) for i, *_ in rows}
    roots = _roots([i for i, *_ in rows], links)
    for i, *_ in rows:
        assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (degree[i], roots[i], roots[i] == i)


def test_cap_filter_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    caps = cap_filters.choose_caps(6_000, 0.93)
    x = rng.standard_normal((2_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    (ra, ca), (rb, cb) = cap_filters.decode(caps, x), cap_filters.decode(caps, y)
    shared = set(zip(ra.tolist(), ca.tolist(), strict=True)) & set(zip(rb.tolist(), cb.tolist(), strict=True))
    assert len({r for r, _ in shared}) >= 0.99 * len(x)


@pytest.mark.parametrize("rows", [6_000, 600_000, 10**6, 10**7])
def test_cap_filter_recall_at_any_size(rows):
    """Of 8,000 pairs at just 0.93, about 1 in 1,000 shares no filter; every vector passes many."""
    rng = np.random.default_rng(9)
    caps = cap_filters.choose_caps(rows, 0.93)
    x = rng.standard_normal((8_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * side
    (ra, ca), (rb, cb) = cap_filters.decode(caps, x), cap_filters.decode(caps, y)
    both = np.intersect1d(*(r * (int(max(ca.max(), cb.max())) + 1) + c for r, c in ((ra, ca), (rb, cb))))
    met = np.unique(both // (int(max(ca.max(), cb.max())) + 1))
    assert len(met) >= 0.998 * len(x)
    passed = np.bincount(ra, minlength=len(x))
    assert np.median(passed) >= 40 and (passed > 1).mean() > 0.999


def test_decode_is_exact_in_several_codes():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for caps in (cap_filters.Caps(2, 9, 1.2, 3), cap_filters.Caps(2, 3, 9.0, 5)):
        scores = []
        for rotation in range(caps.rotations):
            a, b = (x @ w for w in cap_filters._code_words(2, caps.words, 12, rotation))
            scores.append((a[:, :, None] + b[:, None, :]).reshape(len(x), -1))
        scores = np.concatenate(scores, axis=1)
        passed = scores >= caps.height
        none = ~passed.any(1)
        passed[none, scores[none].argmax(1)] = True
        row, code = np.nonzero(passed)
        got = cap_filters.decode(caps, x)
        assert (got[0] == row).all() and (got[1] == code).all()


def test_decode_is_exact():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((40, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for caps in (cap_filters.Caps(2, 9, 1.2), cap_filters.Caps(4, 4, 1.5), cap_filters.Caps(2, 3, 9.0)):
        words = cap_filters._code_words(caps.blocks, caps.words, 12)
        scores = x @ words[0]
        for w in words[1:]:
            scores = (scores[:, :, None] + (x @ w)[:, None, :]).reshape(len(x), -1)
        passed = scores >= caps.height
        none = ~passed.any(1)
        passed[none, scores[none].argmax(1)] = True
        row, code = np.nonzero(passed)
        got = cap_filters.decode(caps, x)
        assert (got[0] == row).all() and (got[1] == code).all()


def test_empty_vectors(spark):
    assert cap_filters.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


TEXTS = "doc_id long, text string, tag string, n long"


def _shingles(text, words):
    import re

    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if len(found) >= words else {tuple(found)}


def _texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(60)]
    texts = []
    for base in range(12):
        words = rng.choices(vocabulary, k=rng.choice([3, 8, 40, 90]))
        for _ in range(rng.choice([1, 4, 12])):
            copy = list(words)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    shared = " ".join(rng.choices(vocabulary, k=30))
    texts += [shared + " " + " ".join(rng.choices(vocabulary, k=25)) for _ in range(20)]
    texts += [None, "", "  \t\n", "One", "one", "one two", "ONE\ttwo ", "a b c", "a b c d", "x " * 5000, "x " * 4000, "Ä b c", "ä b c"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("words", "percent", "tile_rows"), [(3, 90, 1024), (5, 80, 4), (3, 50, 7)])
def test_jaccard_groups_equal_brute_force(spark, words, percent, tile_rows):
    rows = _texts()
    frame = spark.createDataFrame([(i, t, "own", 1) for i, t in rows], TEXTS)
    found = {r["doc_id"]: r for r in jaccard.groups_of(frame, words, percent, tile_rows=tile_rows).collect()}
    sets = {i: _shingles(t, words) for i, t in rows}
    links = [
        (a, b) for a, x in sets.items() for b, y in sets.items()
        if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)
    ]
    roots = _roots(list(sets), links)
    assert len(links) > 30
    for i in sets:
        assert (found[i]["n_shingles"], found[i]["component_id"], found[i]["kept"]) == (len(sets[i]), roots[i], roots[i] == i)
    kept = jaccard.one_per_group(frame, words, percent)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i in sets if roots[i] == i)


def test_jaccard_repeated_rows_and_null_ids(spark):
    text = "one two three four five six seven eight"
    rows = [(7, text, "a", 1), (7, text, "b", 1), (7, text, "b", 1), (None, text, "c", 1), (9, None, "d", 1), (9, None, "d", 1)]
    frame = spark.createDataFrame(rows, TEXTS)
    found = jaccard.groups_of(frame).collect()
    assert len(found) == 6 and all(r["component_id"] == 7 for r in found if r["n_shingles"])
    assert sorted((r["doc_id"], r["tag"]) for r in jaccard.one_per_group(frame).collect()) == [(7, "a"), (9, "d"), (9, "d")]
    empty = spark.createDataFrame([], TEXTS)
    assert jaccard.groups_of(empty).count() == 0 and jaccard.one_per_group(empty).count() == 0


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 5, (500, 8))
    sizes = counts.sum(1)
    tree = jaccard.RTree(counts, sizes)
    for i in range(0, 500, 25):
        bound = np.minimum(counts, counts[i]).sum(1)
        want = np.flatnonzero(bound * 180 >= 80 * (sizes + sizes[i]))
        assert sorted(tree.near(counts[i], int(sizes[i]), 80).tolist()) == want.tolist()
