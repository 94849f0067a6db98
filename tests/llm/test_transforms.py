"""Fill-in-middle and vector codes against brute-force versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from callspark.llm import dual_tree, fim

TEXTS = [
    "", None, "\n", "one line", "a\nb\nc", "a\nb\n", "é\n日本\n\U0001f600 x\n\n\n", "has <P> in it\nx", "<\nP>\n<S\n><M\n>", "end <\n<P\n",
    "x" * 300_000 + "\n" + "y\n" * 200, *("\n".join(f"line {j} of {i}" for j in range(i)) for i in range(40)),
]


def _cut(doc_id, text, rate=100, spm_rate=50):
    """(n, form, prefix chars, middle chars, output) by the definition."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 0), (100, 100)])
def test_fill_in_middle(spark, rate, spm_rate):
    rows = [(i if i != 7 else None, t, "own", b"own") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, output binary")
    made = fim.restored(fim.fill_in_middle(docs, rate=rate, spm_rate=spm_rate), "_output", "_form", "form")
    found = {r["doc_id"]: r for r in made.collect()}
    for doc_id, text, *_ in rows:
        r = found[doc_id]
        assert (r["n"], r["_form"], r["prefix_chars"], r["middle_chars"], r["_output"].decode()) == _cut(doc_id, text, rate, spm_rate)
        assert r["__form"].decode() == (text or "") and r["form"] == "own" and r["output"] == b"own"
    empty = fim.restored(fim.fill_in_middle(docs.limit(0)))
    assert empty.count() == 0 and empty.columns[-1] == "restored"


def test_rotations():
    rng = random.Random(1)
    for n in [0, 1, 2, 7, 1000, 3 * fim._SWAP + 5]:
        data = rng.randbytes(n)
        for _ in range(6):
            a, b, c = sorted(rng.randint(0, n) for _ in range(3))
            buffer = bytearray(data)
            fim.rotate(buffer, a, b, c)
            assert buffer == data[:a] + data[b:c] + data[a:b] + data[c:]
            fim.rotate(buffer, a, a + c - b, c)
            assert buffer == data


@pytest.mark.parametrize("marks", [(b"<P>", b"<P>", b"<M>"), (b"", b"a", b"b"), (b"ab", b"bc", b"x"), (b"abc", b"b", b"x"), (b"aa", b"b", b"c")])
def test_sentinels_that_could_not_be_undone(marks):
    with pytest.raises(ValueError):
        fim.check_sentinels(marks)


def _lloyd(rows, parts, entries, rounds, scale=4096):
    """[(id, label, code, error)] and the digest, every part against every entry."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    whole = [[math.floor(scale * x) for x in r[1]] for r in good]
    width = len(whole[0])
    at = [width * i // parts for i in range(parts + 1)]
    codes, errors, shown = [""] * len(good), [0] * len(good), []
    for p in range(parts):
        points = [tuple(w[at[p] : at[p + 1]]) for w in whole]
        book = points[:entries]
        nearest = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))  # noqa: E731, B023
        for _ in range(rounds):
            mine = [nearest(x)[1] for x in points]
            fresh = []
            for i, e in enumerate(book):
                group = [x for x, m in zip(points, mine, strict=True) if m == i]
                fresh.append(tuple(sum(c) // len(group) for c in zip(*group, strict=True)) if group else e)
            book = fresh
        for i, x in enumerate(points):
            d, e = nearest(x)
            codes[i] += f"{e:02x}"
            errors[i] += d
        shown += [str(c) for e in book for c in e]
    by_label = {}
    for r, e in zip(good, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(shown).encode()).hexdigest()
    return sorted(((r[0], c, e, by_label[r[2]], digest) for r, c, e in zip(good, codes, errors, strict=True)), key=str)


def _rows(kind):
    rng = np.random.default_rng(3)
    if kind == "odd":
        rows = [(i, rng.normal(size=19).tolist(), [None, 1, 2][i % 3]) for i in range(300)]
        rows += [(1000, None, 1), (1001, [], 1), (1002, [1.0] * 18 + [float("nan")], 1), (1003, [None] * 19, 2), (1004, [float("inf")] * 19, 1), (1005, [0.5] * 3, 1)]
        return rows + [(None, [0.25] * 19, None), (5, [0.5] * 19, 3), (5, [0.5] * 19, 3)]
    if kind == "ties":  # few different values, so that distances are often equal
        return [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), i % 2) for i in range(400)]
    if kind == "clusters":
        centres = rng.normal(size=(20, 16))
        return [(i, (centres[i % 20] + 1e-3 * rng.normal(size=16)).tolist(), None) for i in range(900)]
    return [(i, rng.normal(size=8).tolist(), 0) for i in range(5)]  # fewer than the entries


@pytest.mark.parametrize("kind", ["odd", "ties", "clusters", "few"])
def test_codes_equal_brute_force(spark, monkeypatch, kind):
    rows = _rows(kind)
    monkeypatch.setattr(dual_tree, "BLOCK_ROWS", 128)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("own")).repartition(3)
    found = dual_tree.compress(table, entries=16, rounds=4)
    assert sorted([tuple(r) for r in found.collect()], key=str) == _lloyd(rows, 8, 16, 4)


def test_no_vectors_and_very_large_ones(spark):
    none = spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<double>, label int")
    assert dual_tree.compress(none).count() == 0 and dual_tree.compress(none.limit(0)).count() == 0
    rows = [(i, [1e300 if i % 2 else -1e300, float(i)], 0) for i in range(40)]
    found = dual_tree.compress(spark.createDataFrame(rows, none.schema), parts=2, entries=2, rounds=2).collect()
    assert len(found) == 40 and all(r["code"][:2] == ("01" if r["vec_id"] % 2 else "00") for r in found)


def test_whole_nodes_are_assigned_without_comparing_their_rows():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = centres[rng.integers(0, 16, 8000)] + rng.integers(-20, 20, (8000, 8))
    tree = dual_tree.build_tree(points)
    packed = dual_tree._unpacked(*dual_tree._packed(tree), width=8)
    for t in (tree, packed):
        one = dual_tree.Assignment(t, points, centres, with_codes=True)
        want = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (one.codes == want).all() and one.counts.tolist() == np.bincount(want, minlength=16).tolist()
        assert (one.sums == np.stack([points[want == e].sum(axis=0) for e in range(16)])).all()
        assert one.compared < 0.1 * 16 * len(points)
