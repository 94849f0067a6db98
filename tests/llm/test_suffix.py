"""Repeated strings against brute force, and the sort below them."""

import random
from collections import Counter

import numpy as np
import pytest

from callspark.llm import suffix_dedup as sd

DOCS = "doc_id long, text string, tag string, kept string, n_chars long"


def _brute(rows, window):
    texts = [(t or "").encode() for _, t in rows]
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for (i, _), t in zip(rows, texts, strict=True):
        mark = bytearray(len(t))
        for p in range(len(t) - window + 1):
            if count[t[p : p + window]] > 1:
                mark[p : p + window] = b"\1" * window
        kept = bytes(b for b, m in zip(t, mark, strict=True) if not m)
        spans = sum(m and not before for m, before in zip(mark, b"\0" + bytes(mark), strict=False))
        out.append((i, sum(mark), spans, kept))
    return out


def _rows():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdeé ", k=rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rng.randrange(1, 120)) for _ in range(40)]
    passage, exact = text(14), text(60)
    texts += [text(rng.randrange(30)) + passage + text(rng.randrange(30)) for _ in range(60)]
    texts += [exact] * 5
    for _ in range(40):  # near copies
        copy = list(exact)
        for _ in range(3):
            copy[rng.randrange(len(copy))] = rng.choice("xyz")
        texts.append("".join(copy))
    texts += [None, "", "a" * 39, "a" * 40, "b" * 300, "ab" * 200, "ab" * 90 + text(30), "é" * 50, exact[:40], exact[3:50] + passage[2:60]]
    return list(enumerate(texts))


@pytest.mark.parametrize(("window", "gram", "group"), [(40, 12, 200), (40, 12, 5), (64, 40, 3), (30, 29, 200), (33, 1, 20)])
def test_removed_bytes_equal_brute_force(spark, window, gram, group):
    rows = _rows()
    frame = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.removed_repeats(frame, window, gram, group_contexts=group).collect()}
    want = {i: x for i, *x in _brute(rows, window)}
    assert sum(x[0] > 0 for x in want.values()) > 90
    for i, (removed, spans, kept) in want.items():
        assert got.get(i, (0, 0, (dict(rows)[i] or "").encode())) == (removed, spans, kept), i


def test_repeated_rows_and_text(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    rows = [(1, text, "a", "b", 300), (1, text, "a", "b", 300), (None, "é" + text[:100], "a", "b", 101), (3, text[200:] + "é" * 80, "a", "b", 180)]
    frame = spark.createDataFrame(rows, DOCS)
    found = sd.without_repeats(frame, window=60, gram=20)
    assert found.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in found.collect()) == [(0, "é", 1), (1, "", 0), (1, "", 0), (3, "é" * 0, 0)]
    assert sd.removed_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_long_text_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sd, "PART_BYTES", 1_000)
    monkeypatch.setattr(sd, "steps", lambda bounds: ((i, i + 1) for i in range(len(bounds) - 1)))
    rng = random.Random(2)
    text = "".join(rng.choices("abcd", k=5_000))
    data = np.frombuffer(text.encode(), np.uint8)
    whole = sd.anchors(data, np.array([0, 5_000]), 50, 20)
    assert int(whole[2].sum()) == 5_000 - 49
    rows = [(1, text), (2, text[970:1_090] + "x" + text[2_000:2_049])]
    frame = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in rows], DOCS)
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in sd.removed_repeats(frame, 50, 20).collect()}
    assert got == {i: tuple(x) for i, *x in _brute(rows, 50)}


def test_order_of_deep_shallow():
    rng = random.Random(4)
    for depth in (0, 4, 16):
        strings = ["".join(rng.choices("ab", k=rng.randrange(40))).encode() for _ in range(200)] + [b"", b"", b"a" * 90, b"a" * 91]
        order = sd.deep_shallow(strings, depth)
        assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)
    matrix = sd._prefix_matrix(strings)
    for i in range(0, 200, 9):
        for j in range(0, 200, 7):
            if i != j:
                n = 0
                while n < min(len(strings[i]), len(strings[j])) and strings[i][n] == strings[j][n]:
                    n += 1
                assert matrix[i, j] == n
