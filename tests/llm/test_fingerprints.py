"""Winnowing against a brute-force version, and its match guarantee."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from callspark.llm import winnowing
from callspark.llm.queries import op13_winnowing

DATA = "/root/testdata/sf0.001"


def _murmur(data):
    """The 32-bit hash of Spark SQL for bytes in whole words."""
    m, h = 0xFFFFFFFF, 42
    turn = lambda x, r: (x << r | x >> 32 - r) & m
    for i in range(0, len(data), 4):
        k = turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (turn(h ^ k, 13) * 5 + 0xE6546B64) & m
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def _brute(text, gram, window):
    """[(position, hash)] by trying every window."""
    text = text or ""
    n = max(len(text) - gram + 1, min(len(text), 1))
    known = {}
    h = [known[g] if (g := text[i : i + gram]) in known else known.setdefault(g, _murmur(g.encode("utf-32-be"))) for i in range(n)]
    kept = set()
    for a in range(max(n - window + 1, 1) if n else 0):
        part = h[a : a + window]
        least = min(part)
        kept.add(a + len(part) - 1 - part[::-1].index(least))
    return [(i, h[i]) for i in sorted(kept)]


def _like(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def _texts():
    rng = random.Random(5)
    texts = ["", None, "a", "ab" * 700, "a" * 3000, "日本語 é\U0001f600" * 40, "x" * 24, "x" * 25, "x" * 26]
    for n in [10, 60, 123, 124, 125, 300, 1500, 2600, 9000]:
        texts += ["".join(rng.choice("ab c") for _ in range(n)), "".join(rng.choice("abcdefgh é") for _ in range(n))]
    return texts


@pytest.mark.parametrize(("gram", "window", "block"), [(25, 100, 1024), (25, 100, 60), (3, 4, 7), (2, 1, 5), (5, 8, 1), (1, 200, 64)])
def test_kept_grams_equal_brute_force(spark, gram, window, block):
    texts = _texts() if block > 1 else _texts()[:14]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = winnowing.kept_grams(F.col("text"), gram, window, block=block)
    shown = F.transform(kept, lambda x: F.struct(winnowing.position(x), winnowing.gram_hash(x)))
    found = {r["doc_id"]: [tuple(x) for x in r["kept"]] for r in docs.select("doc_id", shown.alias("kept")).collect()}
    assert found == {i: _brute(t, gram, window) for i, t in enumerate(texts)}


@pytest.mark.parametrize(("small", "look"), [(1, 1), (8, 2), (100, 16)])
def test_neither_bound_changes_what_is_kept(spark, monkeypatch, small, look):
    """Windows without a small hash, and with more of them than are looked at first."""
    monkeypatch.setattr(winnowing, "SMALL_PER_WINDOW", small)
    monkeypatch.setattr(winnowing, "LOOK", look)
    test_kept_grams_equal_brute_force(spark, 6, 20, 200)


def test_a_shared_passage_is_always_found(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    rows = []
    for i in range(60):
        shared = word(winnowing.GRAM + winnowing.WINDOW - 1)
        rows.append((i, word(rng.randrange(900)) + shared + word(rng.randrange(900)), word(rng.randrange(900)) + shared + word(rng.randrange(900))))
    pairs = spark.createDataFrame(rows, "i int, a string, b string")
    for c in "ab":
        pairs = winnowing.with_fingerprint(pairs, c, into=f"kept_{c}")
    assert pairs.where(F.arrays_overlap(winnowing.hashes(F.col("kept_a")), winnowing.hashes(F.col("kept_b")))).count() == 60


def _expected(rows):
    """Per row the digest columns, by brute force."""
    order = sorted({(r[0] is not None, r[0] or 0, _HASHES[r[1]], r[1]) for r in rows}, key=lambda k: k[:3])
    following = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    out = []
    for doc_id, text in rows:
        key = (doc_id is not None, doc_id or 0, _HASHES[text], text)
        own, other = text or "", following[key][3] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + other[:half]
        a, b, c = (_brute(t, winnowing.GRAM, winnowing.WINDOW) for t in (own, edited, other))
        shown = [" ".join(f"{i}:{h & 0xFFFFFFFF:08x}" for i, h in x) for x in (a, b)]
        out.append((doc_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), *shown, _like(a, b), _like(a, c)))
    return sorted(out, key=str)


_HASHES = {}


def _compare(docs, found):
    rows = [tuple(r) for r in docs.select("doc_id", "text", winnowing.text_hash()).collect()]
    _HASHES.update({text: h for _, text, h in rows})
    assert sorted([tuple(r) for r in found.collect()], key=str) == _expected([r[:2] for r in rows])


def test_edited_likeness_of_odd_rows(spark):
    texts = _texts()
    rows = [(3 * i % 17 if i % 5 else None, t, i) for i, t in enumerate(texts)] + [(4, "same row", 0)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("_id", F.lit("own"))
    _compare(docs, winnowing.edited_likeness(docs))
    one = docs.where("doc_id = 4")
    _compare(one, winnowing.edited_likeness(one))
    assert winnowing.edited_likeness(docs.limit(0)).count() == 0


def test_query_on_given_documents(spark):
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), op13_winnowing(spark, DATA)
    _compare(docs, found)
    pairs = docs.join(found, "doc_id").groupBy("text").agg(F.count_distinct("fingerprint").alias("n"))
    assert pairs.where("n > 1").count() == 0
