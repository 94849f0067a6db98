"""The sharded inverted index against searching every word in every document."""

import random

import pytest
from pyspark.sql import functions as F

from callspark.functions import postings
from callspark.operators import vector as v


def _rows():
    rng = random.Random(3)
    letters = "aab é日\U0001f600-."
    word = lambda: "".join(rng.choice(letters.replace(" ", "")) for _ in range(rng.randint(1, 7)))
    docs = [(f"d{i:03d}", " ".join(word() for _ in range(rng.randint(0, 30)))) for i in range(230)]
    docs += [("e1", None), ("e2", ""), ("e3", "ODD Case\tand　blanks"), ("e4", "x" * 5000)]
    asked = [(f"q{i}", " ".join(word() for _ in range(rng.randint(1, 9)))) for i in range(40)]
    asked += [("same", "a a b a"), ("none", ""), ("null", None), ("far", "zzz"), ("case", "case ODD x xx xxxx"), ("long", "x" * 4000)]
    return docs, asked


def _brute(docs, asked, k):
    out = []
    for query_id, query in asked:
        words = (query or "").lower().split()
        hits = []
        for id_, text in docs:
            found = sum(w in (text or "").lower() for w in words)
            if found:
                hits.append((-found / len(words), id_))
        out += [(query_id, id_, -s, i + 1) for i, (s, id_) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "tile", "k"), [(4096, 16384, 10), (17, 5, 3), (1, 100, 500)])
def test_keyword_search_equals_brute_force(spark, monkeypatch, shard, tile, k):
    docs, asked = _rows()
    docs = docs if shard > 1 else docs[200:]
    corpus = spark.createDataFrame(docs, "id string, document string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, query string")
    monkeypatch.setattr(postings, "SHARD_DOCS", shard)
    index = postings.keyword_index(corpus)
    words = queries.select("query_id", v._query_words(F.col("query")).alias("words"))
    found = postings.search(index, words, k, tile).collect()
    assert sorted((r["query_id"], r["id"], r["score"], r["rank"]) for r in found) == _brute(docs, asked, k)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "id string, document string")
    queries = spark.createDataFrame([("q", "word")], "query_id string, query string")
    assert v.keyword_search(none, queries, 3).count() == 0
    corpus = spark.createDataFrame([("a", "some word")], "id string, document string")
    assert v.keyword_search(corpus, queries.limit(0), 3).count() == 0


def test_words_are_found_by_their_rarest_run():
    terms = ["abc", "xabcx", "ab", "b", "日本語", "bcabc"]
    words = postings.Words(terms)
    for w in ["a", "ab", "abc", "bca", "xabc", "abcx", "日本", "本語", "日本語", "abcd", "q", "cab", "xabcxx"]:
        assert sorted(words.holding(w).tolist()) == [i for i, t in enumerate(terms) if w in t]
    assert postings.Words([]).holding("a").tolist() == []


def test_frequent_words_are_kept_by_the_documents_without_them():
    shard = postings.Shard([f"d{i}" for i in range(5)], *_packed([["hot", "a"], ["hot"], ["hot", "b"], ["hot"], ["c"]]))
    assert shard.documents("hot")[0] is False and shard.documents("hot")[1].tolist() == [4]
    assert shard.documents("c")[0] is True and shard.documents("c")[1].tolist() == [4]
    assert shard.counts(["hot", "b", "hot", "none"]).tolist() == [2, 2, 3, 2, 0]


def _packed(docs):
    import numpy as np

    terms = sorted({w for d in docs for w in d})
    lists = [[i for i, d in enumerate(docs) if t in d] for t in terms]
    ends = np.cumsum([len(x) for x in lists]).astype(np.int64)
    return " ".join(terms).encode(), ends.tobytes(), np.array([i for x in lists for i in x], np.int32).tobytes()


def test_a_shard_is_packed_and_searched_without_a_loop_over_its_words(spark):
    """Long words that share their runs of letters are narrowed down by all of them."""
    terms = [f"abcde{i:04d}fghij" for i in range(3000)] + ["fghijabcde", "xbcdefgx"]
    words = postings.Words(terms)
    tested = []

    class Counted(str):
        def __contains__(self, other):
            tested.append(other)
            return str.__contains__(self, other)

    words.terms = [Counted(t) for t in terms]
    assert words.holding("abcde1234fghij").tolist() == [1234] and words.holding("jabcd").tolist() == [3000]
    assert words.holding("cdefg").tolist() == [3001] and words.holding("deabc").tolist() == []
    assert len(tested) < 10
    docs = spark.createDataFrame([("a", "one  two\x1cone\u2003two "), ("b", None), ("c", "two")], "id string, document string").coalesce(1)
    row = postings.keyword_index(docs).first()
    shard = postings.Shard(row["ids"], bytes(row["terms"]), bytes(row["ends"]), bytes(row["docs"]))
    assert sorted(shard.words.terms) == ["one", "two"] and shard.counts(["one", "two"]).tolist() == [2, 0, 1]
