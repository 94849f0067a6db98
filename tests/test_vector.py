import hashlib
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from callspark.functions.vectors import embedding_provider, hash_embedding
from callspark.operators import vector as v

AS_OF = datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        vec = rng.standard_normal(8)
        if i % 3 == 0:  # a third of the rows are copies of one vector
            vec = np.ones(8)
        rows.append((f"d{i:03d}", f"text {i} billing problem." if i % 2 else "refund", [float(x) for x in vec], "en" if i % 4 else "de",
                     datetime(2024, 1, 1 + i % 28), float(i)))
    df = spark.createDataFrame(
        rows, "id string, document string, embedding array<float>, campaign string, ts timestamp, duration double"
    )
    return df.repartition(7).withColumn("timestamp", F.col("ts").cast("timestamp_ntz")).drop("ts").withColumn(
        "agent_id", F.lit("a")
    ).withColumn("call_type", F.lit("")).withColumn("outcome", F.lit("x")).cache()


def queries_of(spark, n=5):
    rng = np.random.default_rng(2)
    rows = [(f"q{i}", "billing refund problem", [float(x) for x in (np.ones(8) if i == 0 else rng.standard_normal(8))]) for i in range(n)]
    return spark.createDataFrame(rows, "query_id string, query string, embedding array<float>")


def brute(corpus, queries, metric):
    c = [(r["id"], np.array(r["embedding"])) for r in corpus.select("id", "embedding").collect()]
    out = {}
    for q in queries.collect():
        x = np.array(q["embedding"])
        score = {
            "cosine": lambda y: x @ y / (np.linalg.norm(x) * np.linalg.norm(y)),
            "dot": lambda y: x @ y,
            "euclidean": lambda y: 1 / (1 + np.linalg.norm(x - y)),
        }[metric]
        out[q["query_id"]] = sorted(((-round(float(score(y)), 9), i) for i, y in c))
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_nearest_equals_brute_force(spark, corpus, metric):
    queries = queries_of(spark)
    want = brute(corpus, queries, metric)
    got = {}
    for r in v.nearest(corpus, queries, 12, metric).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["id"]))
    assert {q: rows for q, rows in got.items()} == {q: rows[:12] for q, rows in want.items()}


def test_many_copies_tie_by_id_and_blocks_change_nothing(spark, corpus):
    from callspark.functions.vectors import scored

    queries = queries_of(spark)
    top = scored(corpus, queries, 6, block=2).orderBy("query_id", "rank").collect()
    assert top == scored(corpus, queries, 6).orderBy("query_id", "rank").collect()
    assert [r["id"] for r in top if r["query_id"] == "q0"] == ["d000", "d003", "d006", "d009", "d012", "d015"]


def test_unknown_metric(spark, corpus):
    with pytest.raises(ValueError):
        v.nearest(corpus, queries_of(spark), 3, "manhattan")


def test_hash_embedding_is_the_seeded_normal_vector(spark):
    df = spark.createDataFrame([("hello",), ("hello",), ("other",)], "t string")
    a, b, c = [r["embedding"] for r in v.embed_texts(df, "t", hash_embedding(16)).collect()]
    seed = int.from_bytes(hashlib.sha256(b"hello").digest()[:4], "little")
    want = np.random.default_rng(seed).standard_normal(16)
    assert a == b and a != c
    assert a == pytest.approx(list(want / np.linalg.norm(want)), abs=1e-6)
    assert sum(x * x for x in c) == pytest.approx(1, abs=1e-5)
    seeded = v.embed_texts(df, "t", hash_embedding(16, 42)).first()["embedding"]
    assert seeded != a


def test_reuse_computes_only_new_texts(spark):
    calls = spark.sparkContext.accumulator(0)

    def count(texts):
        calls.add(len(texts))
        return np.array([[float(len(t))] for t in texts])

    provider = embedding_provider(count)
    df = spark.createDataFrame([(str(i), "same" if i % 3 else f"text {i}") for i in range(30)], "id string, t string")
    _, cache = v.embed_new(df.where("id < '2'"), "id", "t", None, "len", provider)
    cache = spark.createDataFrame(cache.collect(), cache.schema)
    calls.value = 0
    rows, _ = v.embed_new(df, "id", "t", cache, "len", provider)
    got = {r["id"]: r["embedding"] for r in rows.collect()}
    assert len(got) == 30 and got["1"] == [4.0] and got["27"] == [7.0]
    assert calls.value == 11 - cache.count()


def test_prepare_documents(spark):
    df = spark.sql(
        """SELECT * FROM VALUES ('1', '  hello   world  ', 'none', 5.0D), ('2', 'short', 'note here', 1.0D),
        (null, 'long enough text', 'x', 1.0D), ('', 'long enough text', 'x', 1.0D), ('3', null, null, 1.0D)
        AS t(call_id, transcript, notes, duration)"""
    )
    rows = v.prepare_documents(df, AS_OF, ("transcript", "notes"), ["call_id", "duration", "absent"], 10, 60).collect()
    assert [(r["id"], r["document"]) for r in rows] == [("1", "hello world"), ("2", "short NOTES: note here")]
    assert rows[0]["metadata"].asDict() == {"call_id": "1", "duration": 5.0, "indexed_at": "2024-02-01T00:00:00"}


def test_search_conditions_ignore_zero_and_infinite_bounds(corpus):
    assert v.search_condition({"duration_range": (0, math.inf)}, corpus.columns) is None
    cond = v.search_condition({"duration_range": (5, 0), "selected_campaigns": ["de"]}, corpus.columns)
    assert corpus.where(cond).agg(F.min("duration")).first()[0] == 8


def test_date_filter_comes_after_the_top_k(spark, corpus):
    f = {"date_range": ("2024-01-01", "2024-01-03")}
    late = v.semantic_search(corpus, queries_of(spark, 1), 10, f)
    early = v.semantic_search(corpus, queries_of(spark, 1), 10, f, prefilter_dates=True)
    assert late.count() < 10 and early.count() == 10
    assert early.agg(F.max("timestamp")).first()[0] <= datetime(2024, 1, 3, 23, 59, 59, 999999)


def test_weaker_hits_are_reported(spark, corpus):
    r = v.threshold_report(v.semantic_search(corpus, queries_of(spark, 1), 5, threshold=2.0)).first()
    assert (r["hits"], r["hits_without_threshold"], r["weaker_hits_exist"]) == (0, 5, True)


def test_hybrid_weights(spark):
    s = spark.createDataFrame([("q", "a", 0.5, 1), ("q", "b", 0.4, 2)], "query_id string, id string, score double, rank int")
    k = spark.createDataFrame([("q", "b", 1.0, 1), ("q", "c", 0.5, 2)], "query_id string, id string, score double, rank int")
    rows = v.combine_hits(s, k, 10).orderBy("rank").collect()
    assert [(r["id"], r["combined_score"], r["sources"]) for r in rows] == [
        ("b", pytest.approx(0.58), ["semantic", "keyword"]), ("a", pytest.approx(0.35), ["semantic"]), ("c", pytest.approx(0.15), ["keyword"]),
    ]


def test_keyword_search_counts_substrings(spark, corpus):
    rows = v.keyword_search(corpus, queries_of(spark, 2), 400).collect()
    score = {(r["query_id"], r["id"]): r["score"] for r in rows}
    assert score["q0", "d001"] == pytest.approx(2 / 3) and score["q1", "d000"] == pytest.approx(1 / 3)
    assert len(rows) == 600


def test_retrieve_reranks_only_where_more_than_k_remain(spark, corpus):
    q = queries_of(spark, 1)
    few = v.retrieve(corpus, q, AS_OF, 100, candidates=20).collect()
    assert {r["score"] for r in few} == {1.0}
    r = v.retrieve(corpus, q, AS_OF, 5, candidates=20).orderBy("rank").first()
    doc = corpus.where(F.col("id") == r["id"]).first()
    age = (AS_OF - doc["timestamp"]).days
    terms = sum(w in doc["document"].lower() for w in ("billing", "refund", "problem")) / 3
    filled = (1 + 1 + (doc["duration"] != 0)) / 4
    assert r["score"] == pytest.approx(0.5 + 0.2 * math.exp(-age / 30) + 0.15 * filled + 0.15 * terms)


def test_feedback_and_neighbours(spark, corpus):
    q = queries_of(spark, 1)
    base = v.retrieve(corpus, q, AS_OF, 10, min_similarity=0.9).orderBy("rank").collect()
    good, bad = base[-1], base[0]
    got = v.retrieve_with_feedback(corpus, q, AS_OF, [good["id"]], [bad["id"]], 5, 0.9).orderBy("rank").collect()
    assert got[0]["id"] == good["id"] and got[0]["score"] == pytest.approx(good["score"] * 1.5)
    assert [r["id"] for r in got[1:]] == [r["id"] for r in base[1:5]]
    near = v.neighbours(corpus, corpus.where("id = 'd000'"), 3).orderBy("rank").collect()
    assert [r["id"] for r in near] == ["d003", "d006", "d009"]


def test_snippets(spark):
    text = "a" * 150 + ". " + "b" * 100
    df = spark.createDataFrame([(text,), ("x y " * 80,), ("z" * 300,), ("ok",)], "t string")
    assert [r[0] for r in df.select(v.snippet(F.col("t"))).collect()] == ["a" * 150 + ".", ("x y " * 80)[:200] + "...", "z" * 200 + "...", "ok"]
    assert [r[0] for r in df.select(v.snippet(F.col("t"), 200, True)).collect()][1] == ("x y " * 80)[:199] + "..."


def test_explain(spark):
    df = spark.createDataFrame([("Need billing help now", "Billing help is here; need it"), ("one", "two")], "query string, document string")
    first, second = v.explain_relevance(df).collect()
    assert first["matching_keywords"] == ["billing", "help", "need"] and first["keyword_overlap_ratio"] == 0.75
    assert first["matching_phrases"] == ["billing help"] and second["matching_phrases"] == []


def test_clusters_sum_to_all_rows(spark, corpus):
    out = v.cluster_hits(corpus.select("id", "embedding"), 3).groupBy("cluster").count().collect()
    assert sum(r["count"] for r in out) == 300 and len(out) == 3
    assert [r["cluster"] for r in v.cluster_hits(corpus.limit(2), 3).collect()] == [0, 0]


def test_clustering_reads_its_input_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([(f"d{i}", f"{'billing refund' if i % 2 else 'password login'} word{i % 5}") for i in range(60)], "id string, document string")
    features = v.text_features(texts.mapInArrow(count, texts.schema), "document").drop("document")
    assert computed.value == 60
    out = {r["id"]: r["cluster"] for r in v.cluster_hits(features, 2, "features").collect()}
    assert len(out) == 60 and len(set(out.values())) == 2
    computed.value = 0
    vectors = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(60)], "id long, embedding array<float>")
    assert v.cluster_hits(vectors.mapInArrow(count, vectors.schema), 2).groupBy("cluster").count().count() == 2
    assert computed.value == 60


def test_index_build_update_delete(spark):
    docs = spark.createDataFrame([("1", "first text"), ("2", "second text")], "call_id string, transcript string")
    provider = hash_embedding(4)
    index = v.build_index(v.prepare_documents(docs, AS_OF, min_length=1), provider)
    more = spark.createDataFrame([("2", "changed text"), ("3", "third text")], "call_id string, transcript string")
    ready = v.prepare_documents(more, AS_OF, min_length=1)
    kept = {r["id"]: r["document"] for r in v.build_index(ready, provider, index, update_existing=False).collect()}
    assert kept == {"1": "first text", "2": "second text", "3": "third text"}
    new = {r["id"]: r["document"] for r in v.build_index(ready, provider, index).collect()}
    assert new == {"1": "first text", "2": "changed text", "3": "third text"}
    rebuilt = v.build_index(ready, provider, index.drop("indexed_at"))
    assert {r["id"] for r in rebuilt.collect()} == {"2", "3"}
    assert [r["id"] for r in v.delete_ids(index, more.select(F.col("call_id").alias("id"))).collect()] == ["1"]
    sample = v.embed_texts(spark.createDataFrame([("a", "first text")], "query_id string, t string"), "t", provider)
    assert v.verify_index(index, sample).first()["hits"] == 2
    assert v.verify_index(index.limit(0), sample).first()["hits"] == 0
    assert [r["id"] for r in v.get_by_ids(index, ["2"]).collect()] == ["2"]
