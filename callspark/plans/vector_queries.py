"""Registered search queries: V1 to V17, J4, J6 and J7.

The index is ``embeddings`` joined to ``documents``; the queries are all ``benchmark``
texts with the stored vector of the same number.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import hash_embedding, mean_cosine
from ..operators import vector as v
from .rounding import rounded
from .views import DOCUMENT_CALLS_SQL, SQL_BLANK, document_calls, sql_round, sql_strip, sql_words, table

AS_OF = datetime(2024, 2, 15, 12, 0)


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = document_calls(spark, sf_dir).withColumnRenamed("transcript", "document")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("call_id"), "embedding")
    return calls.join(vectors, "call_id").select(
        F.col("call_id").alias("id"), "document", "agent_id", "campaign", "call_type", "outcome", "timestamp",
        "duration", "embedding",
    )


def whole_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; those without a stored vector have none."""
    calls = document_calls(spark, sf_dir).withColumnRenamed("transcript", "document")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("call_id"), "embedding")
    return calls.join(vectors, "call_id", "left").select(
        F.col("call_id").alias("id"), "document", "agent_id", "campaign", "call_type", "outcome", "timestamp",
        "duration", "embedding",
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(
        F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), "embedding"
    )


BASE = f"""WITH {DOCUMENT_CALLS_SQL},
  idx AS (SELECT call_id AS id, transcript AS document, agent_id, campaign, call_type, outcome, "timestamp", duration,
    CAST(embedding AS DOUBLE[]) AS v FROM calls JOIN embeddings ON CAST(vec_id AS VARCHAR) = call_id),
  qs AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query, CAST(embedding AS DOUBLE[]) AS v
    FROM benchmark JOIN embeddings ON vec_id = item_id)"""

WHOLE = BASE.replace("FROM calls JOIN embeddings", "FROM calls LEFT JOIN embeddings")

ORDER = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)"


def _scores(where: str = "", metric: str = "cosine") -> str:
    expr = {
        "cosine": "list_cosine_similarity(q.v, i.v)",
        "dot": "list_dot_product(q.v, i.v)",
        "euclidean": "1 / (1 + list_distance(q.v, i.v))",
    }[metric]
    return f"""s AS (SELECT query_id, query, i.* EXCLUDE (v), round({expr}, 12) AS score FROM qs q, idx i {where}),
      r AS (SELECT *, {ORDER} AS rank FROM s)"""


def _words(text: str) -> str:
    return sql_words(f"lower({text})")


OVERLAP = (
    f"len(list_intersect(list_distinct({_words('query')}), list_distinct({_words('document')})))"
    f" / CAST(len(list_distinct({_words('query')})) AS DOUBLE)"
)


def _snippet(text: str, at_blank: bool = False) -> str:
    head = f"substring({text}, 1, 200)"
    last = lambda c: (
        f"(CASE WHEN strpos({head}, '{c}') > 0 THEN length({head}) - strpos(reverse({head}), '{c}') + 1 ELSE 0 END)"
    )
    dots = f"{head} || '...'"
    if at_blank:
        dots = f"CASE WHEN {last(' ')} > 1 THEN substring({head}, 1, {last(' ')} - 1) || '...' ELSE {dots} END"
    return (
        f"CASE WHEN length({text}) <= 200 THEN {text} WHEN {last('.')} - 1 > 100 "
        f"THEN substring({head}, 1, {last('.')}) ELSE {dots} END"
    )


FILTERS = {
    "selected_campaigns": ["en", "fr"],
    "selected_outcomes": ["connected", "busy", "failed"],
    "duration_range": (20.0, float("inf")),
    "revenue_range": (0.0, float("inf")),
    "date_range": ("2024-01-04", "2024-01-18"),
}
FILTER_SQL = "WHERE campaign IN ('en','fr') AND outcome IN ('connected','busy','failed') AND duration >= 20"
DATES_SQL = "\"timestamp\" BETWEEN TIMESTAMP '2024-01-04 00:00:00' AND TIMESTAMP '2024-01-18 23:59:59.999999'"
HEX = lambda c: f"sha256({c})"


def entries():
    q = {}

    def add(name, run, sql):
        q[name] = (lambda spark, sf, run=run: run(index(spark, sf), queries(spark, sf)), sql and f"{BASE}, {sql}")

    def whole(name, run, sql):
        q[name] = (lambda spark, sf, run=run: run(whole_index(spark, sf), queries(spark, sf)), sql and f"{WHOLE}, {sql}")

    def docs(name, run, sql):
        q[name] = (lambda spark, sf, run=run: run(document_calls(spark, sf)), sql and f"WITH {DOCUMENT_CALLS_SQL}{sql}")

    def prepared(c):
        return v.prepare_documents(
            c.withColumn("notes", F.when(F.col("call_type") == "inbound", F.lit(" None "))
                         .otherwise(F.concat(F.lit("call of "), F.col("agent_id")))),
            AS_OF, ("transcript", "notes"), [*v.METADATA], 60, 9_000,
        )

    body = f"{sql_strip('transcript')} || CASE WHEN call_type = 'inbound' THEN '' ELSE chr(10) || chr(10) || 'NOTES: call of ' || agent_id END"
    prep = f""", b AS (SELECT *, {sql_strip(f"CASE WHEN {sql_strip('transcript')} = '' AND call_type <> 'inbound' THEN 'NOTES: call of ' || agent_id ELSE {body} END")} AS body
        FROM calls), p AS (SELECT *, trim(regexp_replace(body, '{SQL_BLANK}+', ' ', 'g'), ' ') AS document FROM b
        WHERE length(body) BETWEEN 60 AND 9000)"""
    docs(
        "v1_prepare_documents",
        lambda c: prepared(c).select(
            "id", F.sha2("document", 256).alias("document"), F.col("metadata.timestamp").alias("started"),
            F.col("metadata.duration").alias("duration"), F.col("metadata.indexed_at").alias("indexed_at"),
        ),
        prep + f""" SELECT call_id AS id, {HEX('document')} AS document,
          strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS started, duration, '2024-02-15T12:00:00' AS indexed_at FROM p""",
    )
    docs(
        "v2_hash_embedding",
        lambda c: v.embed_texts(c, "transcript", hash_embedding(64)).select("call_id", "embedding"),
        None,
    )

    def reuse(c):
        provider = hash_embedding(16, 42)
        known = c.where(F.col("campaign") == "en")
        _, cache = v.embed_new(known, "call_id", "transcript", None, "hash", provider)
        rows, whole = v.embed_new(c, "call_id", "transcript", cache, "hash", provider)
        fresh = whole.join(cache.select("text_key"), "text_key", "left_anti")
        one = lambda d, name: d.agg(F.count(F.lit(1)).alias(name)).scalar().alias(name)
        first = rows.agg(F.count("embedding").alias("rows"))
        return first.select("rows", one(cache, "known_texts"), one(fresh, "computed_texts"))

    docs(
        "v3_embedding_reuse",
        reuse,
        """ SELECT count(*) AS rows, count(DISTINCT transcript) FILTER (WHERE campaign = 'en') AS known_texts,
          count(DISTINCT transcript) - count(DISTINCT transcript) FILTER (WHERE campaign = 'en') AS computed_texts FROM calls""",
    )
    whole(
        "v4_update_metadata",
        lambda i, qs: v.update_metadata(
            i, qs.select(F.col("query_id").alias("id"), F.lit("reviewed").alias("outcome"))
        ).select("id", "outcome", "campaign"),
        "x AS (SELECT 1) SELECT id, CASE WHEN query_id IS NOT NULL THEN 'reviewed' ELSE outcome END AS outcome, campaign "
        "FROM idx LEFT JOIN qs ON id = query_id",
    )
    whole(
        "v4_delete_ids",
        lambda i, qs: v.delete_ids(i, qs.select(F.col("query_id").alias("id"))).select("id"),
        "x AS (SELECT 1) SELECT id FROM idx WHERE id NOT IN (SELECT query_id FROM qs)",
    )
    whole(
        "v4_index_statistics",
        lambda i, qs: v.index_statistics(i),
        "x AS (SELECT 1) SELECT count(*) AS documents, CAST(max(len(v)) AS INT) AS dimension, "
        "CAST(min(length(document)) AS INT) AS shortest, CAST(max(length(document)) AS INT) AS longest FROM idx",
    )
    for metric in ("cosine", "dot", "euclidean"):
        add(
            f"v5_nearest_{metric}",
            lambda i, qs, metric=metric: rounded(v.nearest(i, qs, 10, metric), "score"),
            _scores(metric=metric)
            + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10",
        )
    add(
        "v5_nearest_where",
        lambda i, qs: rounded(v.nearest(i, qs, 5, where=F.col("campaign") == "de"), "score"),
        _scores("WHERE campaign = 'de'")
        + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5",
    )
    add(
        "j7_similarity_matrix",
        lambda i, qs: mean_cosine(i, qs).withColumn("mean_score", F.round("mean_score", 6)),
        _scores() + " SELECT query_id, count(*) AS pairs, round(avg(score), 6) AS mean_score FROM s GROUP BY 1",
    )
    found_cols = ["query_id", "id", "score", "relevance", "snippet", "formatted_metadata", "above_threshold"]
    meta = (
        "'Time: ' || strftime(\"timestamp\", '%Y-%m-%dT%H:%M:%S') || ' | Agent: ' || agent_id || ' | Duration: ' || "
        f"format('{{:.1f}}', {sql_round('duration', 1)}) || 's'"
    )
    rel = "CASE WHEN score > 0.8 THEN 'High' WHEN score > 0.6 THEN 'Medium' ELSE 'Low' END"
    shown = f"""query_id, id, round(score, 6) AS score, {rel} AS relevance, {_snippet('document')} AS snippet,
      {meta} AS formatted_metadata, score >= 0.2 AS above_threshold"""
    add(
        "v6_filtered_search",
        lambda i, qs: rounded(
            v.semantic_search(i, qs, 10, FILTERS, 0.2, rerank=False).select(*found_cols), "score"
        ),
        _scores(FILTER_SQL) + f" SELECT {shown} FROM r WHERE rank <= 10 AND {DATES_SQL}",
    )
    add(
        "v6_prefiltered_dates",
        lambda i, qs: rounded(
            v.semantic_search(i, qs, 10, FILTERS, 0.2, prefilter_dates=True).select(*found_cols), "score"
        ),
        _scores(FILTER_SQL + f" AND {DATES_SQL}") + f" SELECT {shown} FROM r WHERE rank <= 10",
    )
    add(
        "v6_threshold_report",
        lambda i, qs: v.threshold_report(v.semantic_search(i, qs, 10, FILTERS, 0.2)),
        _scores(FILTER_SQL) + f""", f AS (SELECT * FROM r WHERE rank <= 10 AND {DATES_SQL})
          SELECT query_id, count(*) FILTER (WHERE score >= 0.2) AS hits, count(*) AS hits_without_threshold,
            count(*) FILTER (WHERE score >= 0.2) = 0 AS weaker_hits_exist FROM f GROUP BY 1""",
    )
    rerank = f"""c AS (SELECT *, round(score * 0.6 + ({OVERLAP}) * 0.3
        + 0.1 / (1 + ln(greatest(len({_words('document')}), 1))), 12) AS rerank_score FROM r WHERE rank <= 30),
      d AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, id) AS rank FROM c)"""
    add(
        "v8_rerank_overlap",
        lambda i, qs: rounded(
            v.semantic_search(i, qs, 10, rerank=True).select("query_id", "id", "score", "rerank_score", "rank"),
            "score", "rerank_score",
        ),
        _scores() + f", {rerank} SELECT query_id, id, round(score, 6) AS score, "
        "round(rerank_score, 6) AS rerank_score, CAST(rank AS INT) AS rank FROM d WHERE rank <= 10",
    )
    keyword = f"""kq AS (SELECT query_id, {_words('query')} AS w FROM qs),
      kd AS (SELECT id, lower(document) AS t FROM idx),
      ks AS (SELECT query_id, id, len(list_filter(w, lambda x: contains(t, x))) / CAST(len(w) AS DOUBLE) AS score
        FROM kq, kd),
      kr AS (SELECT *, {ORDER} AS rank FROM ks WHERE score > 0)"""
    whole(
        "v7_keyword_search",
        lambda i, qs: rounded(v.keyword_search(i, qs, 20), "score"),
        keyword + " SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM kr WHERE rank <= 20",
    )
    hybrid = (
        _scores() + f""", {keyword}, h AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id,
          round(coalesce(a.score, 0) * 0.7::DOUBLE + coalesce(b.score, 0) * (1.0 - 0.7::DOUBLE), 12) AS score,
          concat_ws(',', CASE WHEN a.id IS NOT NULL THEN 'semantic' END, CASE WHEN b.id IS NOT NULL THEN 'keyword' END)
            AS sources
          FROM (SELECT * FROM r WHERE rank <= 20) a FULL JOIN (SELECT * FROM kr WHERE rank <= 20) b
            ON a.query_id = b.query_id AND a.id = b.id),
        hr AS (SELECT *, {ORDER} AS rank FROM h)"""
    )
    out = "query_id, id, round(score, 6) AS combined_score, sources, CAST(rank AS INT) AS rank"
    flat = lambda d: rounded(
        d.withColumn("sources", F.array_join("sources", ",")), "combined_score"
    )
    whole(
        "v7_hybrid_search",
        lambda i, qs: flat(v.hybrid_search(i, qs, 10)),
        hybrid + f" SELECT {out} FROM hr WHERE rank <= 10",
    )
    whole(
        "j6_combine_hits",
        lambda i, qs: flat(v.combine_hits(v.nearest(i, qs, 20), v.keyword_search(i, qs, 20), 40)),
        hybrid + f" SELECT {out} FROM hr WHERE rank <= 40",
    )
    populated = "((call_type <> '')::INT + (outcome <> '')::INT + (agent_id <> '')::INT + (duration <> 0)::INT) / 4.0::DOUBLE"
    terms = f"list_distinct({_words('query')})"
    blend = f"""round(score * 0.5 + exp(-(date_diff('second', "timestamp", TIMESTAMP '2024-02-15 12:00:00') // 86400) / 30.0::DOUBLE) * 0.2
        + {populated} * 0.15 + len(list_filter({terms}, lambda x: contains(lower(document), x)))
          / CAST(len({terms}) AS DOUBLE) * 0.15, 12)"""

    def retrieved(k):
        return _scores() + f""", c AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM r
            WHERE rank <= 50 AND score >= 0.15),
          d AS (SELECT * REPLACE (CASE WHEN n > {k} THEN {blend} ELSE score END AS score) FROM c),
          e AS (SELECT * EXCLUDE (rank), {ORDER} AS rank FROM d)"""

    add(
        "v9_retrieve",
        lambda i, qs: rounded(
            v.retrieve(i, qs, AS_OF, 10, min_similarity=0.15).select("query_id", "id", "score", "rank", "snippet"), "score"
        ),
        retrieved(10) + f" SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank, "
        f"{_snippet('document', True)} AS snippet FROM e WHERE rank <= 10",
    )
    add(
        "v9_retrieve_default",
        lambda i, qs: rounded(v.retrieve(i, qs, AS_OF, 10).select("query_id", "id", "score", "rank"), "score"),
        _scores() + """ SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r
          WHERE rank <= 10 AND score >= 0.5""",
    )
    good, bad = [str(x) for x in range(0, 500, 7)], [str(x) for x in range(3, 500, 11)]
    ids = lambda xs: ", ".join(f"'{x}'" for x in xs)
    add(
        "v10_feedback",
        lambda i, qs: rounded(
            v.retrieve_with_feedback(i, qs, AS_OF, good, bad, 5, 0.15).select("query_id", "id", "score", "rank"),
            "score",
        ),
        retrieved(10) + f""", f AS (SELECT * FROM e WHERE rank <= 10),
          g AS (SELECT query_id, id, score * CASE WHEN id IN ({ids(good)}) THEN 1.5 ELSE 1 END
            * CASE WHEN id IN ({ids(bad)}) THEN 0.5 ELSE 1 END AS score FROM f),
          h AS (SELECT *, {ORDER} AS rank FROM g)
          SELECT query_id, id, round(CAST(score AS DOUBLE), 6) AS score, CAST(rank AS INT) AS rank FROM h WHERE rank <= 5""",
    )
    add(
        "v11_neighbours",
        lambda i, qs: rounded(v.neighbours(i, qs.select(F.col("query_id").alias("id")), 5), "score"),
        _scores() + f""", n AS (SELECT query_id, id, score, {ORDER} AS rank FROM r WHERE rank <= 6 AND query_id <> id)
          SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5""",
    )
    docs(
        "v12_snippets",
        lambda c: c.select(
            "call_id", v.snippet(F.col("transcript")).alias("period"), v.snippet(F.col("transcript"), 200, True).alias("blank")
        ),
        f" SELECT call_id, {_snippet('transcript')} AS period, {_snippet('transcript', True)} AS blank FROM calls",
    )
    qw = _words("query")
    add(
        "v13_explain_relevance",
        lambda i, qs: rounded(
            v.explain_relevance(
                v.with_documents(v.nearest(i, qs, 5), i).join(qs.select("query_id", "query"), "query_id")
            ).select(
                "query_id", "id", F.array_join("matching_keywords", ",").alias("matching_keywords"),
                "keyword_overlap_ratio", F.array_join("matching_phrases", ",").alias("matching_phrases"),
            ),
            "keyword_overlap_ratio",
        ),
        _scores() + f""" SELECT query_id, id,
          array_to_string(list_sort(list_intersect(list_distinct({qw}), list_distinct({_words('document')}))), ',')
            AS matching_keywords, round({OVERLAP}, 6) AS keyword_overlap_ratio,
          array_to_string(list_filter(list_transform(range(1, len({qw})), lambda i: {qw}[i] || ' ' || {qw}[i + 1]),
            lambda p: contains(lower(document), p)), ',') AS matching_phrases FROM r WHERE rank <= 5""",
    )
    add(
        "v14_cluster_hits",
        lambda i, qs: v.cluster_hits(i.select("id", "embedding"), 10)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("members")),
        None,
    )
    whole(
        "v14_cluster_text_features",
        lambda i, qs: v.cluster_hits(v.text_features(i.select("id", "document"), "document").drop("document"), 5, "features")
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("members")),
        None,
    )

    plain = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))

    def entries_of(c, **changed):
        meta = F.struct(*[changed.get(n, F.col(n)).alias(n) for n in ("agent_id", "campaign", "outcome")])
        return c.select(F.col("call_id").alias("id"), F.col("transcript").alias("document"), meta.alias("metadata"))

    def upserted(c):
        """An index of all documents, then the English ones again, each twice, with another outcome."""
        again = entries_of(c.where("campaign = 'en'"), outcome=F.lit("again"))
        return v.build_index(again.unionByName(again), plain, v.build_index(entries_of(c), plain))

    docs(
        "v4_upsert",
        lambda c: upserted(c).select("id", "outcome", F.get("embedding", F.lit(0)).cast("double").alias("first")),
        " SELECT call_id AS id, CASE WHEN campaign = 'en' THEN 'again' ELSE outcome END AS outcome, "
        "CAST(length(transcript) AS DOUBLE) AS first FROM calls",
    )
    docs(
        "v4_get_by_ids",
        lambda c: v.get_by_ids(upserted(c), ["1", "2", "17", "none"]).select("id", "campaign"),
        " SELECT call_id AS id, campaign FROM calls WHERE call_id IN ('1', '2', '17')",
    )

    def rebuilt(c):
        """A stored index without one of the fields is built anew from all documents."""
        old = v.build_index(entries_of(c.where("campaign = 'en'")), plain).drop("agent_id")
        return v.build_index(entries_of(c), plain, old, update_existing=False)

    docs(
        "v15_rebuild_on_absent_field",
        lambda c: rebuilt(c).select("id", "agent_id", F.size("embedding").alias("dimension")),
        " SELECT call_id AS id, agent_id, 2 AS dimension FROM calls",
    )

    def incremental(c):
        provider = hash_embedding(64)
        ready = v.prepare_documents(c, AS_OF)
        first = v.build_index(v.prepare_documents(c.where(F.col("campaign") == "en"), AS_OF), provider)
        return v.build_index(ready, provider, first, update_existing=False)

    docs(
        "j4_index_missing_ids",
        lambda c: incremental(c).select("id", F.size("embedding").alias("dimension"), "campaign"),
        f""" SELECT call_id AS id, 64::INT AS dimension, campaign FROM calls
          WHERE length({sql_strip('transcript')}) BETWEEN 50 AND 10000""",
    )

    def verified(spark, sf):
        calls = document_calls(spark, sf)
        built = v.build_index(v.prepare_documents(calls, AS_OF), hash_embedding(64))
        samples = v.embed_texts(table(spark, sf, "benchmark"), "text", hash_embedding(64))
        return v.verify_index(built, samples.select(F.col("item_id").cast("string").alias("query_id"), "embedding"))

    q["v15_verify_index"] = (verified, None)
    whole(
        "v17_index_export",
        lambda i, qs: v.index_export(i).select("id", F.col("metadata.campaign").alias("campaign"), "snippet"),
        "x AS (SELECT 1) SELECT id, campaign, substring(document, 1, 100) AS snippet FROM idx",
    )
    return q
