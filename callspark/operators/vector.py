"""Document preparation, vector and keyword search, re-ranking and the search index.

An index table has ``id, document, embedding`` and one column per metadata field. Hits
have ``query_id, id, score, rank``; there are at most queries * k of them, so they are
the broadcast side when documents are looked up.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime
from functools import reduce
from operator import and_
from typing import Any

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    StopWordsRemover,
)
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import fixed
from ..functions.postings import keyword_index, search
from ..functions.skew import join_per_key
from ..functions.text import collapse, last_position, let, share, strip, words
from ..functions.vectors import scored
from ..session import checkpointed
from .filters import in_list

METADATA = ["call_id", "agent_id", "campaign", "call_type", "outcome", "timestamp", "duration"]


def iso_text(ts: Column) -> Column:
    """ISO form, with a fraction only when there is one."""
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )


def prepare_documents(
    df: DataFrame,
    as_of: datetime,
    text_fields: tuple[str, ...] = ("transcript",),
    metadata_fields: list[str] | None = None,
    min_length: int = 50,
    max_length: int = 10_000,
) -> DataFrame:
    """(id, document, metadata) of the rows with a usable text and a call id.

    The length is tested before blanks are collapsed.
    """
    parts = []
    for field in text_fields:
        if field in df.columns:
            text = strip(F.col(field).cast("string"))
            shown = text if field == "transcript" else F.concat(F.lit(f"{field.upper()}: "), text)
            parts.append(F.when(~F.lower(text).isin("", "none", "nan", "null"), shown))
    body = strip(F.concat_ws("\n\n", *parts))
    fields = []
    for name in metadata_fields or METADATA:
        if name not in df.columns:
            continue
        kind = df.schema[name].dataType
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            value = iso_text(F.col(name))
        elif isinstance(kind, T.NumericType):
            value = F.col(name).cast("double")
        else:
            value = F.col(name).cast("string")
        fields.append(value.alias(name))
    fields.append(F.lit(as_of.isoformat()).alias("indexed_at"))
    return (
        df.withColumn("_body", body)
        .where(F.length("_body").between(min_length, max_length))
        .where(F.col("call_id").isNotNull() & (F.col("call_id").cast("string") != ""))
        .select(
            F.col("call_id").cast("string").alias("id"),
            collapse(F.col("_body")).alias("document"),
            F.struct(*fields).alias("metadata"),
        )
    )


def embed_texts(df: DataFrame, text: str, provider: Callable[[Column], Column]) -> DataFrame:
    """Adds ``embedding``; one Arrow pass, no shuffle."""
    return df.withColumn("embedding", provider(F.col(text)))


def embed_new(
    df: DataFrame,
    key: str,
    text: str,
    cache: DataFrame | None,
    provider_name: str,
    provider: Callable[[Column], Column],
) -> tuple[DataFrame, DataFrame]:
    """(rows with embedding, cache with the new texts). Only unseen texts are computed.

    Copies of a text are one cache row; a text with very many copies is spread out when
    the embeddings are joined back.
    """
    name = F.sha2(F.concat(F.lit(f"{provider_name}:"), F.col(text)), 256)
    keyed = df.withColumn("text_key", name)
    distinct = keyed.groupBy("text_key").agg(
        F.any_value(text).alias("_text"), F.count(F.lit(1)).alias("n_rows")
    )
    unseen = distinct if cache is None else distinct.join(cache, "text_key", "left_anti")
    fresh = unseen.select("text_key", provider(F.col("_text")).alias("embedding"))
    whole = fresh if cache is None else cache.select("text_key", "embedding").unionByName(fresh)
    counted = distinct.select("text_key", "n_rows").join(whole, "text_key")
    return join_per_key(keyed, counted, ["text_key"]).drop("text_key", "n_rows"), whole


def nearest(
    corpus: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", where: Column | None = None
) -> DataFrame:
    """The k nearest vectors per query; ``where`` is tested before any scoring."""
    return scored(corpus if where is None else corpus.where(where), queries, k, metric)


def with_documents(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Look up the document and metadata of the hits; the embedding stays behind."""
    return corpus.drop("embedding").join(hits, "id")


def _query_words(query: Column) -> Column:
    return words(F.lower(query))


def word_share(query: Column, document: Column) -> Column:
    """Share of the distinct query words that are words of the document."""
    q = F.array_distinct(_query_words(query))
    return let(
        q,
        lambda x: share(F.size(F.array_intersect(x, words(F.lower(document)))), F.size(x)),
    )


def substring_share(query_words: Column, document: Column) -> Column:
    """Share of the query words that occur in the document as a substring."""

    def inside(s: Column) -> Column:
        found = F.size(F.filter(s["q"], lambda w: F.contains(s["d"], w)))
        return share(found, F.size(s["q"]))

    return let(F.struct(query_words.alias("q"), F.lower(document).alias("d")), inside)


def keyword_search(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank): share of the query words found as substrings.

    A query word lies within one word of a document, so documents are searched by an inverted
    index of their words (see ``functions.postings``).
    """
    asked = queries.select("query_id", _query_words(F.col("query")).alias("words"))
    return search(keyword_index(corpus), asked, k)


def combine_hits(semantic: DataFrame, keyword: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """Full outer combination of two hit lists with weighted scores and their sources."""
    left = semantic.select("query_id", "id", F.col("score").alias("semantic_score"))
    right = keyword.select("query_id", "id", F.col("score").alias("keyword_score"))
    zero = F.lit(0.0)
    combined = F.coalesce("semantic_score", zero) * weight + F.coalesce("keyword_score", zero) * (1.0 - weight)
    sources = F.array_compact(
        F.array(
            F.when(F.col("semantic_score").isNotNull(), F.lit("semantic")),
            F.when(F.col("keyword_score").isNotNull(), F.lit("keyword")),
        )
    )
    joined = left.join(right, ["query_id", "id"], "full").select(
        "query_id", "id", F.round(combined, 12).alias("combined_score"), sources.alias("sources")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("combined_score"), "id")
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hybrid_search(corpus: DataFrame, queries: DataFrame, k: int = 10, weight: float = 0.7) -> DataFrame:
    """Semantic and keyword search, each with 2k candidates, combined and cut to k."""
    return combine_hits(
        nearest(corpus, queries, 2 * k), keyword_search(corpus, queries, 2 * k), k, weight
    )


def search_condition(filters: dict[str, Any] | None, columns: list[str]) -> Column | None:
    """Selections and ranges as one condition; a bound that is 0 or infinite is ignored."""
    parts = []
    filters = filters or {}
    for key, column in (
        ("selected_agents", "agent_id"),
        ("selected_campaigns", "campaign"),
        ("selected_outcomes", "outcome"),
        ("selected_types", "call_type"),
    ):
        if filters.get(key) and column in columns:
            parts.append(F.col(column).isin(list(filters[key])))
    for key, column in (("duration_range", "duration"), ("revenue_range", "revenue")):
        bounds = filters.get(key)
        if not bounds or len(bounds) != 2 or column not in columns:
            continue
        low, high = bounds
        if low and not math.isinf(low):
            parts.append(F.col(column) >= float(low))
        if high and not math.isinf(high):
            parts.append(F.col(column) <= float(high))
    return reduce(and_, parts) if parts else None


def _date_condition(filters: dict[str, Any] | None) -> Column | None:
    """Date bounds; an end at midnight means the end of that day."""
    bounds = (filters or {}).get("date_range")
    if not bounds or len(bounds) != 2:
        return None
    start, end = (datetime.fromisoformat(b) if isinstance(b, str) else b for b in bounds)
    if end is not None and end.time() == datetime.min.time():
        end = end.replace(hour=23, minute=59, second=59, microsecond=999999)
    parts = [
        test(F.col("timestamp"), F.lit(b.isoformat(sep=" ")).cast("timestamp_ntz"))
        for b, test in ((start, Column.__ge__), (end, Column.__le__))
        if b is not None
    ]
    return F.coalesce(reduce(and_, parts), F.lit(False)) if parts else None


def rerank_overlap(hits: DataFrame, k: int) -> DataFrame:
    """0.6 score + 0.3 word overlap + 0.1 / (1 + ln words), best k per query."""
    length = F.greatest(F.size(words(F.col("document"))), F.lit(1))
    score = (
        F.coalesce("score", F.lit(0.5)) * 0.6
        + word_share(F.col("query"), F.col("document")) * 0.3
        + 0.1 / (1 + F.ln(length))
    )
    out = hits.withColumn("rerank_score", F.round(score, 12))
    return _best_per_query(out, "rerank_score", k)


def _best_per_query(hits: DataFrame, score: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def relevance(score: Column) -> Column:
    return F.when(score > 0.8, "High").when(score > 0.6, "Medium").otherwise("Low")


def snippet(text: Column, length: int = 200, at_blank: bool = False) -> Column:
    """Start of the text up to the last period past the half; else a plain cut with dots
    or, with ``at_blank``, a cut at the last blank."""
    head = F.substring(text, 1, length)
    period, blank = last_position(head, "."), last_position(head, " ")
    dots = F.concat(head, F.lit("..."))
    if at_blank:
        cut = F.concat(F.substring(head, F.lit(1), blank - 1), F.lit("..."))
        dots = F.when(blank > 1, cut).otherwise(dots)
    # Positions count from 1 here, so "past the half" compares position - 1.
    return (
        F.when(F.length(text) <= length, text)
        .when(period - 1 > length * 0.5, F.substring(head, F.lit(1), period))
        .otherwise(dots)
    )


def formatted_metadata(columns: list[str]) -> Column:
    parts = []
    if "timestamp" in columns:
        parts.append(F.concat(F.lit("Time: "), iso_text(F.col("timestamp"))))
    if "agent_id" in columns:
        parts.append(F.concat(F.lit("Agent: "), F.col("agent_id")))
    if "duration" in columns:
        parts.append(F.concat(F.lit("Duration: "), fixed(F.col("duration"), 1), F.lit("s")))
    return F.concat_ws(" | ", *parts)


def semantic_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 10,
    filters: dict[str, Any] | None = None,
    threshold: float | None = None,
    rerank: bool = False,
    prefilter_dates: bool = False,
) -> DataFrame:
    """Filtered search. ``queries`` has query_id, query (text) and embedding.

    Selections and ranges come before the top k, the date range after it, as the
    default; ``prefilter_dates`` moves it to the front, which always fills k.
    """
    where, dates = search_condition(filters, corpus.columns), _date_condition(filters)
    if prefilter_dates and dates is not None:
        where, dates = dates if where is None else where & dates, None
    hits = nearest(corpus, queries, 3 * k if rerank else k, where=where)
    found = with_documents(hits, corpus)
    if rerank:
        texts = queries.select(F.col("query_id").cast("string"), "query")
        found = rerank_overlap(found.join(texts, "query_id"), k)
    if dates is not None:
        found = found.where(dates)
    found = found.withColumn(
        "above_threshold", F.lit(True) if threshold is None else F.col("score") >= threshold
    )
    return found.withColumns(
        {
            "snippet": snippet(F.col("document")),
            "formatted_metadata": formatted_metadata(corpus.columns),
            "relevance": relevance(F.col("score")),
        }
    )


def threshold_report(found: DataFrame) -> DataFrame:
    """Per query the hits above the threshold and, when none is, whether weaker ones exist."""
    return found.groupBy("query_id").agg(
        F.count_if(F.col("above_threshold")).alias("hits"),
        F.count(F.lit(1)).alias("hits_without_threshold"),
        ((F.count_if(F.col("above_threshold")) == 0) & (F.count(F.lit(1)) > 0)).alias("weaker_hits_exist"),
    )


# Metadata fields whose presence counts, and the weights of the blend.
FILLED = ["call_type", "outcome", "agent_id", "duration"]
BLEND = {"base": 0.5, "recency": 0.2, "metadata": 0.15, "overlap": 0.15}


def _filled(df: DataFrame) -> Column:
    tests = []
    for name in FILLED:
        if name in df.columns:
            empty = F.col(name) == 0 if isinstance(df.schema[name].dataType, T.NumericType) else F.col(name) == ""
            tests.append(F.when(F.col(name).isNotNull() & ~empty, 1).otherwise(0))
    return reduce(lambda a, b: a + b, tests, F.lit(0)) / len(FILLED)


def retrieve(
    corpus: DataFrame,
    queries: DataFrame,
    as_of: datetime,
    k: int = 10,
    where: Column | None = None,
    rerank: bool = True,
    candidates: int = 50,
    min_similarity: float = 0.5,
) -> DataFrame:
    """Hits above a similarity; where more than k remain, re-ranked by a blend of score,
    age, filled metadata and word overlap. ``score`` is the one that ranked."""
    hits = nearest(corpus, queries, candidates if rerank else k, where=where)
    kept = hits.where(F.col("score") >= min_similarity)
    texts = queries.select(F.col("query_id").cast("string"), "query")
    found = with_documents(kept, corpus).join(texts, "query_id")
    if rerank:
        now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
        age = F.floor(F.timestamp_diff("SECOND", F.col("timestamp"), now) / 86400)
        recency = F.coalesce(F.exp(-age / 30), F.lit(0.5))
        terms = F.array_distinct(_query_words(F.col("query")))
        blend = (
            F.col("score") * BLEND["base"]
            + recency * BLEND["recency"]
            + _filled(found) * BLEND["metadata"]
            + substring_share(terms, F.col("document")) * BLEND["overlap"]
        )
        many = F.count(F.lit(1)).over(Window.partitionBy("query_id")) > k
        found = found.withColumn("score", F.when(many, F.round(blend, 12)).otherwise(F.col("score")))
    best = _best_per_query(found, "score", k)
    return best.withColumn("snippet", snippet(F.col("document"), at_blank=True))


def retrieve_with_feedback(
    corpus: DataFrame,
    queries: DataFrame,
    as_of: datetime,
    positive: list[str] | None = None,
    negative: list[str] | None = None,
    k: int = 10,
    min_similarity: float = 0.5,
) -> DataFrame:
    """Scores of positive ids x 1.5, of negative ids x 0.5, sorted again and cut to k."""
    found = retrieve(corpus, queries, as_of, 2 * k, min_similarity=min_similarity)
    if not positive and not negative:
        return found
    score = F.col("score")
    if positive:
        score = score * F.when(F.col("id").isin(positive), 1.5).otherwise(1.0)
    if negative:
        score = score * F.when(F.col("id").isin(negative), 0.5).otherwise(1.0)
    return _best_per_query(found.withColumn("score", score), "score", k)


def neighbours(corpus: DataFrame, references: DataFrame, k: int = 5) -> DataFrame:
    """The k nearest other documents of stored documents (``references``: column id)."""
    wanted = corpus.join(references.select("id"), "id", "left_semi")
    stored = wanted.select(F.col("id").alias("query_id"), "embedding")
    hits = nearest(corpus, stored, k + 1).where(F.col("query_id") != F.col("id"))
    return _best_per_query(hits, "score", k)


def explain_relevance(hits: DataFrame) -> DataFrame:
    """Matched words (sorted), overlap ratio and matched word pairs of the query."""
    q = _query_words(F.col("query"))

    def pairs(w: Column) -> Column:
        nexts = F.slice(w, 2, F.greatest(F.size(w), F.lit(1)))
        both = F.zip_with(w, nexts, lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
        return F.array_compact(both)

    lower = F.lower("document")
    return hits.withColumns(
        {
            "matching_keywords": F.sort_array(
                F.array_intersect(F.array_distinct(q), words(lower))
            ),
            "keyword_overlap_ratio": word_share(F.col("query"), F.col("document")),
            "matching_phrases": let(
                F.struct(pairs(q).alias("p"), lower.alias("d")),
                lambda s: F.filter(s["p"], lambda x: F.contains(s["d"], x)),
            ),
        }
    )


def cluster_hits(hits: DataFrame, k: int = 3, features: str = "embedding") -> DataFrame:
    """Adds ``cluster``; with fewer rows than k there is one cluster.

    The passes of the clustering read the rows from the checkpoint folder, so what they come from
    is computed once. Callers should leave out columns that they do not need.
    """
    hits = checkpointed(hits)
    if hits.limit(k).count() < k:
        return hits.withColumn("cluster", F.lit(0))
    ready = hits if isinstance(hits.schema[features].dataType, T.UserDefinedType) else hits.withColumn(
        "_features", array_to_vector(F.col(features).cast("array<double>"))
    )
    column = "_features" if "_features" in ready.columns else features
    model = KMeans(k=k, seed=42, featuresCol=column, predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_features")


def text_features(df: DataFrame, text: str, terms: int = 100) -> DataFrame:
    """Adds ``features``: TF-IDF of the most frequent terms, length 1, without stop words.

    The inverse document frequency gets 1 added, as in the usual smoothed form. The texts are
    read three times, so they are written to the checkpoint folder once.
    """
    df = checkpointed(df)
    tokens = RegexTokenizer(inputCol=text, outputCol="_t", pattern="\\b\\w\\w+\\b", gaps=False)
    kept = StopWordsRemover(inputCol="_t", outputCol="_w")
    ready = kept.transform(tokens.transform(df))
    counts = CountVectorizer(inputCol="_w", outputCol="_c", vocabSize=terms).fit(ready).transform(ready)
    weights = IDF(inputCol="_c", outputCol="_f").fit(counts)
    plus_one = [float(x) + 1.0 for x in weights.idf.toArray()]
    scaled = ElementwiseProduct(
        inputCol="_c", outputCol="_s", scalingVec=Vectors.dense(plus_one)
    ).transform(counts)
    out = Normalizer(inputCol="_s", outputCol="features").transform(scaled)
    return out.drop("_t", "_w", "_c", "_s")


def build_index(
    documents: DataFrame,
    provider: Callable[[Column], Column],
    index: DataFrame | None = None,
    update_existing: bool = True,
) -> DataFrame:
    """The index after adding documents (id, document, metadata).

    One row per id: of documents with the same id the smallest is taken. Without
    ``update_existing`` only ids that are not in the index are embedded. When a
    metadata field is absent from the stored index, everything is built anew.
    """
    documents = documents.groupBy("id").agg(F.min(F.struct("document", "metadata")).alias("_one")).select("id", "_one.*")
    wanted = documents.select("id", "document", "metadata.*").columns
    if index is not None and set(wanted) - set(index.columns):
        index = None
    new = documents
    if index is not None and not update_existing:
        new = documents.join(index.select("id"), "id", "left_anti")
    rows = embed_texts(new.select("id", "document", "metadata.*"), "document", provider)
    if index is None:
        return rows
    old = index.join(new.select("id"), "id", "left_anti") if update_existing else index
    return old.unionByName(rows, allowMissingColumns=True)


def verify_index(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Hits per sample query: a query without a hit shows a broken index."""
    hits = nearest(index, queries, k)
    found = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    return (
        queries.select(F.col("query_id").cast("string"))
        .join(found, "query_id", "left")
        .select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"))
    )


def get_by_ids(index: DataFrame, ids: list[str]) -> DataFrame:
    return in_list(index, "id", ids) if ids else index.limit(0)


def update_metadata(index: DataFrame, changes: DataFrame) -> DataFrame:
    """Overwrite metadata of ids (one row per id); a null leaves the stored value."""
    names = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(n).alias(f"_{n}") for n in names])
    joined = index.join(new, "id", "left")
    for n in names:
        old = F.col(n) if n in index.columns else F.lit(None)
        joined = joined.withColumn(n, F.coalesce(F.col(f"_{n}"), old)).drop(f"_{n}")
    return joined


def delete_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def index_statistics(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("documents"),
        F.max(F.size("embedding")).alias("dimension"),
        F.min(F.length("document")).alias("shortest"),
        F.max(F.length("document")).alias("longest"),
    )


def index_export(index: DataFrame) -> DataFrame:
    """(id, metadata, snippet): the whole index with the first 100 characters."""
    meta = [c for c in index.columns if c not in ("id", "document", "embedding")]
    return index.select(
        "id", F.struct(*meta).alias("metadata"), F.substring("document", 1, 100).alias("snippet")
    )
