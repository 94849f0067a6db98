"""Registered queries of the training-data operators, with their SQL where SQL can state them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from . import cap_filters, cotraining, dual_tree, fim, html_text, jaccard, mixing, packing, suffix_dedup, token_files, topk, toxicity, winnowing
from .batches import table, text_hash

VOCABULARY = "byte_bpe_50k.json"
WEIGHTS = [5, 2, 1]
WINDOW = 2048


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    whole = docs.select("doc_id", text_hash().alias("tag"), F.length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("sha256"))
    cut = suffix_dedup.removed_repeats(docs).select(
        F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256")
    )
    return whole.join(cut, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = ["lang", "source", "n_chars"]
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *meta)
    labels = table(spark, sf_dir, "labels").where(toxicity.training_half())
    scored = cotraining.score(docs, cotraining.fit(docs, labels, "quality", meta), meta)
    return scored.select(
        "doc_id",
        (~toxicity.training_half()).alias("held_out"),
        "text_score",
        "meta_score",
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_folder(spark, "token-files")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    token_files.write_token_files(docs, public_tokenizers.path(VOCABULARY), path, ["doc_id"], files, end_id=2)
    back = token_files.read_token_files(spark, path)
    return token_files.digests(back, ["doc_id"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"), WEIGHTS, most_repeats=3)
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return plan.select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("id") % 50 == 0), vectors, 5)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.cut_pieces(docs, public_tokenizers.path(VOCABULARY), end_id=1, capacity=WINDOW)
    return packing.pack(pieces, WINDOW).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.groups_of(docs, words=3, percent=90).select("doc_id", "n_shingles", "component_id", "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(toxicity.training_half())
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select(
        "doc_id",
        (~toxicity.training_half()).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents").select("doc_id", "text"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM d
), c AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
    greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(units[1:a], ''), '') AS pre,
    coalesce(array_to_string(units[a + 1:b], ''), '') AS mid, coalesce(array_to_string(units[b + 1:], ''), '') AS suf
  FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""



def codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Vector codes by plain rounds over all vectors and entries."""
    nearest = """
      SELECT rid, p, v, e, d FROM (
        SELECT v.rid, v.p, v.v, c.e, list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
          row_number() OVER (PARTITION BY v.rid, v.p ORDER BY d, c.e) AS place
        FROM v JOIN c{i} c USING (p)
      ) WHERE place = 1"""
    steps = []
    for i in range(rounds):
        steps.append(f"""a{i} AS MATERIALIZED ({nearest.format(i=i)}),
    m{i} AS MATERIALIZED (
      SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM (
        SELECT p, e, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
          SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS j FROM a{i}
        ) GROUP BY p, e, j
      ) GROUP BY p, e
    ),
    c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON c.p = m.p AND c.e = m.e)""")
    steps = ",\n    ".join(steps)
    return f"""
    WITH k AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS whole
      FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), v AS MATERIALIZED (
      SELECT rid, p, whole[p * len(whole) // {parts} + 1 : (p + 1) * len(whole) // {parts}] AS v
      FROM k, (SELECT unnest(range({parts})) AS p)
    ), c0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v AS c FROM v WHERE rid <= {entries}),
    {steps},
    z AS MATERIALIZED ({nearest.format(i=rounds)}),
    r AS (
      SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM z GROUP BY rid
    ), s AS (
      SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
      FROM (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS j FROM c{rounds})
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM k JOIN r USING (rid), s
    """


QUERIES = {
    "op1_suffix_dedup": (op1_suffix_dedup, None),
    "op2_quality": (op2_quality, None),
    "op3_cap_filters": (op3_cap_filters, None),
    "op4_token_files": (op4_token_files, None),
    "op5_mix": (op5_mix, None),
    "op6_top_k": (op6_top_k, TOP_K_SQL),
    "op7_pack": (op7_pack, None),
    "op8_jaccard_join": (op8_jaccard_join, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_main_text": (op10_main_text, None),
    "op11_fim": (op11_fim, FIM_SQL),
    "op12_dual_tree": (op12_dual_tree, codes_sql(8, 16, 6, 4096)),
    "op13_winnowing": (op13_winnowing, None),
}
