"""Call-table views over the given tables, each with the same definition in SQL.

``events`` stands for a month of calls, ``orders`` for years of calls, ``documents``
for transcripts. Parquet timestamps without a zone stay without one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import spread_scan

CAMPAIGNS = ["sales", "support", "billing", "retention", "survey"]
OUTCOMES = ["connected", "no_answer", "voicemail", "busy", "failed"]
EVENT_OUTCOME = {
    "purchase": "connected",
    "signup": "no_answer",
    "view": "voicemail",
    "click": "busy",
    "error": "failed",
}


# Tables whose rows cost much work each, so that one file must not mean one task.
HEAVY = {"documents", "pages", "conversations", "embeddings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_scan(scan) if name in HEAVY else scan


def _pick(number: Column, names: list[str]) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(number, F.lit(len(names))).cast("int"))


def _agent(number: Column) -> Column:
    return F.concat(F.lit("agent_"), F.lpad(F.pmod(number, F.lit(10)).cast("string"), 3, "0"))


def _direction(number: Column) -> Column:
    return F.when(F.pmod(number, F.lit(2)) == 0, "inbound").otherwise("outbound")


def event_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    outcome = F.lit(None).cast("string")
    for kind, name in EVENT_OUTCOME.items():
        outcome = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(outcome)
    return e.select(
        F.col("event_id").cast("string").alias("call_id"),
        F.col("ts").cast("timestamp_ntz").alias("timestamp"),
        F.col("value").alias("duration"),
        F.col("user_id").cast("string").alias("phone_number"),
        _agent(F.col("event_id")).alias("agent_id"),
        _pick(F.col("user_id"), CAMPAIGNS).alias("campaign"),
        outcome.alias("outcome"),
        _direction(F.col("event_id")).alias("call_type"),
        F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0).alias("revenue"),
        F.col("props").alias("notes"),
    )


def order_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    outcome = (
        F.when(F.col("o_orderstatus") == "F", "connected")
        .when(F.col("o_orderstatus") == "O", "no_answer")
        .when(F.col("o_orderstatus") == "P", "voicemail")
    )
    return o.select(
        F.col("o_orderkey").cast("string").alias("call_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("timestamp"),
        (F.pmod(F.col("o_orderkey"), F.lit(571)) + 30).cast("double").alias("duration"),
        F.col("o_custkey").cast("string").alias("phone_number"),
        _agent(F.col("o_orderkey")).alias("agent_id"),
        F.col("o_orderpriority").alias("campaign"),
        outcome.alias("outcome"),
        _direction(F.col("o_orderkey")).alias("call_type"),
        F.col("o_totalprice").alias("revenue"),
    )


def document_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return d.select(
        F.col("doc_id").cast("string").alias("call_id"),
        (start + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("timestamp"),
        (F.col("n_chars") / 15.0).alias("duration"),
        F.col("source").alias("agent_id"),
        F.col("lang").alias("campaign"),
        _pick(F.col("doc_id"), OUTCOMES).alias("outcome"),
        _direction(F.col("doc_id")).alias("call_type"),
        F.lit(0.0).alias("revenue"),
        F.col("text").alias("transcript"),
    )


EVENT_CALLS_SQL = """calls AS (
  SELECT CAST(event_id AS VARCHAR) AS call_id, ts AS "timestamp", value AS duration,
         CAST(user_id AS VARCHAR) AS phone_number,
         'agent_' || lpad(CAST(event_id % 10 AS VARCHAR), 3, '0') AS agent_id,
         (['sales','support','billing','retention','survey'])[CAST(user_id % 5 AS INT) + 1] AS campaign,
         CASE event_type WHEN 'purchase' THEN 'connected' WHEN 'signup' THEN 'no_answer'
              WHEN 'view' THEN 'voicemail' WHEN 'click' THEN 'busy' WHEN 'error' THEN 'failed' END AS outcome,
         CASE WHEN event_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS call_type,
         CASE WHEN event_type = 'purchase' THEN value ELSE 0.0 END AS revenue,
         props AS notes
  FROM events)"""

ORDER_CALLS_SQL = """calls AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS call_id, o_orderdate AS "timestamp",
         CAST(o_orderkey % 571 + 30 AS DOUBLE) AS duration,
         CAST(o_custkey AS VARCHAR) AS phone_number,
         'agent_' || lpad(CAST(o_orderkey % 10 AS VARCHAR), 3, '0') AS agent_id,
         o_orderpriority AS campaign,
         CASE o_orderstatus WHEN 'F' THEN 'connected' WHEN 'O' THEN 'no_answer'
              WHEN 'P' THEN 'voicemail' END AS outcome,
         CASE WHEN o_orderkey % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS call_type,
         o_totalprice AS revenue
  FROM orders)"""

DOCUMENT_CALLS_SQL = """calls AS (
  SELECT CAST(doc_id AS VARCHAR) AS call_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS "timestamp",
         n_chars / 15.0 AS duration, source AS agent_id, lang AS campaign,
         (['connected','no_answer','voicemail','busy','failed'])[CAST(doc_id % 5 AS INT) + 1] AS outcome,
         CASE WHEN doc_id % 2 = 0 THEN 'inbound' ELSE 'outbound' END AS call_type,
         0.0::DOUBLE AS revenue, text AS transcript
  FROM documents)"""

# Blank characters in the regex syntax of the SQL engine.
SQL_BLANK = (
    "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
)


def sql_words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SQL_BLANK}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SQL_BLANK}+|{SQL_BLANK}+$', '', 'g')"


def with_events(body: str) -> str:
    return f"WITH {EVENT_CALLS_SQL}\n{body}"


def with_orders(body: str) -> str:
    return f"WITH {ORDER_CALLS_SQL}\n{body}"


def with_documents(body: str) -> str:
    return f"WITH {DOCUMENT_CALLS_SQL}\n{body}"


def sql_round(expr: str, digits: int) -> str:
    scale = f"{float(10**digits)}"
    return f"floor(({expr}) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE"
