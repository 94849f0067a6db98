"""Registered filter queries: F1 to F15."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import filters as f
from .rounding import rounded
from .views import event_calls, with_events

COLS = "call_id, \"timestamp\", duration, agent_id, campaign, outcome, call_type, revenue"
NAMES = ["call_id", "timestamp", "duration", "agent_id", "campaign", "outcome", "call_type", "revenue"]
AS_OF = date(2024, 1, 30)

SPEC = f.FilterSpec(
    date_range=(date(2024, 1, 8), date(2024, 1, 21)),
    selected_agents=["agent_001", "agent_004", "agent_007"],
    selected_campaigns=["sales", "billing", "survey"],
    selected_outcomes=["connected", "busy"],
    duration_range=(5.0, 250.0),
    search_query='"k": [1-5]',
)

CONFIG = {
    "date_range": (datetime(2024, 1, 5), datetime(2024, 1, 25)),
    "call_types": ["inbound"],
    "outcomes": ["connected", "failed", "voicemail"],
    "agents": [],
    "campaigns": ["sales", "support"],
    "duration_range": (None, 300.0),
    "amount_range": (0.0, 200.0),
    "search_query": "K\": 4",
}


def entries():
    q = {}

    def add(name, run, sql):
        q[name] = (lambda spark, sf, run=run: run(event_calls(spark, sf)), with_events(sql))

    pick = lambda df: df.select(*NAMES)
    start, end = datetime(2024, 1, 10, 6), datetime(2024, 1, 20, 18, 30)
    add(
        "f1_date_range",
        lambda c: pick(f.date_range(c, start, end)),
        f"SELECT {COLS} FROM calls WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-10 06:00:00' "
        "AND TIMESTAMP '2024-01-20 18:30:00'",
    )
    add(
        "f2_day_range",
        lambda c: pick(f.day_range(c, date(2024, 1, 10), date(2024, 1, 20))),
        f"SELECT {COLS} FROM calls WHERE \"timestamp\" >= DATE '2024-01-10' "
        "AND \"timestamp\" < DATE '2024-01-21'",
    )
    add(
        "f3_in_lists",
        lambda c: pick(
            f.in_list(
                f.in_list(f.in_list(c, "outcome", ["connected", "busy"]), "agent_id", []),
                "campaign",
                ["sales", "survey"],
            )
        ),
        f"SELECT {COLS} FROM calls WHERE outcome IN ('connected','busy') AND campaign IN ('sales','survey')",
    )
    add(
        "f3_long_list",
        lambda c: pick(f.in_list(c, "phone_number", [str(i * 3) for i in range(2000)])),
        f"SELECT {COLS} FROM calls WHERE phone_number IN "
        "(SELECT CAST(i * 3 AS VARCHAR) FROM range(2000) r(i))",
    )
    add(
        "f4_value_ranges",
        lambda c: pick(
            f.value_range(
                f.value_range(c, ["duration_seconds", "duration"], 10.0, 120.0),
                ["amount", "revenue"],
                1.0,
            )
        ),
        f"SELECT {COLS} FROM calls WHERE duration BETWEEN 10 AND 120 AND revenue >= 1",
    )
    add(
        "f5_text_contains",
        lambda c: pick(f.text_contains(c, "K\": 6")),
        f"SELECT {COLS} FROM calls WHERE contains(lower(notes), 'k\": 6') OR contains(lower(call_id), 'k\": 6')"
        " OR contains(lower(agent_id), 'k\": 6') OR contains(lower(campaign), 'k\": 6')",
    )
    add(
        "f6_text_matches",
        lambda c: pick(f.text_matches(c, "\"K\": [6-9]\\d")),
        f"SELECT {COLS} FROM calls WHERE regexp_matches(notes, '\"k\": [6-9][0-9]')",
    )
    spec_sql = (
        "\"timestamp\" >= DATE '2024-01-08' AND \"timestamp\" < DATE '2024-01-22' "
        "AND agent_id IN ('agent_001','agent_004','agent_007') "
        "AND campaign IN ('sales','billing','survey') AND outcome IN ('connected','busy') "
        "AND duration BETWEEN 5 AND 250 AND revenue >= 0 AND regexp_matches(notes, '\"k\": [1-5]')"
    )
    add(
        "f7_filter_spec",
        lambda c: pick(f.FilterSpec.from_dict(SPEC.to_dict()).apply(c)),
        f"SELECT {COLS} FROM calls WHERE {spec_sql}",
    )
    add(
        "f7_date_presets",
        lambda c: f.preset_counts(c, AS_OF),
        """, p(preset, a, b) AS (VALUES
          ('Today', DATE '2024-01-30', DATE '2024-01-30'),
          ('Yesterday', DATE '2024-01-29', DATE '2024-01-29'),
          ('Last 7 Days', DATE '2024-01-24', DATE '2024-01-30'),
          ('Last 30 Days', DATE '2024-01-01', DATE '2024-01-30'),
          ('Last 90 Days', DATE '2023-11-02', DATE '2024-01-30'),
          ('This Month', DATE '2024-01-01', DATE '2024-01-30'),
          ('Last Month', DATE '2023-12-01', DATE '2023-12-31'),
          ('This Year', DATE '2024-01-01', DATE '2024-01-30'))
        SELECT preset, count(*) AS calls FROM p JOIN calls
          ON CAST("timestamp" AS DATE) BETWEEN a AND b GROUP BY preset""",
    )
    add(
        "f8_complex_filter",
        lambda c: pick(f.complex_filter(c, CONFIG)),
        f"SELECT {COLS} FROM calls WHERE \"timestamp\" BETWEEN TIMESTAMP '2024-01-05 00:00:00' "
        "AND TIMESTAMP '2024-01-25 00:00:00' AND call_type = 'inbound' "
        "AND outcome IN ('connected','failed','voicemail') AND campaign IN ('sales','support') "
        "AND duration <= 300 AND revenue BETWEEN 0 AND 200 AND contains(lower(notes), 'k\": 4')",
    )
    add(
        "f9_filter_report",
        lambda c: rounded(f.filter_report(c, SPEC.condition(c)), "reduction_percentage"),
        f"""SELECT count(*) AS original_count, count(*) FILTER (WHERE {spec_sql}) AS filtered_count,
          round((count(*) - count(*) FILTER (WHERE {spec_sql})) * 100.0::DOUBLE / count(*), 6)
            AS reduction_percentage FROM calls""",
    )
    add(
        "f10_quick_predicates",
        lambda c: c.agg(*[F.count_if(f.quick_predicate(n, AS_OF)).alias(n) for n in f.QUICK]),
        """SELECT count(*) FILTER (WHERE outcome = 'connected') AS connected,
          count(*) FILTER (WHERE outcome IN ('failed','no_answer')) AS failed,
          count(*) FILTER (WHERE duration > 300) AS long,
          count(*) FILTER (WHERE revenue > 0) AS revenue,
          count(*) FILTER (WHERE CAST("timestamp" AS DATE) = DATE '2024-01-30') AS today FROM calls""",
    )
    add(
        "f13_segments",
        lambda c: f.segments(c, datetime(2024, 1, 31)).select("segment", *NAMES),
        f"""SELECT 'high_value' AS segment, {COLS} FROM calls
              WHERE revenue > (SELECT quantile_cont(revenue, 0.75) FROM calls)
            UNION ALL SELECT 'frequent_callers', {COLS} FROM calls WHERE phone_number IN
              (SELECT phone_number FROM calls GROUP BY phone_number HAVING count(*) > 3)
            UNION ALL SELECT 'long_calls', {COLS} FROM calls
              WHERE duration > (SELECT quantile_cont(duration, 0.75) FROM calls)
            UNION ALL SELECT 'failed_calls', {COLS} FROM calls
              WHERE outcome IN ('failed','no_answer','busy')
            UNION ALL SELECT 'recent_calls', {COLS} FROM calls
              WHERE "timestamp" > TIMESTAMP '2024-01-24 00:00:00'""",
    )
    phone = lambda: F.concat(F.lit("(555) 01"), F.lpad("phone_number", 5, "0"))
    add(
        "f14_phone_split",
        lambda c: f.phone_split(
            c.withColumn(
                "phone_number",
                F.when(F.col("call_type") == "inbound", F.concat(phone(), F.lit("-")))
                .otherwise(F.col("phone_number")),
            )
        )
        .groupBy("phone_valid")
        .agg(F.count(F.lit(1)).alias("calls")),
        """SELECT regexp_matches(regexp_replace(CASE WHEN call_type = 'inbound'
            THEN '(555) 01' || lpad(phone_number, 5, '0') || '-' ELSE phone_number END,
            '[ .()-]', '', 'g'), '^1?[0-9]{10}$') AS phone_valid, count(*) AS calls
           FROM calls GROUP BY 1""",
    )
    add(
        "f15_distinct_values",
        lambda c: f.distinct_values(c, "campaign"),
        "SELECT DISTINCT campaign FROM calls WHERE campaign IS NOT NULL",
    )
    return q
