"""Registered KPI queries: A1 to A29."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from ..operators import filters as f
from ..operators import metrics as m
from .rounding import rounded
from .views import document_calls, event_calls, order_calls, with_documents, with_events, with_orders

RATE = "count(*) FILTER (WHERE outcome = 'connected') * 100.0::DOUBLE / count(*)"
FIRST, LAST = date(2024, 1, 15), date(2024, 1, 24)
CUR = "(\"timestamp\" >= DATE '2024-01-15' AND \"timestamp\" < DATE '2024-01-25')"
PREV = "(\"timestamp\" >= DATE '2024-01-05' AND \"timestamp\" < DATE '2024-01-15')"

BASIC = f"""count(*) AS total_calls,
  count(*) FILTER (WHERE lower(outcome) = 'connected') AS connected_calls,
  count(*) FILTER (WHERE lower(outcome) = 'connected') * 100.0::DOUBLE / count(*) AS connection_rate,
  avg(duration) AS avg_duration, coalesce(sum(duration), 0) AS total_duration,
  quantile_cont(duration, 0.5) AS median_duration,
  coalesce(sum(revenue), 0) AS total_revenue, avg(revenue) AS avg_revenue,
  CASE WHEN sum(duration) > 0 THEN sum(revenue) / (sum(duration) / 60) ELSE 0 END AS revenue_per_minute"""

NUMBERS = ["connection_rate", "avg_duration", "median_duration", "avg_revenue", "revenue_per_minute"]
SUMS = ["total_duration", "total_revenue"]


def _rounds(names, digits=6):
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _long_sql(section: str, names: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{section}' AS section, '{n}' AS metric, CAST({n} AS DOUBLE) AS value, "
        "CAST(NULL AS VARCHAR) AS text_value FROM k"
        for n in names
    )


def entries():
    q = {}

    def add(name, run, sql, view=event_calls, wrap=with_events):
        q[name] = (lambda spark, sf, run=run: run(view(spark, sf)), wrap(sql))

    add(
        "a1_basic_kpis",
        lambda c: rounded(rounded(m.basic_kpis(c), *NUMBERS), *SUMS, digits=2),
        f", k AS (SELECT {BASIC} FROM calls) SELECT total_calls, connected_calls, "
        f"{_rounds(NUMBERS)}, {_rounds(SUMS, 2)} FROM k",
    )
    percents = [25, 50, 75, 90, 95]
    pcts = ", ".join(f"quantile_cont(duration, {p / 100}) AS p{p}" for p in percents)
    all_sql = f""", k AS (SELECT {BASIC}, {pcts},
        floor(epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) AS us,
        CAST((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 86400000000 + 1 AS DOUBLE) AS active_days,
        count(*) / CAST((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 86400000000 + 1 AS DOUBLE)
          AS calls_per_day,
        strftime(min("timestamp"), '%Y-%m-%d') AS first_call, strftime(max("timestamp"), '%Y-%m-%d') AS last_call,
        count(DISTINCT agent_id) AS unique_agents, count(DISTINCT campaign) AS active_campaigns FROM calls),
      o AS (SELECT outcome, count(*) AS n FROM calls WHERE outcome IS NOT NULL GROUP BY outcome),
      r AS ({_long_sql('overview', ['total_calls', 'connected_calls', 'connection_rate'])}
       UNION ALL {_long_sql('duration_metrics', ['avg_duration', 'median_duration', 'total_duration']
                            + [f'p{p}' for p in percents])}
       UNION ALL {_long_sql('revenue_metrics', ['total_revenue', 'avg_revenue', 'revenue_per_minute'])}
       UNION ALL {_long_sql('time_metrics', ['active_days', 'calls_per_day'])}
       UNION ALL {_long_sql('entity_metrics', ['unique_agents', 'active_campaigns'])}
       UNION ALL SELECT 'time_metrics', 'first_call', NULL, first_call FROM k
       UNION ALL SELECT 'time_metrics', 'last_call', NULL, last_call FROM k
       UNION ALL SELECT 'outcome_distribution', outcome || '_calls', n, NULL FROM o
       UNION ALL SELECT 'outcome_distribution_percentage', outcome || '_pct',
         n * 100.0::DOUBLE / (SELECT sum(n) FROM o), NULL FROM o)
      SELECT section, metric, round(value, 4) AS value, text_value FROM r"""
    add("a2_all_kpis", lambda c: rounded(m.all_kpis(c), "value", digits=4), all_sql)
    add(
        "a3_percentiles",
        lambda c: rounded(m.percentiles(c, "duration", [5, 25, 50, 75, 90, 95, 99]), "value"),
        " UNION ALL ".join(
            f"SELECT 'p{p}' AS percentile, round(quantile_cont(duration, {p / 100}), 6) AS value FROM calls"
            for p in [5, 25, 50, 75, 90, 95, 99]
        ),
    )
    add(
        "a4_time_span",
        lambda c: rounded(m.time_span(c), "active_days", "calls_per_day"),
        """, k AS (SELECT count(*) AS n, min("timestamp") AS a, max("timestamp") AS b,
            CAST((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) // 86400000000 + 1 AS DOUBLE) AS d FROM calls)
          SELECT d AS active_days, round(n / d, 6) AS calls_per_day, strftime(a, '%Y-%m-%d') AS first_call,
            strftime(b, '%Y-%m-%d') AS last_call FROM k""",
    )
    add(
        "a5_entity_counts",
        m.entity_counts,
        "SELECT count(DISTINCT agent_id) AS unique_agents, count(DISTINCT campaign) AS active_campaigns FROM calls",
    )
    add(
        "a6_agent_table",
        lambda c: rounded(
            rounded(m.agent_table(c), "duration_mean", "revenue_mean", "connection_rate"),
            "duration_sum", "revenue_sum", digits=2,
        ),
        f"""SELECT agent_id, count(call_id) AS total_calls, round(avg(duration), 6) AS duration_mean,
          round(sum(duration), 2) AS duration_sum, round(sum(revenue), 2) AS revenue_sum,
          round(avg(revenue), 6) AS revenue_mean, round({RATE}, 6) AS connection_rate
          FROM calls WHERE agent_id IS NOT NULL GROUP BY agent_id""",
    )
    add(
        "a7_campaign_table",
        lambda c: rounded(
            rounded(m.campaign_table(c), "connection_rate", "avg_duration", "revenue_mean"),
            "revenue_sum", digits=2,
        ),
        f"""SELECT campaign, count(call_id) AS total_calls, round({RATE}, 6) AS connection_rate,
          round(avg(duration), 6) AS avg_duration, round(sum(revenue), 2) AS revenue_sum,
          round(avg(revenue), 6) AS revenue_mean FROM calls WHERE campaign IS NOT NULL GROUP BY campaign""",
    )
    add(
        "a8_outcome_distribution",
        lambda c: rounded(m.outcome_distribution(c), "percentage"),
        """SELECT outcome, count(*) AS calls, round(count(*) * 100.0::DOUBLE /
          (SELECT count(outcome) FROM calls), 6) AS percentage
          FROM calls WHERE outcome IS NOT NULL GROUP BY outcome""",
    )
    period = f"""count(call_id) AS calls, round({RATE}, 6) AS connection_rate,
          round(avg(duration), 6) AS avg_duration, round(sum(revenue), 2) AS total_revenue"""
    period_round = lambda d: rounded(
        rounded(d, "connection_rate", "avg_duration"), "total_revenue", digits=2
    )
    add(
        "a9_hourly_table",
        lambda c: period_round(m.hourly_table(c)),
        f'SELECT CAST(hour("timestamp") AS INT) AS hour, {period} FROM calls GROUP BY 1',
    )
    for name, unit in m.PERIODS.items():
        add(
            f"a10_trends_{name}",
            lambda c, name=name: period_round(m.trends(c, name)),
            f"SELECT strftime(date_trunc('{unit}', \"timestamp\"), '%Y-%m-%d') AS period, {period} "
            "FROM calls GROUP BY 1",
            order_calls,
            with_orders,
        )
    stages = ["no_answer", "connected", "missing", "busy"]
    steps = ["(SELECT count(*) FROM calls)"] + [
        f"(SELECT count(*) FROM calls WHERE outcome = '{s}')" for s in stages
    ]
    add(
        "a11_funnel",
        lambda c: rounded(m.funnel(c, stages), "percentage", "conversion_rate"),
        " UNION ALL ".join(
            f"SELECT {i + 1} AS stage_no, '{s}' AS stage, {steps[i + 1]} AS count, "
            f"round(coalesce({steps[i + 1]} * 100.0::DOUBLE / nullif({steps[i]}, 0), 0), 6) AS percentage, "
            f"round(coalesce({steps[i + 1]} * 100.0::DOUBLE / nullif({steps[i]}, 0), 0), 6) AS conversion_rate"
            for i, s in enumerate(stages)
        ),
    )
    names = ["total_calls", "connected_calls", "connection_rate", "avg_duration", "total_duration",
             "median_duration", "total_revenue", "avg_revenue", "revenue_per_minute"]
    melt = lambda t: " UNION ALL ".join(
        f"SELECT '{n}' AS metric, CAST({n} AS DOUBLE) AS v FROM {t}" for n in names
    )
    compare_sql = f""", c1 AS (SELECT {BASIC} FROM calls WHERE {CUR}), p1 AS (SELECT {BASIC} FROM calls WHERE {PREV}),
          a AS ({melt('c1')}), b AS ({melt('p1')})
          SELECT a.metric, round(a.v, 4) AS current, round(b.v, 4) AS previous, round(a.v - b.v, 4) AS change,
            round((a.v - b.v) / b.v * 100, 4) AS change_percentage
          FROM a JOIN b USING (metric) WHERE b.v <> 0"""
    add(
        "a12_compare_kpis",
        lambda c: rounded(
            m.compare_kpis(
                f.day_range(c, FIRST, LAST), f.day_range(c, *m.previous_period(FIRST, LAST))
            ),
            "current", "previous", "change", "change_percentage", digits=4,
        ),
        compare_sql,
    )
    add(
        "a12_compare_periods",
        lambda c: rounded(m.compare_periods(c, FIRST, LAST), "current", "previous", "change", "change_percentage", digits=4),
        compare_sql,
    )

    def block(cols_cur, cols_prev, names_):
        return " UNION ALL ".join(
            f"SELECT '{n}' AS metric, round(CAST({c} AS DOUBLE), 4) AS value, "
            f"round(CAST({c} AS DOUBLE) - CAST({p} AS DOUBLE), 4) AS delta FROM k"
            for n, c, p in zip(names_, cols_cur, cols_prev)
        )

    add(
        "a15_call_block",
        lambda c: rounded(m.call_block(c, FIRST, LAST), "value", "delta", digits=4),
        f""", k AS (SELECT count(*) FILTER (WHERE {CUR}) AS n1, count(*) FILTER (WHERE {PREV}) AS n0,
            count(*) FILTER (WHERE {CUR} AND outcome = 'connected') AS c1,
            count(*) FILTER (WHERE {PREV} AND outcome = 'connected') AS c0,
            avg(duration) FILTER (WHERE {CUR}) / 60 AS d1, avg(duration) FILTER (WHERE {PREV}) / 60 AS d0 FROM calls)
          """ + block(["n1", "c1", "c1 * 100.0::DOUBLE / n1", "d1"], ["n0", "c0", "c0 * 100.0::DOUBLE / n0", "d0"],
                      ["total_calls", "connected_calls", "connection_rate", "avg_duration_minutes"]),
    )
    add(
        "a16_revenue_block",
        lambda c: rounded(m.revenue_block(c, FIRST, LAST), "value", "delta", digits=4),
        f""", k AS (SELECT count(*) FILTER (WHERE {CUR}) AS n1, count(*) FILTER (WHERE {PREV}) AS n0,
            sum(revenue) FILTER (WHERE {CUR}) AS r1, sum(revenue) FILTER (WHERE {PREV}) AS r0,
            count(*) FILTER (WHERE {CUR} AND revenue > 0) AS c1,
            count(*) FILTER (WHERE {PREV} AND revenue > 0) AS c0 FROM calls)
          """ + block(["r1", "c1", "r1 / n1", "c1 * 100.0::DOUBLE / n1"],
                      ["r0", "c0", "r0 / n0", "c0 * 100.0::DOUBLE / n0"],
                      ["total_revenue", "revenue_calls", "avg_revenue_per_call", "conversion_rate"]),
    )
    add(
        "a14_period_tags",
        lambda c: m._both_periods(c, FIRST, LAST)
        .groupBy(F.when(F.col("is_current"), "current").otherwise("previous").alias("period"))
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.date_format(F.min("timestamp"), "yyyy-MM-dd").alias("first_day"),
            F.date_format(F.max("timestamp"), "yyyy-MM-dd").alias("last_day"),
        ),
        f"""SELECT CASE WHEN {CUR} THEN 'current' ELSE 'previous' END AS period, count(*) AS calls,
          strftime(min("timestamp"), '%Y-%m-%d') AS first_day, strftime(max("timestamp"), '%Y-%m-%d') AS last_day
          FROM calls WHERE {CUR} OR {PREV} GROUP BY 1""",
    )
    stat = ["mean", "std", "p25", "p50", "p75", "p95", "range", "cv"]
    add(
        "a17_column_summary",
        lambda c: rounded(rounded(m.column_summary(c, "duration"), *stat), "sum", digits=2),
        """SELECT count(*) AS count, round(avg(duration), 6) AS mean, round(stddev_samp(duration), 6) AS std,
          min(duration) AS min, max(duration) AS max, round(sum(duration), 2) AS sum,
          round(quantile_cont(duration, 0.25), 6) AS p25, round(quantile_cont(duration, 0.5), 6) AS p50,
          round(quantile_cont(duration, 0.75), 6) AS p75, round(quantile_cont(duration, 0.95), 6) AS p95,
          round(max(duration) - min(duration), 6) AS range,
          round(stddev_samp(duration) / avg(duration) * 100, 6) AS cv FROM calls""",
    )
    status = lambda: F.when(F.col("outcome") == "connected", "Connected").otherwise("Disconnected")
    add(
        "a18_dataset_statistics",
        lambda c: rounded(
            m.dataset_statistics(c.withColumn("connection_status", status())), "value"
        ),
        """, s AS (SELECT *, CASE WHEN outcome = 'connected' THEN 'Connected' ELSE 'Disconnected' END
            AS connection_status FROM calls),
          k AS (SELECT count(*) AS total_calls,
            count(*) FILTER (WHERE connection_status = 'Connected') * 100.0::DOUBLE / count(*) AS connected_percentage,
            avg(duration) AS mean, quantile_cont(duration, 0.5) AS median, min(duration) AS min, max(duration) AS max,
            count(DISTINCT agent_id) AS unique_agents, count(DISTINCT campaign) AS unique_campaigns FROM s),
          r AS (SELECT 'total' AS section, 'total_calls' AS metric, CAST(total_calls AS DOUBLE) AS value FROM k
            UNION ALL SELECT 'total', 'connected_percentage', connected_percentage FROM k
            UNION ALL SELECT 'total', 'unique_agents', unique_agents FROM k
            UNION ALL SELECT 'total', 'unique_campaigns', unique_campaigns FROM k
            UNION ALL SELECT 'duration', 'mean', mean FROM k UNION ALL SELECT 'duration', 'median', median FROM k
            UNION ALL SELECT 'duration', 'min', min FROM k UNION ALL SELECT 'duration', 'max', max FROM k
            UNION ALL SELECT 'connection_status', connection_status, count(*) FROM s GROUP BY 2
            UNION ALL SELECT 'call_type', call_type, count(*) FROM s GROUP BY 2
            UNION ALL SELECT 'outcome', outcome, count(*) FROM s GROUP BY 2)
          SELECT section, metric, round(value, 6) AS value FROM r""",
    )
    sql_fn = {"sum": "sum", "mean": "avg", "median": "median", "count": "count", "min": "min", "max": "max"}
    for fn, expr in sql_fn.items():
        add(
            f"a19_ad_hoc_{fn}",
            lambda c, fn=fn: rounded(m.ad_hoc(c, "campaign", "duration", fn), "value", digits=4),
            f"SELECT campaign, round(CAST({expr}(duration) AS DOUBLE), 4) AS value FROM calls "
            "WHERE campaign IS NOT NULL GROUP BY campaign",
        )
    for metric, expr in {"calls": "count(*)", "duration": "sum(duration) / 3600", "revenue": "sum(revenue)"}.items():
        add(
            f"a20_top_agents_{metric}",
            lambda c, metric=metric: rounded(m.top_agents(c, metric, 5), "value", digits=4),
            f"""SELECT agent_id, round(CAST(v AS DOUBLE), 4) AS value FROM
              (SELECT agent_id, {expr} AS v FROM calls WHERE agent_id IS NOT NULL GROUP BY agent_id)
              ORDER BY v DESC, agent_id LIMIT 5""",
        )
    add(
        "a21_campaign_compare",
        lambda c: rounded(
            rounded(m.campaign_compare(c), "connection_rate", "avg_minutes"), "revenue", digits=2
        ),
        f"""SELECT campaign, count(*) AS calls, round({RATE}, 6) AS connection_rate,
          round(avg(duration) / 60, 6) AS avg_minutes, round(sum(revenue), 2) AS revenue
          FROM calls WHERE campaign IS NOT NULL GROUP BY campaign""",
    )
    add(
        "a22_ranked_agents",
        lambda c: rounded(
            rounded(m.ranked_agents(c), "connection_rate", "avg_duration", "avg_revenue", "mean_calls_per_agent"),
            "total_revenue", digits=2,
        ),
        f""", g AS (SELECT agent_id, count(*) AS total_calls, round({RATE}, 6) AS connection_rate,
            round(avg(duration) / 60, 6) AS avg_duration, round(sum(revenue), 2) AS total_revenue,
            round(avg(revenue), 6) AS avg_revenue FROM calls WHERE agent_id IS NOT NULL GROUP BY agent_id)
          SELECT *, CAST(row_number() OVER (ORDER BY total_calls DESC, agent_id) AS INT) AS rank,
            round(avg(total_calls) OVER (), 6) AS mean_calls_per_agent FROM g""",
    )
    r2 = lambda e: f"floor(({e}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"
    add(
        "a23_agent_answer",
        m.agent_answer,
        f"SELECT agent_id, count(call_id) AS calls, {r2('avg(duration)')} AS avg_duration, "
        f"{r2('sum(revenue)')} AS revenue FROM calls GROUP BY agent_id",
    )
    add(
        "a24_compare_agents",
        lambda c: m.compare_answer(c, "agents"),
        f"SELECT agent_id, count(call_id) AS calls, {r2(RATE)} AS connection_rate FROM calls GROUP BY agent_id",
    )
    add(
        "a24_compare_campaigns",
        lambda c: m.compare_answer(c, "campaigns"),
        f"SELECT campaign, count(call_id) AS calls, {r2('sum(revenue)')} AS revenue FROM calls GROUP BY campaign",
    )
    general = f""", k AS (SELECT count(*) AS a, avg(duration) / 60 AS b, {RATE} AS c, sum(revenue) AS d FROM calls)
      SELECT metric, round(value, 4) AS value FROM (SELECT 'total_calls' AS metric, CAST(a AS DOUBLE) AS value FROM k
       UNION ALL SELECT 'average_duration', b FROM k UNION ALL SELECT 'connection_rate', c FROM k
       UNION ALL SELECT 'total_revenue', d FROM k)"""
    add("a25_metric_general", lambda c: rounded(m.metric_answer(c), "value", digits=4), general)
    add(
        "a25_metric_alias",
        lambda c: rounded(m.metric_answer(c, "Success_Rate"), "value", digits=4),
        general + " WHERE metric = 'connection_rate'",
    )
    add(
        "a26_duration_histogram",
        lambda c: rounded(m.duration_histogram(c, 30), "low", "high", "mean", "median"),
        """, d AS (SELECT duration / 60 AS m FROM calls WHERE duration IS NOT NULL),
          e AS (SELECT min(m) AS lo, max(m) AS hi, avg(m) AS mean, quantile_cont(m, 0.5) AS median FROM d),
          b AS (SELECT CAST(least(floor((m - lo) / ((hi - lo) / 30)), 29) AS INT) AS bin, count(*) AS n
            FROM d, e GROUP BY 1),
          s AS (SELECT CAST(i AS INT) AS bin FROM range(30) r(i))
          SELECT s.bin, round(lo + (hi - lo) / 30 * s.bin, 6) AS low, round(lo + (hi - lo) / 30 * (s.bin + 1), 6) AS high,
            round(mean, 6) AS mean, round(median, 6) AS median, coalesce(n, 0) AS calls
          FROM s, e LEFT JOIN b ON b.bin = s.bin""",
    )
    add(
        "a28_quality_score",
        lambda c: rounded(m.quality_score(c, ["call_id", "timestamp", "duration", "transcript"]), "value"),
        """, k AS (SELECT count(*) AS total_rows, count(*) - count(call_id) AS m1, count(*) - count("timestamp") AS m2,
            count(*) - count(duration) AS m3, count(*) FILTER (WHERE length(phone_number) < 10) AS ph,
            count(*) FILTER (WHERE duration < 0) AS neg,
            (SELECT coalesce(sum(n - 1), 0) FROM (SELECT count(*) AS n FROM calls GROUP BY ALL
               HAVING count(*) > 1)) AS dup FROM calls)
          SELECT metric, round(CAST(v AS DOUBLE), 6) AS value FROM (
            SELECT 'total_rows' AS metric, total_rows AS v FROM k UNION ALL SELECT 'missing_call_id', m1 FROM k
            UNION ALL SELECT 'missing_timestamp', m2 FROM k UNION ALL SELECT 'missing_duration', m3 FROM k
            UNION ALL SELECT 'invalid_phone_numbers', ph FROM k UNION ALL SELECT 'negative_durations', neg FROM k
            UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM calls) - (SELECT count(*) FROM
              (SELECT DISTINCT * FROM calls)) FROM k
            UNION ALL SELECT 'quality_score', greatest(0, 100 - 20.0 * (m1 + m2 + m3) / total_rows
              - CASE WHEN ph > 0 THEN 5 ELSE 0 END - CASE WHEN neg > 0 THEN 10 ELSE 0 END) FROM k)""",
    )
    doc_names = ["call_id", "timestamp", "duration", "agent_id", "campaign", "outcome", "call_type", "revenue",
                 "transcript"]
    profile = " UNION ALL ".join(
        f"SELECT '{c}', 'null_count', CAST(count(*) - count(\"{c}\") AS DOUBLE), "
        f"CASE WHEN (count(*) - count(\"{c}\")) * 100.0 > 50.0 * count(*) THEN 'warning' ELSE 'info' END FROM calls"
        for c in doc_names
    )
    add(
        "a29_frame_profile",
        lambda c: m.frame_profile(c, ["call_id", "customer_name"], {"duration": "string", "revenue": "double"}),
        f"""SELECT '*' AS column_name, 'row_count' AS check_name, CAST(count(*) AS DOUBLE) AS value,
            'info' AS severity FROM calls
          UNION ALL SELECT '*', 'column_count', {len(doc_names)}.0, 'info'
          UNION ALL SELECT '*', 'duplicate_rows', CAST((SELECT count(*) FROM calls) -
            (SELECT count(*) FROM (SELECT DISTINCT * FROM calls)) AS DOUBLE), 'info'
          UNION ALL {profile}
          UNION ALL SELECT 'customer_name', 'missing_column', 1.0, 'error'
          UNION ALL SELECT 'duration', 'type_mismatch', 1.0, 'warning'""",
        document_calls,
        with_documents,
    )
    return q
