"""Registered comparison, cohort and series queries: A13, A30 to A32, W1 to W12, O1 to O5, J1, J3."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import cohort as c
from ..operators import compare as cmp
from ..operators import filters as f
from ..operators import metrics as m
from ..operators import series as s
from .rounding import rounded
from .views import event_calls, order_calls, table, with_events, with_orders

CUR = "(\"timestamp\" >= DATE '2024-01-15' AND \"timestamp\" < DATE '2024-01-25')"
PREV = "(\"timestamp\" >= DATE '2024-01-05' AND \"timestamp\" < DATE '2024-01-15')"
RATE = "count(*) FILTER (WHERE outcome = 'connected') * 100.0::DOUBLE / count(*)"
UNIT = {"Daily": "day", "Weekly": "week", "Monthly": "month"}
LABEL = {"Daily": "%Y-%m-%d", "Weekly": "Week of %Y-%m-%d", "Monthly": "%Y-%m"}


def _periods(calls):
    first, last = date(2024, 1, 15), date(2024, 1, 24)
    # One group only occurs in the current, one only in the previous period.
    calls = calls.withColumn(
        "team",
        F.when(F.dayofmonth("timestamp") == 20, "late team")
        .when(F.dayofmonth("timestamp") == 7, "early team")
        .otherwise(F.col("agent_id")),
    )
    return f.day_range(calls, first, last), f.day_range(calls, *m.previous_period(first, last))


TEAM = """, t AS (SELECT *, CASE WHEN day("timestamp") = 20 THEN 'late team'
    WHEN day("timestamp") = 7 THEN 'early team' ELSE agent_id END AS team FROM calls)"""


def _compare_sql(metrics: dict[str, str], tail: str) -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in metrics.items())
    both = ", ".join(
        f"coalesce(x.{n}, 0) AS {n}_Current, coalesce(y.{n}, 0) AS {n}_Previous" for n in metrics
    )
    return f"""{TEAM}, x AS (SELECT team, {cols} FROM t WHERE {CUR} GROUP BY team),
      y AS (SELECT team, {cols} FROM t WHERE {PREV} GROUP BY team),
      j AS (SELECT coalesce(x.team, y.team) AS team, {both} FROM x FULL JOIN y ON x.team = y.team)
      {tail}"""


def _index_sql(granularity: str) -> str:
    if granularity == "Monthly":
        return "(year(ps) * 12 + month(ps)) - (year(cs) * 12 + month(cs))"
    days = "date_diff('day', cs, ps)"
    return f"{days} // 7" if granularity == "Weekly" else days


def _cohort_sql(by: str, key: str, granularity: str) -> str:
    label = f"strftime(cs, '{LABEL[granularity]}')"
    label = label if by == "first_call" else f"{key} || ' • ' || {label}"
    u = UNIT[granularity]
    return f""", d AS (SELECT *, CAST(date_trunc('{u}', "timestamp") AS TIMESTAMP) AS ps,
        CAST(date_trunc('{u}', min("timestamp") OVER (PARTITION BY {key})) AS TIMESTAMP) AS cs
        FROM calls WHERE {key} IS NOT NULL),
      l AS (SELECT *, {label} AS cohort_label, CAST({_index_sql(granularity)} AS INT) AS i FROM d)"""


def entries():
    q = {}

    def add(name, run, sql, view=event_calls, wrap=with_events):
        q[name] = (lambda spark, sf, run=run: run(view(spark, sf)), wrap(sql))

    metrics = {"count": "CAST(count(*) AS DOUBLE)", "revenue": "sum(revenue)", "connection_rate": RATE}
    change = lambda n: (
        f"round(CASE WHEN {n}_Previous = 0 THEN sign({n}_Current) * least(100.0, abs({n}_Current) / "
        f"greatest((SELECT max(greatest(abs({n}_Current), abs({n}_Previous))) FROM j), 1e-9) * 100) "
        f"ELSE greatest(-100, least(100, ({n}_Current - {n}_Previous) / abs({n}_Previous) * 100)) END, 4)"
    )
    cols = ", ".join(
        f"round({n}_Current, 4) AS {n}_Current, round({n}_Previous, 4) AS {n}_Previous, "
        f"round({n}_Current - {n}_Previous, 4) AS {n}_Delta, {change(n)} AS {n}_Change"
        for n in metrics
    )
    every = [f"{n}_{k}" for n in metrics for k in ("Current", "Previous", "Delta", "Change")]
    add(
        "a13_compare_groups",
        lambda calls: rounded(
            cmp.compare_groups(*_periods(calls), "team", list(metrics)), *every, digits=4
        ),
        _compare_sql(metrics, f"SELECT team, {cols} FROM j"),
    )

    def merged(calls):
        cur, prev = _periods(calls)
        left = cmp.group_metrics(cur, "team", ["count"], "Current")
        return cmp.merge_groups(left, cmp.group_metrics(prev, "team", ["count"], "Previous"), "team")

    add(
        "j1_full_outer_merge",
        merged,
        _compare_sql({"count": "CAST(count(*) AS DOUBLE)"}, "SELECT * FROM j"),
    )
    melt = " UNION ALL ".join(
        f"SELECT team, '{n}' AS \"Metric\", '{p}' AS \"Period\", round({n}_{p}, 4) AS \"Value\" FROM j"
        for n in metrics for p in ("Current", "Previous")
    )
    add(
        "a32_comparison_long",
        lambda calls: rounded(
            cmp.comparison_long(cmp.compare_groups(*_periods(calls), "team", list(metrics)), "team"),
            "Value", digits=4,
        ),
        _compare_sql(metrics, melt),
    )
    priorities = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    q["a30_board_cross_tab"] = (
        lambda spark, sf: cmp.cross_tab(
            table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority", ["O", "P", "F", "X"], priorities
        ),
        "WITH r(o_orderstatus, row_order) AS (VALUES ('O', 0), ('P', 1), ('F', 2), ('X', 3)), "
        "p(o_orderpriority) AS (VALUES ('All'), " + ", ".join(f"('{p}')" for p in priorities) + ") "
        """SELECT r.o_orderstatus, CAST(r.row_order AS INT) AS row_order, p.o_orderpriority,
          (SELECT count(*) FROM orders o WHERE o.o_orderstatus = r.o_orderstatus
            AND (p.o_orderpriority = 'All' OR o.o_orderpriority = p.o_orderpriority)) AS items FROM r, p""",
    )
    q["o3_board_order"] = (
        lambda spark, sf: cmp.board_order(
            table(spark, sf, "part"), "p_brand", "p_type", "p_name", ["LARGE", "MEDIUM", "SMALL"]
        ).select("p_brand", "p_type", "p_name", "priority_rank", "p_partkey"),
        """SELECT p_brand, p_type, p_name, CAST(CASE p_type WHEN 'LARGE' THEN 0 WHEN 'MEDIUM' THEN 1
          WHEN 'SMALL' THEN 2 ELSE 99 END AS INT) AS priority_rank, p_partkey FROM part""",
    )
    days = ", ".join(
        f"count(*) FILTER (WHERE dayname(\"timestamp\") = '{d}') AS \"{d}\"" for d in cmp.DAYS
    )
    add(
        "a31_hour_by_weekday",
        cmp.hour_by_weekday,
        f'SELECT CAST(hour("timestamp") AS INT) AS hour, {days} FROM calls GROUP BY 1',
    )
    for name, by, key, gran in (
        ("w1_first_call_cohorts", "first_call", "phone_number", "Monthly"),
        ("w2_campaign_cohorts", "campaign", "campaign", "Weekly"),
        ("w3_agent_cohorts", "agent", "agent_id", "Daily"),
    ):
        add(
            name,
            lambda calls, by=by, gran=gran: c.assign_cohorts(calls, by, gran).select(
                "call_id", "cohort_label", F.date_format("cohort_start", "yyyy-MM-dd").alias("cohort_start"),
                F.col("period_index").cast("int").alias("period_index"),
            ),
            _cohort_sql(by, key, gran)
            + "SELECT call_id, cohort_label, strftime(cs, '%Y-%m-%d') AS cohort_start, i AS period_index FROM l",
            order_calls,
            with_orders,
        )
    add(
        "w4_period_indices",
        lambda calls: c.assign_cohorts(calls, "first_call", "Weekly")
        .where(F.col("period_index").between(0, 3))
        .groupBy(F.col("period_index").cast("int").alias("period_index"))
        .agg(F.count(F.lit(1)).alias("calls")),
        _cohort_sql("first_call", "phone_number", "Weekly")
        + "SELECT i AS period_index, count(*) AS calls FROM l WHERE i BETWEEN 0 AND 3 GROUP BY i",
    )
    r2 = lambda e: f"floor(({e}) * 100.0::DOUBLE + 0.5) / 100.0::DOUBLE"
    measures = {
        "w5_retention": ("retention_rate", lambda i: (
            f"count(DISTINCT phone_number) FILTER (WHERE i = {i}) / "
            "CAST(nullif(count(DISTINCT phone_number) FILTER (WHERE i = 0), 0) AS DOUBLE) * 100")),
        "w6_average_duration": ("average_duration", lambda i: f"coalesce(avg(duration) FILTER (WHERE i = {i}), 0) / 60"),
        "w7_revenue": ("revenue", lambda i: f"coalesce(sum(revenue) FILTER (WHERE i = {i}), 0)"),
        "w8_call_frequency": ("call_frequency", lambda i: f"CAST(count(call_id) FILTER (WHERE i = {i}) AS DOUBLE)"),
    }
    setups = [
        ("first_monthly", "first_call", "phone_number", "Monthly", order_calls, with_orders, 12),
        ("campaign_monthly", "campaign", "campaign", "Monthly", order_calls, with_orders, 12),
        ("first_weekly", "first_call", "phone_number", "Weekly", event_calls, with_events, 5),
        ("agent_daily", "agent", "agent_id", "Daily", event_calls, with_events, 8),
    ]
    for name, (measure, expr) in measures.items():
        for tag, by, key, gran, view, wrap, n in setups:
            cols = ", ".join(f'{r2(expr(i))} AS "Period {i}"' for i in range(n))
            add(
                f"{name}_{tag}",
                lambda calls, measure=measure, by=by, gran=gran, n=n: c.cohort_matrix(
                    calls, measure, by, gran, n
                ),
                _cohort_sql(by, key, gran)
                + f"SELECT cohort_label, {cols} FROM l WHERE i >= 0 AND i < {n} GROUP BY cohort_label",
                view,
                wrap,
            )
    label = {
        "hourly": "strftime(b, '%Y-%m-%d %H:%M')",
        "daily": "strftime(b, '%Y-%m-%d')",
        "weekly": "strftime(b + INTERVAL 6 DAY, '%Y-%m-%d')",
        "monthly": "strftime(last_day(b), '%Y-%m-%d')",
    }
    for step, (unit, *_) in s.STEPS.items():
        span = "INTERVAL 7 DAY" if step == "weekly" else f"INTERVAL 1 {unit.upper()}"
        for group in (None, "agent_id") if step in ("hourly", "daily") else (None,):
            k = f"{group}, " if group else ""
            on = f"g.{group} = n.{group} AND " if group else ""
            add(
                f"w9_volume_{step}" + ("_by_agent" if group else ""),
                lambda calls, step=step, group=group: s.volume_series(calls, step, group),
                f""", n AS (SELECT {k}CAST(date_trunc('{unit}', "timestamp") AS TIMESTAMP) AS b, count(*) AS calls
                    FROM calls GROUP BY ALL),
                  g AS (SELECT {k}unnest(generate_series(min(b), max(b), {span})) AS b FROM n
                    {'GROUP BY ' + group if group else ''})
                  SELECT {'g.' + group + ', ' if group else ''}{label[step].replace('b', 'g.b', 1) if step != 'monthly'
                    else label[step].replace('(b)', '(g.b)')} AS bucket,
                    coalesce(calls, 0) AS calls FROM g LEFT JOIN n ON {on}g.b = n.b""",
                *((order_calls, with_orders) if step in ("weekly", "monthly") else (event_calls, with_events)),
            )
    avg = lambda w: f"round(avg(value) OVER (ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6) AS ma_{w}"
    for column, value, fill in (("calls", "CAST(count(*) AS DOUBLE)", "coalesce(value, 0)"),
                                ("duration", "avg(duration)", "value")):
        add(
            f"w10_moving_average_{column}",
            lambda calls, column=column: rounded(
                s.moving_averages(calls, column, (3, 7, 14, 30)), "value", "ma_3", "ma_7", "ma_14", "ma_30"
            ),
            f""", n AS (SELECT CAST("timestamp" AS DATE) AS d, {value} AS value FROM calls GROUP BY 1),
              g AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM n),
              v AS (SELECT strftime(g.d, '%Y-%m-%d') AS day, {fill} AS value FROM g LEFT JOIN n ON g.d = n.d)
              SELECT day, {avg(3)}, {avg(7)}, {avg(14)}, {avg(30)}, round(value, 6) AS value FROM v""",
            order_calls,
            with_orders,
        )
    add(
        "w11_rank_groups",
        lambda calls: s.rank_groups(
            calls.groupBy("phone_number").agg(F.count(F.lit(1)).alias("calls")), "calls", "phone_number"
        ),
        """SELECT phone_number, calls, CAST(row_number() OVER (ORDER BY calls DESC, phone_number) AS INT) AS rank
           FROM (SELECT phone_number, count(*) AS calls FROM calls GROUP BY 1)""",
    )
    add(
        "w11_rank_many_groups",
        lambda calls: s.rank_groups(
            calls.groupBy("phone_number").agg(F.count(F.lit(1)).alias("calls")), "calls", "phone_number"
        ),
        """SELECT phone_number, calls, CAST(row_number() OVER (ORDER BY calls DESC, phone_number) AS INT) AS rank
           FROM (SELECT phone_number, count(*) AS calls FROM calls GROUP BY 1)""",
        order_calls,
        with_orders,
    )
    add(
        "o1_newest_calls",
        lambda calls: s.newest(calls, 10),
        'SELECT * FROM calls ORDER BY "timestamp" DESC, call_id LIMIT 10',
    )
    add(
        "o2_page_rows",
        lambda calls: s.page_rows(calls, 25, 7).select("call_id", "timestamp", "duration"),
        'SELECT call_id, "timestamp", duration FROM calls ORDER BY "timestamp" DESC, call_id LIMIT 25 OFFSET 175',
    )
    add(
        "o2_deep_page_rows",
        lambda calls: s.page_rows(calls, 50, 10**9).select("call_id", "timestamp", "duration"),
        """SELECT call_id, "timestamp", duration FROM calls ORDER BY "timestamp" DESC, call_id LIMIT 50
           OFFSET (SELECT (count(*) - 1) // 50 * 50 FROM calls)""",
        order_calls,
        with_orders,
    )
    add(
        "o2_page_info",
        lambda calls: s.page_info(calls, 25, 10**9),
        """SELECT count(*) AS total_rows, CAST(ceil(count(*) / 25.0) AS BIGINT) AS total_pages,
           CAST(ceil(count(*) / 25.0) AS BIGINT) - 1 AS page FROM calls""",
    )
    return q
