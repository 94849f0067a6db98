"""Registered question queries: L7 to L9. The question texts are built from ``events``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed_values import FILTER_QUESTION_PATTERNS, MONTHS
from ..functions.fixed_values import QUESTION_PATTERNS as P
from ..functions.skew import spread_rows, spread_scan
from ..operators import intent as n
from .rounding import rounded
from .views import EVENT_CALLS_SQL, event_calls, table

AS_OF = datetime(2024, 1, 31, 15, 30)

VERBS = ["Show", "How many", "Find", "Compare", "Breakdown of", "Average and total of the highest", "List"]
TYPES = ["inquiry", "support", "complaint", "billing", "sales"]
RESULTS = ["resolved", "", "refund", "callback"]
TIMES = [
    "last 7 days", "last 36 hours", "yesterday", "today", "this week", "last week", "this month",
    "last month", "on 2024-01-15", "on 1/20/2024", "in March 2023", "in 2023-11", "in 02/2022", "",
    "on 2023-02-31",
]
CONDITIONS = [
    "duration over 60", "duration less than 30", "duration between 10 and 90", "amount above 100",
    "with $ under 50", "connected", "disconnected", "",
]
SHORT_TIMES = ["between 2024-01-05 and 2024-01-20", "last 5 days", "", "between 2024-01-10 and 2024-01-29 last 9 days"]
SHORT_RESULTS = ["Resolved", "", "refund and callback", "sale"]
LIMITS = ["duration > 40", "duration < 100", "", "$5 to $60", "agent agent_003"]
KINDS = ["Inquiry", "Billing/Sales", "Support", "Complaint"]
ENDS = ["Resolved", "Callback", "Refund", "Sale-Close", "failed"]


def _pick(number, values):
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


def _sql_pick(number, values):
    body = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{body}])[CAST({number} % {len(values)} AS INT) + 1]"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread_rows(table(spark, sf_dir, "events"))
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        "event_id",
        F.concat_ws(
            " ",
            _pick(i, VERBS),
            F.when(i % 2 == 0, _pick(u, TYPES)),
            F.lit("calls"),
            _pick(i, RESULTS),
            F.when(i % 3 == 0, F.concat(F.lit("by agent "), u.cast("string"))),
            F.when(i % 5 == 0, F.concat(F.lit('in campaign "'), F.col("event_type"), F.lit('"'))),
            _pick(i, TIMES),
            _pick(i, CONDITIONS),
        ).alias("question"),
    )


QUESTIONS_SQL = f"""questions AS (SELECT event_id, concat_ws(' ', {_sql_pick('event_id', VERBS)},
    CASE WHEN event_id % 2 = 0 THEN {_sql_pick('user_id', TYPES)} END, 'calls', {_sql_pick('event_id', RESULTS)},
    CASE WHEN event_id % 3 = 0 THEN 'by agent ' || user_id END,
    CASE WHEN event_id % 5 = 0 THEN 'in campaign "' || event_type || '"' END,
    {_sql_pick('event_id', TIMES)}, {_sql_pick('event_id', CONDITIONS)}) AS question FROM events)"""


def short_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    return spread_rows(table(spark, sf_dir, "events")).select(
        F.concat_ws(
            " ", F.lit("calls"), _pick(u, [*TYPES, ""]), _pick(i, SHORT_RESULTS), _pick(u, SHORT_TIMES),
            _pick(i, LIMITS),
        ).alias("question")
    )


SHORT_SQL = f"""questions AS (SELECT concat_ws(' ', 'calls', {_sql_pick('user_id', [*TYPES, ''])},
    {_sql_pick('event_id', SHORT_RESULTS)}, {_sql_pick('user_id', SHORT_TIMES)}, {_sql_pick('event_id', LIMITS)})
    AS question FROM events)"""


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _has(name: str) -> str:
    return f"regexp_matches(t, {_s(P[name])})"


def _x(name: str, group: int) -> str:
    return f"nullif(regexp_extract(t, {_s(P[name])}, {group}), '')"


def _list(names: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_has(n)} THEN '{n}' END" for n in names) + \
        "], lambda x: x IS NOT NULL)"


def _caps(name: str) -> str:
    return f"list_transform(regexp_extract_all(t, {_s(P[name])}, 1), lambda x: upper(x[1:1]) || x[2:])"


NAMED = "\\b(" + "|".join(MONTHS) + ")\\b\\s*(\\d{4})"
MONTH_SQL = "CASE regexp_extract(t, " + _s(NAMED) + ", 1) " + " ".join(
    f"WHEN '{k}' THEN {v}" for k, v in MONTHS.items()
) + " END"


def _ts(expr: str) -> str:
    return f"TIMESTAMP '{expr}'"


NOW = _ts("2024-01-31 15:30:00")


def _when_sql() -> tuple[str, str]:
    """Start and end of the time range, first hit wins."""
    end_of = lambda d: _ts(f"{d} 23:59:59.999999")
    day_ymd = f"try_strptime({_x('day_ymd', 1)} || '-' || {_x('day_ymd', 2)} || '-' || {_x('day_ymd', 3)}, '%Y-%m-%d')"
    day_mdy = f"try_strptime({_x('day_mdy', 3)} || '-' || {_x('day_mdy', 1)} || '-' || {_x('day_mdy', 2)}, '%Y-%m-%d')"
    named = f"try_strptime(nullif(regexp_extract(t, {_s(NAMED)}, 2), '') || '-' || {MONTH_SQL} || '-1', '%Y-%m-%d')"
    ym = f"try_strptime({_x('month_ym', 1)} || '-' || {_x('month_ym', 2)} || '-1', '%Y-%m-%d')"
    my = f"try_strptime({_x('month_my', 2)} || '-' || {_x('month_my', 1)} || '-1', '%Y-%m-%d')"
    fixed = [
        ("yesterday", _ts("2024-01-30"), end_of("2024-01-30")),
        ("today", _ts("2024-01-31"), NOW),
        ("this_week", _ts("2024-01-29"), NOW),
        ("last_week", _ts("2024-01-22"), end_of("2024-01-28")),
        ("this_month", _ts("2024-01-01"), NOW),
        ("last_month", _ts("2023-12-01"), end_of("2023-12-31")),
    ]
    starts = [
        f"{NOW} - to_days(CAST({_x('last_n_days', 1)} AS INT))",
        f"{NOW} - to_hours(CAST({_x('last_n_hours', 1)} AS INT))",
        *[f"CASE WHEN {_has(k)} THEN {a} END" for k, a, _ in fixed],
        day_ymd, day_mdy, named, ym, my,
    ]
    day_end = "INTERVAL 1 DAY - INTERVAL 1 MICROSECOND"
    month_end = "INTERVAL 1 MONTH - INTERVAL 1 MICROSECOND"
    ends = [
        f"CASE WHEN {_x('last_n_days', 1)} IS NOT NULL THEN {NOW} END",
        f"CASE WHEN {_x('last_n_hours', 1)} IS NOT NULL THEN {NOW} END",
        *[f"CASE WHEN {_has(k)} THEN {b} END" for k, _, b in fixed],
        f"{day_ymd} + {day_end}", f"{day_mdy} + {day_end}",
        f"{named} + {month_end}", f"{ym} + {month_end}", f"{my} + {month_end}",
    ]
    return f"coalesce({', '.join(starts)})", f"coalesce({', '.join(ends)})"


START, END = _when_sql()
TIMED = "contains(t, 'duration')"
MONEY = "(contains(t, 'amount') OR contains(t, '$'))"
INTENT_SQL = f"""WITH {QUESTIONS_SQL}, l AS (SELECT *, lower(question) AS t FROM questions),
  p AS (SELECT event_id, question,
    CASE WHEN {_has('compare')} THEN 'compare' WHEN {_has('analyze')} THEN 'analyze' WHEN {_has('find')} THEN 'search'
      WHEN {_has('count')} OR {_has('average')} OR {_has('sum')} THEN 'aggregate' ELSE 'filter' END AS action,
    regexp_extract_all(t, {_s(P['agent'])}, 1) AS agents, regexp_extract_all(t, {_s(P['campaign'])}, 1) AS campaigns,
    {_caps('call_type')} AS call_types, {_caps('outcome')} AS outcomes, {START} AS a, {END} AS b,
    CASE WHEN {TIMED} THEN CAST(coalesce({_x('between', 1)}, {_x('greater_than', 2)}) AS BIGINT) END AS min_duration,
    CASE WHEN {TIMED} THEN CAST(coalesce({_x('between', 2)}, {_x('less_than', 2)}) AS BIGINT) END AS max_duration,
    CASE WHEN {MONEY} THEN CAST({_x('greater_than', 2)} AS DOUBLE) END AS min_amount,
    CASE WHEN {MONEY} THEN CAST({_x('less_than', 2)} AS DOUBLE) END AS max_amount,
    CASE WHEN regexp_matches(t, '\\bconnected\\b') THEN 'Connected' WHEN regexp_matches(t, '\\bdisconnected\\b')
      THEN 'Disconnected' END AS connection_status,
    {_list(['count', 'average', 'sum', 'max', 'min'])} AS aggregations FROM l),
  k AS (SELECT *, len(agents) + len(campaigns) + len(call_types) + len(outcomes) AS ne,
    (min_duration IS NOT NULL)::INT + (max_duration IS NOT NULL)::INT + (min_amount IS NOT NULL)::INT
      + (max_amount IS NOT NULL)::INT + (connection_status IS NOT NULL)::INT AS nf, len(aggregations) AS na FROM p),
  c AS (SELECT *, (action <> 'filter')::INT + (ne > 0)::INT + (a IS NOT NULL)::INT + (nf > 0)::INT + (na > 0)::INT AS parts,
    0.2 * (action <> 'filter')::INT + least(0.3, ne * 0.1) + 0.2 * (a IS NOT NULL)::INT + least(0.2, nf * 0.1)
      + least(0.1, na * 0.05) AS score FROM k),
  intents AS (SELECT *, CAST(CASE WHEN parts = 0 THEN 0.1 ELSE least(1.0, score + parts * 0.1) END AS DOUBLE) AS confidence FROM c)"""


def entries():
    q = {}

    def flat(i):
        e, f = F.col("entities"), F.col("filters")
        join = lambda c: F.array_join(c, ",")
        return rounded(
            i.select(
                "event_id", "action", join(e["agents"]).alias("agents"), join(e["campaigns"]).alias("campaigns"),
                join(e["call_types"]).alias("call_types"), join(e["outcomes"]).alias("outcomes"),
                *[f[x].alias(x) for x in n.FILTER_NAMES], join(F.col("aggregations")).alias("aggregations"),
                "confidence", "explanation",
            ),
            "confidence",
        )

    joined = ", ".join(
        f"array_to_string({c}, ',') AS {c}" for c in ("agents", "campaigns", "call_types", "outcomes", "aggregations")
    )
    listed = lambda label, c: (
        f"CASE WHEN len({c}) > 0 THEN '{label}: ' || array_to_string({c}, ', ') END"
    )
    explained = f"""concat_ws(' ', CASE action WHEN 'search' THEN 'Searching for' WHEN 'filter' THEN 'Filtering'
        WHEN 'aggregate' THEN 'Calculating statistics for' WHEN 'compare' THEN 'Comparing' ELSE 'Analyzing' END,
      {listed('call types', 'call_types')}, {listed('outcomes', 'outcomes')}, {listed('agents', 'agents')},
      CASE WHEN a IS NOT NULL THEN CASE WHEN CAST(a AS DATE) = CAST(b AS DATE) THEN 'on ' || strftime(a, '%Y-%m-%d')
        ELSE 'from ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') END END,
      CASE WHEN min_duration > 0 THEN 'duration > ' || min_duration || 's' END,
      CASE WHEN max_duration > 0 THEN 'duration < ' || max_duration || 's' END,
      {listed('calculating', 'aggregations')})
      || CASE WHEN round(confidence, 6) < 0.5 THEN ' (low confidence interpretation)' ELSE '' END"""
    q["l7_interpret"] = (
        lambda spark, sf: flat(n.interpret(questions(spark, sf), "question", AS_OF)),
        INTENT_SQL + f" SELECT event_id, action, {joined}, {', '.join(n.FILTER_NAMES)}, "
        f"round(confidence::DOUBLE, 6) AS confidence, {explained} AS explanation FROM intents",
    )
    q["l7_action_usage"] = (
        lambda spark, sf: rounded(
            n.action_usage(n.interpret(questions(spark, sf), "question", AS_OF)), "confidence"
        ),
        INTENT_SQL + " SELECT action, count(*) AS questions, round(avg(confidence), 6) AS confidence "
        "FROM intents GROUP BY action",
    )
    iso = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"
    q["l7_filter_spec"] = (
        lambda spark, sf: n.filter_spec(n.interpret(questions(spark, sf), "question", AS_OF)).select(
            "event_id",
            F.get_json_object("spec", "$.start_date").alias("start_date"),
            F.get_json_object("spec", "$.end_date").alias("end_date"),
            F.get_json_object("spec", "$.outcomes[0]").alias("outcome"),
            F.get_json_object("spec", "$.min_duration").alias("min_duration"),
            F.get_json_object("spec", "$._action").alias("action"),
        ),
        INTENT_SQL + f""" SELECT event_id, {iso.format('a')} AS start_date, {iso.format('b')} AS end_date,
          outcomes[1] AS outcome, CAST(min_duration AS VARCHAR) AS min_duration, action FROM intents""",
    )
    q["l8_time_range"] = (
        lambda spark, sf: n.interpret(questions(spark, sf), "question", AS_OF).select(
            "event_id", "question", F.col("time_range")["start"].alias("start_ts"), F.col("time_range")["end"].alias("end_ts")
        ),
        INTENT_SQL + " SELECT event_id, question, a AS start_ts, b AS end_ts FROM intents",
    )

    turns = lambda spark, sf: table(spark, sf, "conversations").where("role = 'user'")
    q["l7_conversation_turns"] = (
        lambda spark, sf: rounded(n.action_usage(n.interpret(turns(spark, sf), "text", AS_OF)), "confidence"),
        None,
    )

    def labelled(spark, sf):
        number = F.col("call_id").cast("bigint")
        return spread_scan(event_calls(spark, sf)).withColumn("call_type", _pick(number, KINDS)).withColumn(
            "outcome", _pick(F.floor(number / 3), ENDS)
        )

    def answered(spark, sf):
        out = n.answer_questions(short_questions(spark, sf), "question", labelled(spark, sf), AS_OF)
        return rounded(
            out, *[f"{a}_{m}" for a in ("average", "sum", "max", "min") for m in n.MEASURES], digits=7
        )

    fp = FILTER_QUESTION_PATTERNS
    g = lambda k, i: f"nullif(regexp_extract(question, {_s(fp[k])}, {i}), '')"
    mapped = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in n.LABEL_OF.items()) + "}"
    words = lambda k: (
        f"list_transform(regexp_extract_all(question, {_s(fp[k])}, 1), lambda x: {mapped}[lower(x)])"
    )
    sums = ", ".join(
        f"round(avg({m}), 7) AS average_{m}, round(coalesce(sum({m}), 0), 7) AS sum_{m}, "
        f"round(max({m}), 7) AS max_{m}, round(min({m}), 7) AS min_{m}"
        for m in n.MEASURES
    )
    q["l9_answer_questions"] = (
        answered,
        f"""WITH {SHORT_SQL}, {EVENT_CALLS_SQL},
          v AS (SELECT * REPLACE ({_sql_pick('CAST(call_id AS BIGINT)', KINDS)} AS call_type,
            {_sql_pick('(CAST(call_id AS BIGINT) // 3)', ENDS)} AS outcome) FROM calls),
          d AS (SELECT question, count(*) AS askers FROM questions GROUP BY 1),
          f AS (SELECT *, CAST({g('date_range', 1)} AS TIMESTAMP) AS a, CAST({g('date_range', 2)} AS TIMESTAMP) AS b,
            CAST({g('last_n_days', 1)} AS INT) AS n, {words('call_type')} AS types, {words('outcome')} AS ends,
            regexp_extract_all(question, '(?i)\\bagent\\s+(\\w+)', 1) AS agents,
            {g('duration', 1)} AS op, CAST({g('duration', 2)} AS DOUBLE) AS secs,
            CAST({g('amount', 1)} AS DOUBLE) AS lo, CAST({g('amount', 2)} AS DOUBLE) AS hi FROM d)
          SELECT f.question, askers, count(call_id) AS calls, {sums} FROM f LEFT JOIN v ON
            (a IS NULL OR "timestamp" BETWEEN a AND b)
            AND (n IS NULL OR "timestamp" BETWEEN {NOW} - to_days(n) AND {NOW})
            AND (len(types) = 0 OR list_contains(types, call_type)) AND (len(ends) = 0 OR list_contains(ends, outcome))
            AND (len(agents) = 0 OR list_contains(agents, agent_id))
            AND (op IS NULL OR CASE WHEN op = '>' THEN duration >= secs ELSE duration <= secs END)
            AND (lo IS NULL OR revenue BETWEEN lo AND hi)
          GROUP BY f.question, askers""",
    )
    return q
