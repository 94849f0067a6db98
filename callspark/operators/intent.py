"""Question texts as columns: action, entities, time range, filters, aggregations.

A question log is a table like any other, so a question is taken apart with regex
columns inside its row. Distinct questions are answered together in one pass over the
calls.
"""

from __future__ import annotations

from datetime import datetime, time, timedelta
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import (
    ACTION_WORDS,
    FILTER_QUESTION_PATTERNS,
    MONTHS,
    QUESTION_HINTS,
    QUESTION_PATTERNS,
)
from ..functions.text import let
from ..session import new_folder

NTZ = "timestamp_ntz"
P = QUESTION_PATTERNS
#: Per pattern the strings that a text must hold for it to fit: one of each tuple.
HINTS = QUESTION_HINTS
STRINGS = "array<string>"


def _may_hold(text: Column, hints: list[tuple[str, ...]]) -> Column:
    """Whether the text holds one string of each tuple, which is told far sooner than by a pattern."""
    return reduce(and_, [reduce(or_, [F.contains(text, F.lit(h)) for h in some]) for some in hints])


def _has(text: Column, name: str) -> Column:
    return _may_hold(text, HINTS[name]) & text.rlike("(?U)" + P[name])


def _extract(text: Column, hints: list[tuple[str, ...]], pattern: str, group: int) -> Column:
    """A group that is never empty where the pattern fits; null where it does not."""
    found = let(F.regexp_extract(text, pattern, group), lambda x: F.when(x != "", x))
    return F.when(_may_hold(text, hints), found)


def _group(text: Column, name: str, group: int) -> Column:
    return _extract(text, HINTS[name], "(?U)" + P[name], group)


def _all(text: Column, name: str) -> Column:
    found = F.regexp_extract_all(text, F.lit("(?U)" + P[name]), F.lit(1))
    return F.when(_may_hold(text, HINTS[name]), found).otherwise(F.array().cast(STRINGS))


def action(text: Column) -> Column:
    return (
        F.when(_has(text, "compare"), "compare")
        .when(_has(text, "analyze"), "analyze")
        .when(_has(text, "find"), "search")
        .when(_has(text, "count") | _has(text, "average") | _has(text, "sum"), "aggregate")
        .otherwise("filter")
    )


def entities(text: Column) -> Column:
    return F.struct(
        _all(text, "agent").alias("agents"),
        _all(text, "campaign").alias("campaigns"),
        F.array().cast(STRINGS).alias("customers"),
        F.transform(_all(text, "call_type"), F.initcap).alias("call_types"),
        F.transform(_all(text, "outcome"), F.initcap).alias("outcomes"),
    )


def filters(text: Column) -> Column:
    """Bounds and connection status; absent ones are null."""
    about_time = F.contains(text, F.lit("duration"))
    about_money = F.contains(text, F.lit("amount")) | F.contains(text, F.lit("$"))

    def bound(name: str, group: int, kind: str) -> Column:
        return _group(text, name, group).try_cast(kind)

    low = F.coalesce(bound("between", 1, "bigint"), bound("greater_than", 2, "bigint"))
    high = F.coalesce(bound("between", 2, "bigint"), bound("less_than", 2, "bigint"))
    word = lambda w: F.contains(text, F.lit(w)) & text.rlike(f"\\b{w}\\b")
    status = F.when(word("connected"), "Connected").when(word("disconnected"), "Disconnected")
    return F.struct(
        F.when(about_time, low).alias("min_duration"),
        F.when(about_time, high).alias("max_duration"),
        F.when(about_money, bound("greater_than", 2, "double")).alias("min_amount"),
        F.when(about_money, bound("less_than", 2, "double")).alias("max_amount"),
        status.alias("connection_status"),
    )


def aggregations(text: Column) -> Column:
    names = ["count", "average", "sum", "max", "min"]
    return F.array_compact(F.array(*[F.when(_has(text, n), F.lit(n)) for n in names]))


def _moment(value: datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast(NTZ)


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _whole_days(first: datetime, last: datetime) -> Column:
    return _span(
        _moment(datetime.combine(first, time.min)), _moment(datetime.combine(last, time.max))
    )


def time_range(text: Column, as_of: datetime) -> Column:
    """(start, end) of the first time expression that fits; null when there is none."""
    now = _moment(as_of)
    midnight = datetime.combine(as_of, time.min)
    monday = midnight - timedelta(days=as_of.weekday())
    month = midnight.replace(day=1)
    last_month = month - timedelta(days=1)

    def ago(name: str, unit: str) -> Column:
        back = lambda n: F.when(n.isNotNull(), _span(now - F.make_dt_interval(**{unit: n}), now))
        return let(_group(text, name, 1).try_cast("int"), back)

    def when(name: str, span: Column) -> Column:
        return F.when(_has(text, name), span)

    def day(name: str, y: int, m: int, d: int) -> Column:
        dash = F.lit("-")
        parts = [_group(text, name, g) for g in (y, m, d)]
        # A part that is absent makes the whole text null, so nothing is parsed in vain.
        start = F.try_to_timestamp(F.concat(parts[0], dash, parts[1], dash, parts[2]), F.lit("yyyy-M-d"))
        length = F.expr("interval '0 23:59:59.999999' day to second")
        whole = let(start.cast(NTZ), lambda s: F.when(s.isNotNull(), _span(s, s + length)))
        return F.when(_has(text, name), whole)

    def months(year: Column, number: Column) -> Column:
        text_of = F.concat(year, F.lit("-"), number.cast("string"), F.lit("-1"))
        start = F.try_to_timestamp(text_of, F.lit("yyyy-M-d")).cast(NTZ)
        moment = F.expr("interval '0.000001' second")
        return let(
            start, lambda s: F.when(s.isNotNull(), _span(s, F.add_months(s, 1).cast(NTZ) - moment))
        )

    named = "(?U)\\b(" + "|".join(MONTHS) + ")\\b\\s*(\\d{4})"
    number_of = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
    word, year = (_extract(text, [tuple(MONTHS)], named, g) for g in (1, 2))
    return F.coalesce(
        ago("last_n_days", "days"),
        ago("last_n_hours", "hours"),
        when("yesterday", _whole_days(midnight - timedelta(days=1), midnight - timedelta(days=1))),
        when("today", _span(_moment(midnight), now)),
        when("this_week", _span(_moment(monday), now)),
        when("last_week", _whole_days(monday - timedelta(days=7), monday - timedelta(days=1))),
        when("this_month", _span(_moment(month), now)),
        when("last_month", _whole_days(last_month.replace(day=1), last_month)),
        day("day_ymd", 1, 2, 3),
        day("day_mdy", 3, 1, 2),
        months(year, F.try_element_at(number_of, word)),
        months(_group(text, "month_ym", 1), _group(text, "month_ym", 2)),
        months(_group(text, "month_my", 2), _group(text, "month_my", 1)),
    )


def _given(part: Column, names: list[str]) -> Column:
    return reduce(add, [F.when(part[n].isNotNull(), 1).otherwise(0) for n in names])


FILTER_NAMES = ["min_duration", "max_duration", "min_amount", "max_amount", "connection_status"]
ENTITY_NAMES = ["agents", "campaigns", "customers", "call_types", "outcomes"]


def _confidence(i: dict[str, Column]) -> Column:
    """Each part found adds its own score and 0.1; nothing found gives 0.1."""
    n_entities = reduce(add, [F.size(i["entities"][n]) for n in ENTITY_NAMES])
    n_filters = _given(i["filters"], FILTER_NAMES)
    n_aggregations = F.size(i["aggregations"])
    parts = [
        F.when(i["action"] != "filter", 0.2),
        F.when(n_entities > 0, F.least(F.lit(0.3), n_entities * 0.1)),
        F.when(i["time_range"].isNotNull(), 0.2),
        F.when(n_filters > 0, F.least(F.lit(0.2), n_filters * 0.1)),
        F.when(n_aggregations > 0, F.least(F.lit(0.1), n_aggregations * 0.05)),
    ]
    score = reduce(add, [F.coalesce(p, F.lit(0.0)) for p in parts])
    count = reduce(add, [F.when(p.isNotNull(), 1).otherwise(0) for p in parts])
    return F.when(count > 0, F.least(F.lit(1.0), score + count * 0.1)).otherwise(F.lit(0.1))


def _explanation(i: dict[str, Column]) -> Column:
    def listed(name: str, values: Column) -> Column:
        return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, ", ")))

    days = F.array(*[F.date_format(i["time_range"][end], "yyyy-MM-dd") for end in ("start", "end")])
    when = let(
        days,
        lambda d: F.when(d[0] == d[1], F.concat(F.lit("on "), d[0])).otherwise(
            F.concat(F.lit("from "), d[0], F.lit(" to "), d[1])
        ),
    )
    word = F.lit("Processing")
    for name, shown in ACTION_WORDS.items():
        word = F.when(i["action"] == name, F.lit(shown)).otherwise(word)
    low, high = i["filters"]["min_duration"], i["filters"]["max_duration"]
    text = F.concat_ws(
        " ",
        word,
        listed("call types", i["entities"]["call_types"]),
        listed("outcomes", i["entities"]["outcomes"]),
        listed("agents", i["entities"]["agents"]),
        F.when(i["time_range"].isNotNull(), when),
        F.when(low > 0, F.concat(F.lit("duration > "), low.cast("string"), F.lit("s"))),
        F.when(high > 0, F.concat(F.lit("duration < "), high.cast("string"), F.lit("s"))),
        listed("calculating", i["aggregations"]),
    )
    doubt = F.when(i["confidence"] < 0.5, F.lit(" (low confidence interpretation)"))
    return F.concat(text, F.coalesce(doubt, F.lit("")))


def interpret(df: DataFrame, text: str, as_of: datetime) -> DataFrame:
    """Adds action, entities, time_range, filters, aggregations, confidence, explanation."""
    parts = {
        "action": action,
        "entities": entities,
        "time_range": lambda t: time_range(t, as_of),
        "filters": filters,
        "aggregations": aggregations,
    }
    # Columns of their own, so that Spark leaves out those that nobody reads.
    out = df.withColumn("_lower", F.lower(F.coalesce(F.col(text), F.lit(""))))
    out = out.withColumns({f"_i_{name}": let(F.col("_lower"), part) for name, part in parts.items()})
    i = {name: F.col(f"_i_{name}") for name in parts}
    out = out.withColumn("_i_confidence", _confidence(i))
    i["confidence"] = F.col("_i_confidence")
    return out.select(
        *df.columns, *[c.alias(name) for name, c in i.items()], _explanation(i).alias("explanation")
    )


def filter_spec(intents: DataFrame) -> DataFrame:
    """Adds ``spec``: the intent as a JSON record without absent parts."""
    e, f = F.col("entities"), F.col("filters")

    def some(values: Column) -> Column:
        return F.when(F.size(values) > 0, values)

    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    record = F.struct(
        F.date_format(F.col("time_range")["start"], iso).alias("start_date"),
        F.date_format(F.col("time_range")["end"], iso).alias("end_date"),
        *[some(e[n]).alias(n) for n in ("agents", "campaigns", "call_types", "outcomes")],
        *[f[n].alias(n) for n in FILTER_NAMES],
        F.col("action").alias("_action"),
        F.col("aggregations").alias("_aggregations"),
        F.col("confidence").alias("_confidence"),
    )
    return intents.withColumn("spec", F.to_json(record))


def action_usage(intents: DataFrame) -> DataFrame:
    return intents.groupBy("action").agg(
        F.count(F.lit(1)).alias("questions"), F.avg("confidence").alias("confidence")
    )


# Label of each type or outcome word of a question.
LABEL_OF = {
    "inquiry": "Inquiry",
    "billing": "Billing/Sales",
    "sales": "Billing/Sales",
    "support": "Support",
    "complaint": "Complaint",
    "resolved": "Resolved",
    "callback": "Callback",
    "refund": "Refund",
    "sale": "Sale-Close",
    "connected": "connected",
    "failed": "failed",
}


def _labels(text: Column, pattern: str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LABEL_OF.items() for x in pair])
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(F.array_distinct(found), lambda w: F.try_element_at(table, F.lower(w)))


def question_filters(text: Column, as_of: datetime) -> Column:
    """The filter of a question: one struct of bounds and label lists."""
    p = FILTER_QUESTION_PATTERNS

    def group(name: str, g: int) -> Column:
        return F.nullif(F.regexp_extract(text, p[name], g), F.lit(""))

    def day(g: int) -> Column:
        return F.try_to_timestamp(group("date_range", g), F.lit("yyyy-MM-dd")).cast(NTZ)

    n = group("last_n_days", 1).try_cast("int")
    since = F.when(n.isNotNull(), _moment(as_of) - F.make_dt_interval(days=n))
    seconds = group("duration", 2).try_cast("double")
    more = group("duration", 1) == ">"
    agents = F.regexp_extract_all(text, F.lit("(?i)\\bagent\\s+(\\w+)"), F.lit(1))
    return F.struct(
        # greatest and least skip nulls, so each bound may come from either expression.
        F.greatest(day(1), since).alias("start"),
        F.least(day(2), F.when(n.isNotNull(), _moment(as_of))).alias("end"),
        _labels(text, p["call_type"]).alias("types"),
        _labels(text, p["outcome"]).alias("outcomes"),
        agents.alias("agents"),
        F.when(more, seconds).alias("min_duration"),
        F.when(~more, seconds).alias("max_duration"),
        group("amount", 1).try_cast("double").alias("min_amount"),
        group("amount", 2).try_cast("double").alias("max_amount"),
    )


def _in_ranges(bounds: dict[str, tuple[str, str]]) -> Column:
    """Whether the columns of a call lie between the bounds, each of which may be null (open)."""
    tests = []
    for column, (low, high) in bounds.items():
        tests.append(F.col(low).isNull() | F.coalesce(F.col(column) >= F.col(low), F.lit(False)))
        tests.append(F.col(high).isNull() | F.coalesce(F.col(column) <= F.col(high), F.lit(False)))
    return reduce(and_, tests)


MEASURES = ["duration", "revenue"]
RANGES = {"timestamp": ("start", "end"), "duration": ("min_duration", "max_duration"), "revenue": ("min_amount", "max_amount")}
#: The call columns that a filter can list values for, and the field of the filter that does.
LISTS = {"call_type": "types", "outcome": "outcomes", "agent_id": "agents"}
ANY = "*"
_KEYS = ["shape", "level", "bucket", *[f"key_{c}" for c in LISTS]]


def _day(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date"))


def filter_keys(filters: DataFrame) -> DataFrame:
    """One row per combination of listed values and time bucket of each filter.

    ``shape`` has a bit per list that is not empty; an absent list has the key ``ANY``. A filter
    with both time bounds gets buckets of 2^level days, the smallest that cover its span with
    two of them; others have level -1. Filters that end before they start match nothing.
    """
    out = filters.where("f.start IS NULL OR f.end IS NULL OR f.start <= f.end")
    shape = F.lit(0)
    for bit, (column, name) in enumerate(LISTS.items()):
        listed = F.size(f"f.{name}") > 0
        shape = shape + F.when(listed, 1 << bit).otherwise(0)
        values = F.when(listed, F.array_distinct(f"f.{name}")).otherwise(F.array(F.lit(ANY)))
        out = out.withColumn(f"key_{column}", F.explode(values))
    both = F.col("f.start").isNotNull() & F.col("f.end").isNotNull()
    first, last = _day(F.col("f.start")), _day(F.col("f.end"))
    level = F.when(both, F.ceil(F.log2(last - first + 1)).cast("int")).otherwise(-1)
    out = out.withColumn("shape", shape).withColumn("level", level)
    buckets = F.when(both, F.sequence(_bucket(first, F.col("level")), _bucket(last, F.col("level")))).otherwise(F.array(F.lit(0).cast("bigint")))
    return out.withColumn("bucket", F.explode(buckets)).select("filter", *_KEYS, *[f"f.{b}" for pair in RANGES.values() for b in pair])


def _bucket(day: Column, level: Column) -> Column:
    return F.floor(day / F.pow(F.lit(2.0), level))


def call_keys(calls: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """Every call once per (shape, level) in use, with the keys that filters of it would have."""
    used = calls.select("timestamp", *LISTS, *MEASURES)
    if not shapes:
        used, shapes = used.limit(0), [(0, -1)]
    asked = F.explode(F.array(*[F.struct(F.lit(s).alias("shape"), F.lit(n).alias("level")) for s, n in shapes]))
    out = used.select("*", asked.alias("_asked")).select("*", "_asked.*").drop("_asked")
    for bit, column in enumerate(LISTS):
        out = out.withColumn(f"key_{column}", F.when(F.col("shape").bitwiseAND(1 << bit) > 0, F.col(column).cast("string")).otherwise(ANY))
    bucket = F.when(F.col("level") < 0, F.lit(0).cast("bigint")).otherwise(_bucket(_day(F.col("timestamp")), F.col("level")))
    return out.withColumn("bucket", bucket).select(*_KEYS, *RANGES)


def _parsed_once(asked: DataFrame) -> DataFrame:
    """The questions from a written table: they are read three times and parsed by many patterns."""
    spark = asked.sparkSession
    path = new_folder(spark, "questions")
    asked.write.parquet(path)
    return spark.read.schema(asked.schema).parquet(path)


def answer_questions(questions: DataFrame, text: str, calls: DataFrame, as_of: datetime) -> DataFrame:
    """One row per distinct question: askers, matching calls and their aggregates.

    A predicate join: questions with the same filter are answered once; filters and calls meet
    under keys of listed values and time buckets, and the ranges are tested on what meets. The
    plan has one pass over the calls, however many questions there are; matches are combined
    before they are shuffled. The driver sees the (shape, level) pairs in use, some two hundred
    at most.
    """
    asked = (
        questions.where(F.col(text).isNotNull())
        .groupBy(F.col(text).alias("question"))
        .agg(F.count(F.lit(1)).alias("askers"))
        .withColumn("f", question_filters(F.col("question"), as_of))
        .withColumn("filter", F.sha2(F.to_json("f"), 256))
    )
    asked = _parsed_once(asked)
    keys = filter_keys(asked.groupBy("filter").agg(F.any_value("f").alias("f")))
    shapes = [(r["shape"], r["level"]) for r in keys.select("shape", "level").distinct().collect()]
    hits = call_keys(calls, sorted(shapes)).join(keys, _KEYS).where(_in_ranges(RANGES))
    totals = [F.count(F.lit(1)).alias("calls")]
    for m in MEASURES:
        totals += [
            F.avg(m).alias(f"average_{m}"), F.sum(m).alias(f"sum_{m}"),
            F.max(m).alias(f"max_{m}"), F.min(m).alias(f"min_{m}"),
        ]
    answers = hits.groupBy("filter").agg(*totals)
    out = asked.select("question", "askers", "filter").join(answers, "filter", "left").drop("filter")
    return out.fillna(0, ["calls", *[f"sum_{m}" for m in MEASURES]])
