import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callspark.functions.skew import spread_rows
from callspark.operators import intent as n
from callspark.operators import labeling as lab

LONG = "speaking with you about this account today and " + " ".join(f"word{i}" for i in range(40))
RULES = {**lab.LABEL_RULES, "scoring": {**lab.LABEL_RULES["scoring"], "fuzzy_matching": False}}


def label(spark, rows, rules=RULES):
    df = spark.createDataFrame([(str(i), t, d) for i, (t, d) in enumerate(rows)], "call_id string, transcript string, duration double")
    return lab.label_calls(df, rules=rules).orderBy("call_id").collect()


def test_connection_rules(spark):
    rows = label(spark, [("please leave a message, voicemail", 100.0), (LONG, 10.0), (LONG, 60.0), ("short", 60.0), (LONG, None)])
    assert [r["connection_status"] for r in rows] == ["Disconnected", "Disconnected", "Connected", "Disconnected", "Unknown"]
    assert rows[0]["matched_keywords"] == "voicemail"
    assert rows[4]["labeling_confidence"] == 0


def test_types_ties_and_overrides(spark):
    complaint = "complaint unhappy angry manager supervisor terrible"
    support = "broken error problem issue trouble crashed"
    rows = label(spark, [(complaint, 60.0), (complaint + " " + support, 60.0), ("really  unhappy", 60.0), ("a severe bug", 60.0)])
    assert rows[0]["call_type"] == "Complaint"
    assert rows[1]["call_type"] == "Complaint"  # equal scores: the priority list decides
    assert rows[2]["call_type"] == "Complaint"  # below the minimum, but the pattern overrides
    assert rows[3]["outcome"] == "Callback"


def test_outcome_bonus_counts_the_end(spark):
    rules = {**RULES, "outcomes": {"resolved": ["fixed"], "sale_close": ["receipt sent"]}, "priorities": {}}
    start = "fixed " + "x " * 400 + "receipt sent"
    row = label(spark, [(start, 60.0)], rules)[0]
    assert row["outcome"] == "Sale-Close"  # 1.5 against 1.0
    both = label(spark, [("fixed and receipt sent", 60.0)], rules)[0]
    assert both["outcome"] == "Resolved"  # equal: order of the rules


def test_fuzzy_words_and_phrases(spark):
    fuzzy = {**RULES, "scoring": {**RULES["scoring"], "fuzzy_matching": True},
             "call_types": {"support": ["technical"], "inquiry": ["question about"]}, "outcomes": {}}
    rows = label(spark, [("a tehcnical thing", 60.0), ("a questoin about it", 60.0), ("nothing", 60.0)], fuzzy)
    assert [r["call_type"] for r in rows] == ["Support", "Inquiry", "Unknown"]


def test_update_labels_keeps_old_where_new_is_null(spark):
    calls = spark.createDataFrame([("1", "A", "x"), ("2", "B", "y")], "call_id string, call_type string, outcome string")
    new = spark.createDataFrame([("1", "C", None)], "call_id string, call_type string, outcome string")
    rows = {r["call_id"]: (r["call_type"], r["outcome"]) for r in lab.update_labels(calls, new).collect()}
    assert rows == {"1": ("C", "x"), "2": ("B", "y")}


AS_OF = datetime(2024, 3, 6, 10, 0)


@pytest.mark.parametrize(
    ("text", "start", "end"),
    [
        ("last 3 days", "2024-03-03 10:00:00", "2024-03-06 10:00:00"),
        ("Last Week please", "2024-02-26 00:00:00", "2024-03-03 23:59:59.999999"),
        ("last month", "2024-02-01 00:00:00", "2024-02-29 23:59:59.999999"),
        ("on 2/30/2024 or 2023-12-24", "2023-12-24 00:00:00", "2023-12-24 23:59:59.999999"),
        ("sept 2023", "2023-09-01 00:00:00", "2023-09-30 23:59:59.999999"),
        ("12/2023", "2023-12-01 00:00:00", "2023-12-31 23:59:59.999999"),
        ("whenever", None, None),
    ],
)
def test_time_ranges(spark, text, start, end):
    row = n.interpret(spark.createDataFrame([(text,)], "q string"), "q", AS_OF).first()
    got = row["time_range"]
    want = [datetime.fromisoformat(x) if x else None for x in (start, end)]
    assert ([got["start"], got["end"]] if got else [None, None]) == want


def test_intents(spark):
    texts = [
        'Compare agent Bob and campaign "Spring Sale" billing calls that were disconnected',
        "average duration over 60 and total",
        "show calls",
    ]
    rows = n.interpret(spark.createDataFrame([(x,) for x in texts], "q string"), "q", AS_OF).collect()
    first, second, third = rows
    assert first["action"] == "compare" and first["entities"]["agents"] == ["bob"]
    assert first["entities"]["campaigns"] == ["spring sale"] and first["entities"]["outcomes"] == ["Sale"]
    assert first["entities"]["call_types"] == ["Billing"]
    assert first["filters"]["connection_status"] == "Disconnected"
    assert second["action"] == "aggregate" and second["filters"]["min_duration"] == 60
    assert second["aggregations"] == ["average", "sum"]
    assert third["action"] == "filter" and third["confidence"] == pytest.approx(0.1)
    assert third["explanation"] == "Filtering (low confidence interpretation)"


@pytest.mark.parametrize("name", list(n.P))
@settings(max_examples=60, deadline=None)
@given(st.data())
def test_hints_hold_wherever_a_pattern_fits(name, data):
    text = data.draw(st.from_regex(n.P[name]))
    assert all(any(h in text for h in some) for some in n.HINTS[name])


def test_parts_of_a_question_that_nobody_reads_are_left_out(spark):
    q = spark.createDataFrame([("find sales calls in march 2023",)], "q string")
    out = n.interpret(q, "q", AS_OF).select(F.col("time_range")["start"].alias("start"))
    assert out.first()["start"] == datetime(2023, 3, 1)
    assert "complaint" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_heavy_rows_are_dealt_by_number(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "t"))
    scan = spark.read.parquet(str(tmp_path / "t"))
    assert spread_rows(scan, 10).rdd.getNumPartitions() == 100
    assert spread_rows(scan, 10_000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert spread_rows(scan, 10).count() == 1000


def _answers(calls, questions):
    """Per question the calls that pass its filter, tested one by one."""
    out = {}
    for q, f in questions:
        mine = [
            c for c in calls
            if all(not f[name] or c[column] in [x for x in f[name] if x is not None] for column, name in n.LISTS.items())
            and all(
                (f[low] is None or c[column] is not None and c[column] >= f[low])
                and (f[high] is None or c[column] is not None and c[column] <= f[high])
                for column, (low, high) in n.RANGES.items()
            )
        ]
        revenue = [c["revenue"] for c in mine if c["revenue"] is not None]
        out[q] = (len(mine), sum(revenue), max(revenue, default=None))
    return out


def test_answers_equal_brute_force(spark):
    rng = random.Random(2)
    pick = lambda *x: rng.choice(x)
    rows = [
        (pick("Support", "Inquiry", None), pick("Resolved", "Refund", "connected", None), pick("a1", "a2", None), pick(None, float(i % 40)), pick(None, 5.0 * i),
         pick(None, AS_OF - timedelta(hours=rng.randint(0, 2000)), AS_OF, AS_OF.replace(hour=0)))
        for i in range(300)
    ]
    calls = spark.createDataFrame(rows, "call_type string, outcome string, agent_id string, duration double, revenue double, timestamp timestamp_ntz")
    day = lambda d: (AS_OF - timedelta(days=d)).date().isoformat()
    texts = [f"{a} calls {b} {c} {d}".strip() for a in ("", "support", "inquiry and billing")
             for b in ("", "resolved", "refund agent a1 agent a2 agent a1")
             for c in ("", "last 7 days", "last 1 days", "last 60 days", f"from {day(20)} to {day(3)}", f"from {day(3)} to {day(9)}", "from 0001-01-01 to 9999-12-31")
             for d in ("", "duration > 12", "duration < 5", "between 100 and 900")]
    texts += ["nothing asked", "nothing else asked", texts[3], None]
    q = spark.createDataFrame([(x,) for x in texts], "q string")
    found = {r["question"]: r for r in n.answer_questions(q, "q", calls, AS_OF).collect()}
    parsed = q.where("q IS NOT NULL").select("q", n.question_filters(F.col("q"), AS_OF).alias("f")).collect()
    want = _answers(calls.collect(), [(r["q"], r["f"]) for r in parsed])
    assert {k: (r["calls"], r["sum_revenue"], r["max_revenue"]) for k, r in found.items()} == want
    assert found[texts[3]]["askers"] == 1 + texts.count(texts[3]) - 1 and len({w[0] for w in want.values()}) > 20
    assert n.answer_questions(q.limit(0), "q", calls, AS_OF).count() == 0


def test_many_questions_do_not_change_the_plan(spark):
    calls = spark.createDataFrame([("Support", "Resolved", "a1", 5.0, 1.0, AS_OF)], "call_type string, outcome string, agent_id string, duration double, revenue double, timestamp timestamp_ntz")
    sizes = []
    for many in (10, 5_000):
        q = spark.range(many).select(F.concat(F.lit("support calls duration > "), F.col("id")).alias("q"))
        out = n.answer_questions(q, "q", calls, AS_OF)
        sizes.append(len(out._jdf.queryExecution().analyzed().toString().splitlines()))
        assert out.count() == many and out.where("calls = 1").count() == 6
    assert sizes[0] == sizes[1]


def test_rules_and_fields_from_toml(spark, tmp_path):
    from callspark.operators.labeling import load_rules, rule_table
    from callspark.sources.ingest import load_fields, map_headers

    (tmp_path / "rules.toml").write_text(
        '[scoring]\nkeyword_weight = 1.5\nphrase_weight = 4.0\n[connection]\nconnection_keywords = ["hello"]\n'
        '[call_types]\nsales = ["buy now", "price"]\n[outcomes]\ndone = ["thanks"]\n'
    )
    rules = load_rules(str(tmp_path / "rules.toml"))
    rows = {(r["label"], r["keyword"]): r["weight"] for r in rule_table(spark.range(1), rules).collect()}
    assert rows == {("connection", "hello"): 1.5, ("sales", "buy now"): 4.0, ("sales", "price"): 1.5, ("done", "thanks"): 1.5}
    scored = {**rules, "scorers": {"sales": lambda k: float(len(k)), "outcomes": lambda k: 0.5}}
    rows = {(r["label"], r["keyword"]): r["weight"] for r in rule_table(spark.range(1), scored).collect()}
    assert rows[("sales", "buy now")] == 7.0 and rows[("done", "thanks")] == 0.5 and rows[("connection", "hello")] == 1.5
    (tmp_path / "fields.toml").write_text(
        '[[fields.definitions]]\nname = "call_id"\nlabel = "Call"\nrequired = true\naliases = ["Ref No"]\npatterns = ["^id"]\n'
    )
    fields = load_fields(str(tmp_path / "fields.toml"))
    assert fields == [("call_id", "Call", True, ["Ref No"], ["^id"])]
    assert map_headers(["x", "refno"], fields) == {"call_id": "refno"}
