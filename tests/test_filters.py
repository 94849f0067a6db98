from datetime import date, datetime

import pytest

from callspark.operators import filters as f


@pytest.fixture(scope="module")
def calls(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        ('1', TIMESTAMP_NTZ '2024-01-01 00:00:00', 10.0D, 'p1', 'a', 'connected', 5.0D, 'Big DEAL (1)'),
        ('2', TIMESTAMP_NTZ '2024-01-31 23:59:59', 400.0D, 'p1', 'a', 'busy', -1.0D, null),
        ('3', TIMESTAMP_NTZ '2024-02-01 00:00:00', null, 'p1', 'b', null, null, 'small'),
        ('4', null, 20.0D, 'p1', null, 'failed', 0.0D, 'deal')
        AS t(call_id, timestamp, duration, phone_number, agent_id, outcome, revenue, notes)"""
    )


def ids(df):
    return sorted(r["call_id"] for r in df.collect())


def test_date_ends(calls):
    assert ids(f.day_range(calls, date(2024, 1, 1), date(2024, 1, 31))) == ["1", "2"]
    assert ids(f.date_range(calls, datetime(2024, 1, 1), datetime(2024, 1, 31))) == ["1"]
    assert ids(f.date_range(calls, None, None)) == ["1", "2", "3", "4"]


def test_lists_and_ranges(calls):
    assert ids(f.in_list(calls, "outcome", [])) == ["1", "2", "3", "4"]
    assert ids(f.in_list(calls, "absent", ["x"])) == ["1", "2", "3", "4"]
    assert ids(f.in_list(calls, "outcome", ["busy"] + [f"x{i}" for i in range(2000)])) == ["2"]
    assert ids(f.value_range(calls, ["duration"], None, 20)) == ["1", "4"]


def test_search_is_literal_or_regex(calls):
    assert ids(f.text_contains(calls, "DEAL (1)")) == ["1"]
    assert ids(f.text_matches(calls, "deal|SMALL")) == ["1", "3", "4"]


def test_spec_drops_null_and_negative_revenue(calls):
    spec = f.FilterSpec()
    assert ids(spec.apply(calls)) == ["1", "4"]
    again = f.FilterSpec.from_dict(
        f.FilterSpec(date_range=(date(2024, 1, 1), date(2024, 1, 2)), selected_agents=["a"]).to_dict()
    )
    assert again.date_range == (date(2024, 1, 1), date(2024, 1, 2))
    assert ids(again.apply(calls)) == ["1"]


def test_presets():
    day = date(2024, 3, 5)
    assert f.preset_days("Last Month", day) == (date(2024, 2, 1), date(2024, 2, 29))
    assert f.preset_days("Last 7 Days", day) == (date(2024, 2, 28), day)
    assert f.preset_days("last_week", day) == (date(2024, 2, 27), day)


def test_report(calls):
    r = f.filter_report(calls, f.quick_predicate("connected")).first()
    assert (r["original_count"], r["filtered_count"], r["reduction_percentage"]) == (4, 1, 75.0)


def test_segments_are_strict(calls):
    rows = [(r["segment"], r["call_id"]) for r in f.segments(calls, datetime(2024, 2, 2)).collect()]
    assert sorted(c for s, c in rows if s == "frequent_callers") == ["1", "2", "3", "4"]
    assert sorted(c for s, c in rows if s == "recent_calls") == ["2", "3"]
    assert sorted(c for s, c in rows if s == "failed_calls") == ["2", "4"]
    assert sorted(c for s, c in rows if s == "long_calls") == ["2"]


def test_strict_phones(spark):
    df = spark.createDataFrame([("(555) 123-4567",), ("1-555-123-4567",), ("12",), (None,)], "phone_number string")
    assert f.valid_phones(df).count() == 2
    with pytest.raises(ValueError):
        f.valid_phones(df, skip_invalid=False)
