import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from callspark.functions.skew import join_per_key
from callspark.operators import cohort as c
from callspark.operators import series as s


@pytest.fixture(scope="module")
def calls(spark):
    return spark.sql(
        """SELECT * FROM VALUES
        ('1', TIMESTAMP_NTZ '2024-01-15 10:00:00', 'p1', 'x', 60.0D, 10.0D),
        ('2', TIMESTAMP_NTZ '2024-02-01 10:00:00', 'p1', 'x', 120.0D, 5.0D),
        ('3', TIMESTAMP_NTZ '2024-01-20 10:00:00', 'p2', 'x', null, null),
        ('4', TIMESTAMP_NTZ '2024-02-20 10:00:00', 'p3', null, 30.0D, 1.0D),
        ('5', TIMESTAMP_NTZ '2024-04-20 10:00:00', 'p3', 'y', 30.0D, 1.0D),
        ('6', TIMESTAMP_NTZ '2024-04-20 10:00:00', null, 'y', 30.0D, 1.0D),
        ('7', null, 'p1', 'x', 30.0D, 1.0D)
        AS t(call_id, timestamp, phone_number, campaign, duration, revenue)"""
    )


def table(df, key="cohort_label"):
    return {r[key]: [r[f"Period {i}"] for i in range(3)] for r in df.collect()}


def test_retention(calls):
    assert table(c.cohort_matrix(calls, "retention_rate", periods=3)) == {
        "2024-01": [100.0, 50.0, 0.0],
        "2024-02": [100.0, 0.0, 100.0],
    }


def test_other_measures(calls):
    assert table(c.cohort_matrix(calls, "average_duration", periods=3))["2024-01"] == [1.0, 2.0, 0.0]
    assert table(c.cohort_matrix(calls, "call_frequency", periods=3))["2024-01"] == [2.0, 1.0, 0.0]
    by_campaign = table(c.cohort_matrix(calls, "revenue", "campaign", periods=3))
    assert by_campaign == {"x • 2024-01": [10.0, 5.0, 0.0], "y • 2024-04": [2.0, 0.0, 0.0]}
    with pytest.raises(ValueError):
        c.cohort_matrix(calls, "profit")


def test_weekly_index_counts_from_monday(calls):
    rows = {r["call_id"]: r for r in c.assign_cohorts(calls, "first_call", "Weekly").collect()}
    assert rows["1"]["cohort_label"] == "Week of 2024-01-15" and rows["2"]["period_index"] == 2
    assert set(rows) == {"1", "2", "3", "4", "5"}


def test_hot_keys_join_like_a_plain_join(spark):
    rnd = random.Random(1)
    rows = spark.createDataFrame([(i, "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(50)}") for i in range(2000)], "id int, k string")
    per = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("low")).where("k <> 'k7'")
    for how in ("inner", "left"):
        want = sorted(rows.join(per, "k", how).select("id", "k", "low").collect(), key=lambda r: r["id"])
        got = join_per_key(rows, per, ["k"], how).select("id", "k", "low").collect()
        assert sorted(got, key=lambda r: r["id"]) == want


def test_gaps_are_filled_per_group(spark):
    rows = [("a", datetime(2024, 1, 1)), ("a", datetime(2024, 1, 4)), ("b", datetime(2024, 1, 3))]
    df = spark.createDataFrame(rows, "g string, timestamp timestamp").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    got = [(r["g"], r["bucket"], r["calls"]) for r in s.volume_series(df, "daily", "g").orderBy("g", "bucket").collect()]
    assert got == [("a", "2024-01-01", 1), ("a", "2024-01-02", 0), ("a", "2024-01-03", 0), ("a", "2024-01-04", 1), ("b", "2024-01-03", 1)]
    week = s.volume_series(df, "weekly").first()
    assert week["bucket"] == "2024-01-07" and week["calls"] == 3
    assert s.volume_series(df, "monthly").first()["bucket"] == "2024-01-31"


def test_moving_average_skips_days_without_value(spark):
    rows = [(datetime(2024, 1, 1), 10.0), (datetime(2024, 1, 3), 20.0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, duration double")
    got = s.moving_averages(df, "duration", (2, 3)).orderBy("day").collect()
    assert [(r["value"], r["ma_2"], r["ma_3"]) for r in got] == [(10, 10, 10), (None, 10, 10), (20, 20, 15)]
    calls = s.moving_averages(df, windows=(2,)).orderBy("day").collect()
    assert [r["ma_2"] for r in calls] == [1.0, 0.5, 0.5]


def test_deep_pages_equal_shallow_ones(spark):
    rnd = random.Random(4)
    base = datetime(2024, 1, 1)
    rows = [(f"c{i:04d}", base + timedelta(minutes=rnd.randrange(600)) if rnd.random() > 0.05 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "call_id string, timestamp timestamp").cache()
    for page in (0, 3, 11, 19, 99):
        for column in ("timestamp", "call_id"):
            want = df.orderBy(F.col(column).desc_nulls_last(), "call_id").offset(min(page, 19) * 25).limit(25).collect()
            assert s.page_rows(df, 25, page, column).collect() == want
    assert s.page_info(df.limit(0), 10, 5).first()["page"] == 0


def test_many_groups_rank_like_one_window(spark):
    rnd = random.Random(9)
    df = spark.createDataFrame([(f"k{i}", rnd.randrange(20)) for i in range(400)], "k string, v int")
    rows = sorted(((r["k"], r["v"]) for r in df.collect()), key=lambda r: (-r[1], r[0]))
    want = [(k, v, i + 1) for i, (k, v) in enumerate(rows)]
    assert sorted(tuple(r) for r in s.rank_groups(df, "v", "k").collect()) == sorted(want)


@pytest.mark.parametrize("piece", [1, 7, 1_000])
@pytest.mark.parametrize("step", ["hourly", "daily", "weekly", "monthly"])
def test_spans_are_filled_in_pieces(spark, monkeypatch, piece, step):
    """The same buckets whatever the size of a piece, and none twice."""
    calls = spark.sql(
        """SELECT * FROM VALUES ('a', TIMESTAMP_NTZ '2024-01-31 23:10:00'), ('a', TIMESTAMP_NTZ '2024-03-30 01:00:00'),
        ('b', TIMESTAMP_NTZ '2024-02-29 00:00:00') AS t(agent_id, timestamp)"""
    )
    want = sorted(map(tuple, s.volume_series(calls, step, "agent_id").collect()))
    monkeypatch.setattr(s, "PIECE", piece)
    got = sorted(map(tuple, s.volume_series(calls, step, "agent_id").collect()))
    assert got == want and len({r[:2] for r in got}) == len(got) and sum(r[2] for r in got) == 3
    if step == "hourly":
        assert len([r for r in got if r[0] == 'a']) == 24 * 58 + 3


def test_a_date_far_away_fills_millions_of_buckets(spark):
    calls = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01'), (TIMESTAMP_NTZ '9999-12-31 05:00:00') AS t(timestamp)")
    assert s.volume_series(calls, "daily").agg(F.sum("calls"), F.count("*")).first() == (2, 2_913_174)
