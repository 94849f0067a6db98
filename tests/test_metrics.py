import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F

from callspark.functions.quantiles import percentile_row, select_by_counting
from callspark.operators import compare as cmp
from callspark.operators import metrics as m


def as_map(df):
    return {(r["section"], r["metric"]): r["value"] if r["value"] is not None else r["text_value"] for r in df.collect()}


def test_basic_kpis(kpi_calls):
    r = m.basic_kpis(kpi_calls).first()
    assert (r["total_calls"], r["connected_calls"]) == (3, 2)
    assert r["connection_rate"] == pytest.approx(66.6666, abs=1e-3)
    assert (r["avg_duration"], r["total_duration"], r["median_duration"]) == (120, 360, 120)
    assert r["total_revenue"] == 250 and r["avg_revenue"] == pytest.approx(83.3333, abs=1e-3)
    assert r["revenue_per_minute"] == pytest.approx(41.6666, abs=1e-3)


def test_all_kpis(kpi_calls):
    got = as_map(m.all_kpis(kpi_calls))
    assert got["duration_metrics", "p95"] == pytest.approx(174)
    assert got["time_metrics", "active_days"] == 3
    assert got["time_metrics", "calls_per_day"] == 1.0
    assert got["time_metrics", "first_call"] == "2024-01-01"
    assert got["time_metrics", "last_call"] == "2024-01-03"
    assert got["entity_metrics", "unique_agents"] == 2
    assert got["outcome_distribution", "connected_calls"] == 2
    assert got["outcome_distribution_percentage", "missed_pct"] == pytest.approx(33.3333, abs=1e-3)


def test_empty_table_has_three_zeros(kpi_calls):
    got = as_map(m.all_kpis(kpi_calls.limit(0)))
    assert got == {
        ("overview", "total_calls"): 0,
        ("overview", "connected_calls"): 0,
        ("overview", "connection_rate"): 0.0,
    }


def test_agent_table(kpi_calls):
    first, second = m.agent_table(kpi_calls).collect()
    assert (first["agent_id"], first["total_calls"], first["duration_mean"]) == ("agent-1", 2, 150)
    assert (first["revenue_sum"], first["connection_rate"]) == (250, 100)
    assert (second["total_calls"], second["connection_rate"]) == (1, 0)


def test_case_rules_and_null_outcome(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('1','Connected',10.0D,null,'a'), ('2','connected',null,null,'a'), "
        "('3',null,20.0D,null,'a'), ('4','busy',5.0D,null,null) AS t(call_id,outcome,duration,revenue,agent_id)"
    )
    basic = m.basic_kpis(df).first()
    assert basic["connected_calls"] == 2 and basic["connection_rate"] == 50
    assert basic["total_revenue"] == 0 and basic["avg_revenue"] is None
    agents = m.agent_table(df).collect()
    assert [r["agent_id"] for r in agents] == ["a"]
    assert agents[0]["connection_rate"] == pytest.approx(100 / 3)
    assert m.outcome_distribution(df).agg(F.sum("percentage")).first()[0] == pytest.approx(100)


def test_trends_reject_unknown_period(kpi_calls):
    with pytest.raises(ValueError):
        m.trends(kpi_calls, "yearly")
    with pytest.raises(ValueError):
        m.ad_hoc(kpi_calls, "agent_id", "duration", "mode")


@pytest.mark.parametrize("kind", ["uniform", "hot", "wide", "negative", "one"])
def test_counting_percentiles_equal_sorting(spark, kind):
    rnd = random.Random(7)
    values = {
        "uniform": [rnd.random() * 600 for _ in range(3000)],
        "hot": [42.0] * 1000 + [rnd.choice([1.5, 2.5, 1e6]) for _ in range(2001)],
        "wide": [10 ** rnd.uniform(-8, 12) for _ in range(2000)],
        "negative": [rnd.gauss(0, 50) for _ in range(2500)],
        "one": [3.25],
        "infinite": [1.0, 2.0, 19.0, float("inf")] + [float("-inf")] * 3,
    }[kind]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    percents = [0, 5, 25, 50, 75, 95, 99, 100]
    got = select_by_counting(df, percents).first()
    ordered = sorted(values)
    for p in percents:
        place = (len(ordered) - 1) * p / 100
        low = int(place)
        high = min(low + 1, len(ordered) - 1)
        want = ordered[low] + (ordered[high] - ordered[low]) * (place - low)
        assert got[f"p{p}"] == pytest.approx(want, rel=1e-9, abs=1e-12)
    direct = percentile_row(df, "x", percents).first()
    assert [direct[c] for c in direct.asDict()] == pytest.approx(list(got), rel=1e-9, abs=1e-12)


def test_percentile_of_nothing_is_null(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert percentile_row(df, "x", [50]).first()[0] is None
    assert select_by_counting(df.where("x = 1"), [50]).first()[0] is None


def test_group_medians(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.4 else f"g{rnd.randrange(20)}", rnd.choice([rnd.random(), 7.0])) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r["value"] for r in m.ad_hoc(df, "g", "x", "median").collect()}
    want = {g: statistics.median([x for k, x in rows if k == g]) for g in {k for k, _ in rows}}
    assert got == pytest.approx(want)


def test_funnel_uses_the_stage_before(kpi_calls):
    rows = {r["stage"]: r for r in m.funnel(kpi_calls, ["connected", "missed", "none", "later"]).collect()}
    assert rows["connected"]["percentage"] == pytest.approx(200 / 3)
    assert rows["missed"]["percentage"] == 50
    assert rows["none"]["percentage"] == 0 and rows["later"]["percentage"] == 0


def test_previous_period():
    assert m.previous_period(date(2024, 1, 10), date(2024, 1, 16)) == (date(2024, 1, 3), date(2024, 1, 9))


def test_blocks_without_previous_rows_have_zero_delta(kpi_calls):
    rows = {r["metric"]: r for r in m.call_block(kpi_calls, date(2024, 1, 1), date(2024, 1, 3)).collect()}
    assert rows["total_calls"]["value"] == 3 and rows["total_calls"]["delta"] == 0
    rows = {r["metric"]: r for r in m.revenue_block(kpi_calls, date(2024, 1, 3), date(2024, 1, 3)).collect()}
    assert rows["total_revenue"]["value"] == 150 and rows["total_revenue"]["delta"] == 150


def test_compare_groups_zero_previous(spark):
    cur = spark.createDataFrame([("a", 50.0), ("b", 10.0), (None, 9.0)], "g string, revenue double")
    prev = spark.createDataFrame([("b", 40.0), ("c", 5.0)], "g string, revenue double")
    rows = {r["g"]: r for r in cmp.compare_groups(cur, prev, "g", ["revenue", "absent"]).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["revenue_Change"] == 100  # 50 of the largest value 50
    assert rows["b"]["revenue_Change"] == -75
    assert rows["c"]["revenue_Change"] == -100 and rows["c"]["revenue_Delta"] == -5


def test_quality_score(spark):
    df = spark.sql(
        "SELECT * FROM VALUES ('1','123',-1.0D),('1','123',-1.0D),(null,'1234567890',2.0D),('4','1234567890',3.0D) "
        "AS t(call_id,phone_number,duration)"
    )
    got = {r["metric"]: r["value"] for r in m.quality_score(df, ["call_id", "absent"]).collect()}
    assert got["duplicate_rows"] == 1 and got["missing_call_id"] == 1
    assert got["quality_score"] == 100 - 5 - 5 - 10


def test_cross_tab_fills_zero_cells(spark):
    df = spark.createDataFrame([("Done", "High"), ("Done", "Low"), ("Odd", "Low")], "status string, priority string")
    out = cmp.cross_tab(df, "status", "priority", ["Proposed", "Done"], ["Low", "Medium", "High"])
    got = {(r["status"], r["priority"]): r["items"] for r in out.collect()}
    assert got["Done", "All"] == 2 and got["Done", "Medium"] == 0 and got["Proposed", "All"] == 0
    assert len(got) == 8


def test_compared_kpis_equal_those_of_each_period(spark):
    """Against the KPIs of either side alone; null and nan durations, an empty side, a missing column."""
    rows = [("Connected", 10.0, 1.0), ("busy", None, 2.0), (None, 30.5, None), ("connected", 7.0, 4.0), ("busy", 7.0, 0.0)]
    now = spark.createDataFrame(rows, "outcome string, duration double, revenue double")
    before = spark.createDataFrame([("connected", 4.0, 8.0), ("busy", 9.0, 0.5)], now.schema)
    nothing = now.limit(0)
    for a, b in ((now, before), (before, now), (nothing, now), (now, nothing), (now.drop("revenue"), before.drop("revenue")), (now.drop("duration"), before.drop("duration"))):
        cur, prev = m.basic_kpis(a).first().asDict(), m.basic_kpis(b).first().asDict()
        want = {k: (float(cur[k]), float(prev[k])) for k in cur if prev[k] and cur[k] is not None}
        got = {r["metric"]: (r["current"], r["previous"]) for r in m.compare_kpis(a, b).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in want)
    grouped = now.select(F.coalesce("outcome", F.lit("none")).alias("tag"), F.col("duration").alias("x")).where("x is not null")
    got = {r["tag"]: r["p50"] for r in select_by_counting(grouped, [50], ("tag",)).collect()}
    assert got == {"Connected": 10.0, "none": 30.5, "connected": 7.0, "busy": 7.0}
