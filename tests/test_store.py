from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from callspark.operators import metrics
from callspark.schema import MissingColumns, record_rules, typed_calls
from callspark.sources import export as ex
from callspark.sources import ingest as ing
from callspark.sources import rollups
from callspark.sources import store as st
from callspark.streaming import imports as stream

AS_OF = datetime(2024, 2, 1, 8, 0)


def test_header_mapping():
    got = ing.map_headers(["Interaction ID", "Start-Time", "Length", "Call Notes", "Agent", "Agent Name", "Total Amount"])
    assert got["call_id"] == "Interaction ID" and got["timestamp"] == "Start-Time" and got["duration"] == "Length"
    assert got["transcript"] == "Call Notes" and got["agent_id"] == "Agent" and got["agent_name"] == "Agent Name"
    assert got["revenue"] == "Total Amount"
    assert len(set(got.values())) == len(got)
    plain = ing.map_headers(["Call Time", "Record"], None)
    assert plain == {"timestamp": "Call Time", "duration": "Call Time"}


def test_standardise(spark):
    df = spark.createDataFrame([("1", "2", "3")], "`Call-Ref X` string, `created_at` string, `call_ref_x` string")
    out = ing.standardise(df, fields=None, mapping={}, required=["timestamp"])
    assert out.first()["call_ref_x"] == "1" and out.first()["timestamp"] == "2"
    assert out.first()["campaign"] is None
    with pytest.raises(MissingColumns):
        ing.standardise(df, fields=None, mapping={})


def test_clean_keeps_first_copy_order(spark):
    df = spark.createDataFrame(
        [("1", "a", 0), ("1", "b", 1), ("1", "a", 2)], "call_id string, outcome string, row_seq long"
    ).withColumn("file_path", F.lit("f")).withColumn("file_block", F.lit(0))
    cleaned = ing.clean(df)
    assert cleaned.count() == 2
    assert st.latest(cleaned, "call_id", ["row_seq"]).first()["outcome"] == "b"


def test_typed_calls_and_rules(spark):
    df = spark.createDataFrame([("1", "bad", "x", " t "), ("2", "2024-01-01 10:00:00", "NaN", "t")],
                               "call_id string, start_time string, duration_seconds string, transcript string")
    rows = typed_calls(df).collect()
    assert rows[0]["timestamp"] is None and rows[0]["duration"] is None and rows[1]["duration"] is None
    assert rows[1]["timestamp"] == datetime(2024, 1, 1, 10)
    assert [r["reason"] for r in record_rules(typed_calls(df)).collect()] == ["timestamp missing", "duration missing"]
    with pytest.raises(MissingColumns):
        typed_calls(df.drop("transcript"))


def test_upsert_last_wins_and_null_keys_are_equal(spark):
    schema = "call_id string, v string, batch_seq int, row_seq int"
    old = spark.createDataFrame([("a", "1", 1, 1), (None, "n", 1, 2), ("b", "1", 1, 3)], schema)
    new = spark.createDataFrame([("a", "2", 2, 1), ("a", "3", 2, 2), (None, "m", 2, 3), ("c", "1", 2, 4)], schema)
    got = {r["call_id"]: r["v"] for r in st.upsert(old, new, "call_id", ["batch_seq", "row_seq"]).collect()}
    assert got == {"a": "3", None: "m", "b": "1", "c": "1"}
    assert st.rows_added(old, new, "call_id").first()[0] == 1


def test_versions_snapshots_and_history(spark, tmp_path):
    root = str(tmp_path)
    assert st.load_table(spark, root, "calls") is None and st.load_snapshot(spark, root, "x") is None
    for n in (3, 5):
        st.save_table(spark.range(n).withColumn("timestamp", F.lit(AS_OF)), root, "calls", AS_OF)
    assert st.load_table(spark, root, "calls").count() == 5
    name = st.create_snapshot(spark.range(2).toDF("x"), root, "calls", AS_OF)
    assert name == "calls_20240201_080000"
    assert st.load_snapshot(spark, root, name).count() == 2
    assert st.list_snapshots(spark, root).first()["record_count"] == 2
    with pytest.raises(ValueError):
        st.save_table(spark.range(1), root, "t", AS_OF, "pickle")
    for i, (status, rows) in enumerate([("success", 10), ("failed", None), ("success", 5)]):
        st.add_import_record(spark, root, {"filename": f"{i}.csv", "timestamp": AS_OF, "records_imported": rows, "status": status})
    assert tuple(st.import_summary(st.import_history(spark, root)).first()) == (3, 15, 2, 1)
    st.clear_import_history(spark, root, datetime(2024, 2, 1, 9))
    assert tuple(st.import_summary(st.import_history(spark, root)).first()) == (0, 0, 0, 0)
    st.add_import_record(spark, root, {"timestamp": datetime(2024, 2, 2), "status": "success"})
    assert st.import_history(spark, root).count() == 1
    stats = st.storage_statistics(st.load_table(spark, root, "calls"), root).first()
    assert (stats["total_records"], stats["snapshots"]) == (5, 1)


def test_date_load_prunes_directories(spark, tmp_path):
    df = spark.sql(
        "SELECT cast(id AS string) AS call_id, TIMESTAMP_NTZ '2024-01-01 12:00:00' + make_dt_interval(cast(id AS int)) AS timestamp FROM range(30)"
    )
    st.save_table(st.by_day(df), str(tmp_path), "calls", AS_OF, partition_by=["call_date"])
    got = st.load_range(st.load_table(spark, str(tmp_path), "calls"), date(2024, 1, 5), date(2024, 1, 7))
    assert got.count() == 3
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(call_date" in plan and "PushedFilters: [IsNotNull(timestamp)" in plan


def test_exports(spark, tmp_path):
    df = spark.sql("SELECT '1' AS call_id, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS timestamp, 'a/b?' AS campaign, 2.0D AS revenue")
    assert ex.export_columns(df, "nonsense").columns == ["call_id", "timestamp", "campaign", "revenue"]
    assert ex.export_columns(df, "summary").first()["timestamp"] == "2024-01-02"
    ex.export_for_analytics(df, str(tmp_path / "a"), "campaign")
    assert (tmp_path / "a" / "data" / "split_name=a_b_").is_dir()
    ex.export_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first()["timestamp"] == "2024-01-02 03:04:05"
    with pytest.raises(ValueError):
        ex.export_filtered(df, str(tmp_path / "x"), "xlsx")
    names = spark.createDataFrame([(" ..",), ("x|y",)], "v string").select(ex.safe_name(F.col("v"))).collect()
    assert [r[0] for r in names] == ["unnamed", "x_y"]


def test_bad_rows_and_inventory(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.csv").write_text('id,note\n1,"say ""hi"""\n2,x,extra\n')
    (tmp_path / "in" / "sub" / "b.csv").write_text("id,note\n3,y\n")
    (tmp_path / "in" / "c.wav").write_bytes(b"12345")
    rows = ing.read_directory(spark, str(tmp_path / "in"))
    got = {r["file_path"].rsplit("/", 1)[1]: (r["rows"], r["bad_rows"]) for r in ing.file_results(rows).collect()}
    assert got == {"a.csv": (2, 1), "b.csv": (1, 0)}
    assert rows.where("id = '1'").first()["note"] == 'say "hi"'
    files = {r["name"]: r for r in ing.audio_rule(ing.file_inventory(spark, str(tmp_path / "in"), True)).collect()}
    assert files["c.wav"]["reason"] is None and files["a.csv"]["reason"] == "unknown suffix"
    assert files["c.wav"]["sha256"] == "5994471abb01112afcc18159f6cc74b4f511b99806da59b3caf5a9c173cacfc5"


def test_stream_equals_batch_and_replay_changes_nothing(spark, tmp_path):
    head = "Call ID,Start Time,Duration,Notes,Outcome\n"
    source, root = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    (source / "a.csv").write_text(head + "1,2024-01-01 10:00:00,60,hello,busy\n1,2024-01-01 10:00:00,60,hello,busy\n2,2024-01-01,1:30,x,\n")
    (source / "b.csv").write_text(head + "1,2024-01-01 10:00:00,61,hello,connected\n")
    columns = ["Call ID", "Start Time", "Duration", "Notes", "Outcome"]
    seen = []
    run = lambda state, n: stream.import_stream(
        stream.stream_csv(spark, str(source), columns, 1), root, str(tmp_path / state), lambda df, i: seen.append((i, df.count())), n
    ).awaitTermination()
    run("s1", 0)
    got = {r["call_id"]: (r["duration"], r["outcome"]) for r in st.current_calls(spark, root).collect()}
    assert got == {"1": (61.0, "connected"), "2": (90.0, "unknown")}
    assert sorted(n for _, n in seen) == [1, 2]
    run("s2", 0)  # the same batches again replace themselves
    assert st.read_batches(spark, root).count() == 3
    path = st.compact(spark, root, "calls", AS_OF)
    assert spark.read.parquet(path).count() == 2


def test_late_and_replaced_batches_after_compaction(spark, tmp_path):
    """Every order of arrivals gives the last row per call by batch number, and folded files stay shut."""
    root = str(tmp_path)
    stamp = datetime(2024, 1, 1)

    def batch(number, rows):
        data = [(k, v, stamp, "f", 0, i) for i, (k, v) in enumerate(rows)]
        st.write_batch(spark.createDataFrame(data, "call_id string, v string, timestamp timestamp_ntz, file_path string, file_block int, row_seq long"), root, number)

    def now():
        return {r["call_id"]: r["v"] for r in st.current_calls(spark, root).collect()}

    batch(3, [("a", "a3"), ("b", "b3"), ("c", "c3"), (None, "n3")])
    batch(7, [("b", "b7"), ("d", "d7"), ("d", "d7 again")])
    st.compact(spark, root, "calls", AS_OF)
    assert now() == {"a": "a3", "b": "b7", "c": "c3", "d": "d7 again", None: "n3"}
    assert not any("/batches/" in f for f in st.current_calls(spark, root).inputFiles())
    batch(5, [("a", "a5"), ("b", "b5")])  # late: wins over 3, not over 7
    assert now() == {"a": "a5", "b": "b7", "c": "c3", "d": "d7 again", None: "n3"}
    assert all("batch_seq=5" in f for f in st.current_calls(spark, root).inputFiles() if "/batches/" in f)
    batch(7, [("d", "d7 new"), ("e", "e7")])  # replaced: b falls back to the late batch
    assert now() == {"a": "a5", "b": "b5", "c": "c3", "d": "d7 new", "e": "e7", None: "n3"}
    st.compact(spark, root, "calls", datetime(2024, 2, 2))
    assert now() == {"a": "a5", "b": "b5", "c": "c3", "d": "d7 new", "e": "e7", None: "n3"}
    assert not any("/batches/" in f for f in st.current_calls(spark, root).inputFiles())
    batch(3, [(None, "n3 new")])  # c stood in no other batch
    assert now() == {"a": "a5", "b": "b5", "d": "d7 new", "e": "e7", None: "n3 new"}


def test_kpi_stream_appends_closed_windows(spark, tmp_path):
    rows = spark.sql(
        """SELECT * FROM VALUES ('1', TIMESTAMP '2024-01-01 10:05:00', 'a', 'connected', 10.0D, 1.0D),
        ('2', TIMESTAMP '2024-01-01 10:50:00', 'a', 'busy', 20.0D, 0.0D),
        ('3', TIMESTAMP '2024-01-01 14:00:00', 'a', 'busy', 20.0D, 0.0D)
        AS t(call_id, timestamp, agent_id, outcome, duration, revenue)"""
    )
    rows.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    stream.kpi_stream(source, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["calls"], r["connected_calls"], r["avg_duration"]) for r in out] == [(2, 1, 15.0)]


NAMES = ["calls [1].csv", "calls [12].csv", "calls 2.csv", "{a,b}.CSV", "50% of?.csv", "all*.csv", "it's é + \\d.csv"]


def _odd_files(folder):
    for i, name in enumerate(NAMES):
        text = f"Call ID,Start Time,Call Length,Notes\n{i},2024-01-0{i + 1} 10:00:00,60,\"said, {name}\n\"\"twice\"\"\"\n"
        (folder / name).write_text(text)


def test_file_names_are_not_patterns(spark, tmp_path):
    _odd_files(tmp_path)
    good, rejected, errors = ing.import_files(spark, str(tmp_path))
    assert sorted(r["call_id"] for r in good.collect()) == [str(i) for i in range(len(NAMES))]
    assert rejected.collect() == [] and errors.collect() == []
    one = ing.read_csv(spark, ing.literal(f"{tmp_path}/calls [1].csv")).collect()
    assert len(one) == 1 and one[0]["Call ID"] == "0" and one[0]["Notes"].endswith('"twice"')


def test_stream_takes_files_of_any_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _odd_files(tmp_path / "in")
    rows = stream.stream_csv(spark, str(tmp_path / "in"), ["Call ID", "Start Time", "Call Length", "Notes"], files_per_batch=3)
    stream.import_stream(rows, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert st.current_calls(spark, str(tmp_path / "out")).count() == len(NAMES)


def test_headers_over_two_lines_and_other_charsets(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'"Call\nID",Start\n1,2\n')
    (tmp_path / "b.csv").write_bytes("Numéro,Start\n1,café\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("﻿Call,call,,x\n1,2,3,4\n")
    tables = ing.csv_layouts(spark, str(tmp_path))
    names = sorted([c for c in t.columns if c not in (ing.CORRUPT, ing.SOURCE)] for t in tables)
    assert names == sorted([["Call\nID", "Start"], ["Numéro", "Start"], ["Call0", "call1", "_c2", "x"]])


def test_rollup_equals_full_query_after_any_batch(spark, tmp_path):
    """New, late, corrected and replaced batches, calls that change day or key, null ids and times."""
    root, made = str(tmp_path), []

    def batch(number, rows):
        data = [(k, t and datetime.fromisoformat(t), o, d, r, a, "f", 0, i) for i, (k, t, o, d, r, a) in enumerate(rows)]
        kind = "call_id string, timestamp timestamp_ntz, outcome string, duration double, revenue double, agent_id string"
        st.write_batch(spark.createDataFrame(data, kind + ", file_path string, file_block int, row_seq long"), root, number)

    def same():
        made.append(rollups.refresh_rollup(spark, root, "hourly", most_layers=2))
        calls = st.current_calls(spark, root)
        want = stream.window_kpis(calls.where("timestamp is not null")).collect()
        got = rollups.rollup_kpis(spark, root, "hourly").collect()
        key = lambda r: (r[0], r[1] or "")
        assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
        for period in metrics.PERIODS if len(made) == 5 else ["daily"]:
            assert rollups.rollup_trends(spark, root, "hourly", period).collect() == metrics.trends(calls, period).collect()

    first = [("a", "2024-01-01T10:05", "connected", 60.0, 0.125, "x"), ("b", "2024-01-01T10:59", "busy", None, 0.25, "x"),
             ("c", "2024-01-31T23:59:59", "connected", 5.5, None, None), (None, "2024-01-02T00:00", None, 1.0, 0.375, "y"), ("d", None, "busy", 9.0, 1.0, "y")]
    batch(10, first)
    same()
    batch(20, [("a", "2024-02-01T11:00", "busy", 61.0, 0.75, "y"), ("b", "2024-01-01T10:59", "busy", 2.0, 0.25, "x"),
               ("b", "2024-01-01T10:59", "connected", 3.0, 0.25, "x"), ("d", "2024-01-05T08:00", "busy", 9.0, 1.0, "y")])
    same()
    batch(15, [("a", "2024-03-01T00:00", "late", 1.0, 1.0, "z"), ("c", "2024-01-01T10:10", "late", 1.5, 4.0, "x"), ("e", "2024-01-01T10:10", "late", 1.5, 4.0, "x")])
    same()
    made.append(rollups.refresh_rollup(spark, root, "hourly", most_layers=2))
    batch(20, [("e", "2024-01-01T12:10", "connected", 7.0, 4.0, "x")])
    same()
    assert made == [[10], [20], [15], [], [10, 15, 20]]


def test_an_import_searches_every_file_for_its_header_once(spark, tmp_path, monkeypatch):
    for name, text in {"a.csv": "Call ID,Timestamp,Duration,Transcript\n1,2024-01-01 10:00:00,5,hello\n", "b.csv": "\n \n", "c.csv": "x\n1\n"}.items():
        (tmp_path / name).write_text(text)
    searched, search = [], ing.csv_files
    monkeypatch.setattr(ing, "csv_files", lambda *x: searched.append(x) or search(*x))
    good, rejected, errors = ing.import_files(spark, str(tmp_path))
    assert len(searched) == 1
    assert [r["call_id"] for r in good.collect()] == ["1"] and rejected.collect() == []
    assert sorted((r["file_path"][-5:], r["error"][:9]) for r in errors.collect()) == [("b.csv", "no header"), ("c.csv", "missing r")]
