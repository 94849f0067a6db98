"""Registered import, storage, export and streaming queries: S1 to S7, P3 to P12, K1 to K11,
O4, O5, W12, R1 to R3. Files are written below the shared folder from the given tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as p
from ..operators import filters as f
from ..schema import record_rules, typed_calls
from ..session import new_folder
from ..sources import export as ex
from ..sources import ingest as ing
from ..sources import rollups
from ..sources import store as st
from ..streaming import imports as stream
from .rounding import rounded
from .views import document_calls, event_calls, order_calls, table, with_documents, with_events, with_orders

AS_OF = datetime(2024, 2, 15, 12, 0)
SECOND = "yyyy-MM-dd HH:mm:ss"

HEADERS = {
    "call_id": "Call ID",
    "timestamp": "Start Time",
    "duration": "Call Length",
    "notes": "Notes",
    "phone_number": "Contact Number",
    "agent_id": "Agent",
    "campaign": "Project",
    "outcome": "Disposition",
    "call_type": "Category",
    "revenue": "Amount",
}


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event calls as an export of another system: text only, mixed notations, odd blanks."""
    c = event_calls(spark, sf_dir)
    i = F.col("call_id").cast("bigint")
    s = F.floor("duration").cast("int")
    clock = F.format_string("%d:%02d", F.floor(s / 60), s % 60)
    return c.select(
        "call_id",
        F.when(i % 3 == 0, F.date_format("timestamp", "MM/dd/yyyy HH:mm:ss"))
        .when(i % 3 == 1, F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"))
        .otherwise(F.date_format("timestamp", SECOND)).alias("timestamp"),
        F.when(i % 4 == 0, clock).otherwise(F.col("duration").cast("string")).alias("duration"),
        F.concat(F.lit("  "), "notes", F.lit(" ")).alias("notes"),
        F.concat(F.lit("(555) 01"), F.lpad("phone_number", 5, "0")).alias("phone_number"),
        "agent_id",
        "campaign",
        F.when(i % 5 != 0, F.col("outcome")).alias("outcome"),
        "call_type",
        F.col("revenue").cast("string").alias("revenue"),
    )


def headed(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(h) for c, h in HEADERS.items()])


RAW_SQL = """, raw AS (SELECT *, CAST(call_id AS BIGINT) AS i FROM calls)"""
CLEAN_SQL = """SELECT call_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp",
  CASE WHEN i % 4 = 0 THEN floor(duration) ELSE duration END AS duration, notes AS transcript,
  '55501' || lpad(phone_number, 5, '0') AS phone_number, agent_id, campaign,
  CASE WHEN i % 5 <> 0 THEN outcome ELSE 'unknown' END AS outcome, call_type, revenue FROM raw"""


def write_csv(spark: SparkSession, sf_dir: str, split: str | None = None) -> str:
    path = new_folder(spark, "csv")
    writer = headed(raw_calls(spark, sf_dir)).write.option("header", True).option("escape", '"')
    if split:
        writer = writer.partitionBy(split)
    writer.csv(path)
    return path


def shown(df: DataFrame) -> DataFrame:
    return df.select(
        "call_id", F.date_format("timestamp", SECOND).alias("timestamp"), "duration", "transcript", "phone_number",
        "agent_id", "campaign", "outcome", "call_type", F.col("revenue").cast("double").alias("revenue"),
    )


def entries():
    q = {}

    def add(name, run, sql):
        q[name] = (run, with_events(sql) if sql else None)

    def calls(name, run, sql, view=event_calls, wrap=with_events):
        q[name] = (lambda spark, sf, run=run: run(view(spark, sf)), wrap(sql) if sql else None)

    add("s1_csv_import", lambda spark, sf: shown(ing.import_table(ing.read_csv(spark, write_csv(spark, sf)))), RAW_SQL + CLEAN_SQL)
    add(
        "s1_csv_bad_rows",
        lambda spark, sf: _bad_rows(spark, sf),
        """ SELECT count(*) AS rows, count(*) FILTER (WHERE CAST(call_id AS BIGINT) % 6 = 0) AS bad_rows FROM calls""",
    )
    add(
        "s5_directory_results",
        lambda spark, sf: ing.file_results(ing.read_directory(spark, write_csv(spark, sf, "Project")))
        .groupBy(F.regexp_extract("file_path", "Project=([^/]+)/", 1).alias("project"))
        .agg(F.sum("rows").alias("rows"), F.sum("bad_rows").alias("bad_rows")),
        " SELECT campaign AS project, count(*) AS rows, 0::BIGINT AS bad_rows FROM calls GROUP BY 1",
    )
    add(
        "s7_file_inventory",
        lambda spark, sf: ing.size_by_suffix(ing.file_inventory(spark, write_csv(spark, sf), with_hash=True, glob="*.csv")),
        None,
    )
    add("s7_audio_rule", lambda spark, sf: ing.audio_rule(ing.file_inventory(spark, sf)).groupBy("suffix", "reason").agg(
        F.count(F.lit(1)).alias("files")), None)

    def multiline(spark, sf):
        path = new_folder(spark, "export")
        ex.export_csv(document_calls(spark, sf), path, "detailed")
        rows = ing.read_csv(spark, path)
        return rows.select("call_id", F.sha2("transcript", 256).alias("transcript"), "campaign", F.col(ing.CORRUPT).isNotNull().alias("bad"))

    q["s1_csv_multiline"] = (
        multiline, with_documents(" SELECT call_id, sha256(transcript) AS transcript, campaign, false AS bad FROM calls")
    )

    def latin(spark, sf):
        path = new_folder(spark, "csv")
        c = event_calls(spark, sf).select("call_id", F.concat("campaign", F.lit(" caf\u00e9")).alias("notes"))
        c.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
        return ing.read_csv(spark, path).drop(ing.CORRUPT)

    add("s1_charset_fallback", latin, " SELECT call_id, campaign || ' caf\u00e9' AS notes FROM calls")

    def mixed(spark, sf):
        """Three orders and namings of the columns, a file without text for every campaign and
        one without the required columns for every call type."""
        path, rows = new_folder(spark, "csv"), headed(raw_calls(spark, sf))
        third = F.pmod(F.xxhash64("Call ID"), F.lit(3))
        other = rows.select(*[F.col(c).alias({"Agent": "agent_id", "Amount": "Revenue"}.get(c, c)) for c in reversed(rows.columns)])
        for i, part in enumerate((rows, rows.select(*sorted(rows.columns)), other)):
            part.where(third == i).write.option("header", True).option("escape", '"').csv(f"{path}/layout={i}")
        kinds = rows.select("Project", "Category").distinct()
        once = lambda c: kinds.select(F.col(c).alias("of"), F.lit(" ").alias("Call ID")).distinct().coalesce(1).write.partitionBy("of")
        once("Category").option("header", True).csv(f"{path}/short")
        once("Project").options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(f"{path}/blank")
        return path

    add("s5_mixed_headers", lambda spark, sf: shown(ing.import_files(spark, mixed(spark, sf))[0]), RAW_SQL + CLEAN_SQL)
    add(
        "s5_file_errors",
        lambda spark, sf: ing.import_files(spark, mixed(spark, sf))[2].groupBy("error").agg(F.count_distinct("file_path").alias("files")),
        """ SELECT 'no header' AS error, count(DISTINCT campaign) AS files FROM calls
          UNION ALL SELECT 'missing required columns: timestamp, duration, transcript', count(DISTINCT call_type) FROM calls""",
    )

    def named(spark, sf):
        """Files below folders whose names hold pattern, blank, percent and quote characters."""
        path, rows = new_folder(spark, "csv"), headed(raw_calls(spark, sf))
        names = ["calls [1]", "calls [12]", "{a,b} calls", "50% of calls?", "all* calls", "it's é + \\d"]
        part = F.pmod(F.xxhash64("Call ID"), F.lit(len(names)))
        for i, name in enumerate(names):
            rows.where(part == i).write.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        return path

    add("s1_csv_names", lambda spark, sf: shown(ing.import_files(spark, named(spark, sf))[0]), RAW_SQL + CLEAN_SQL)

    def saved(spark, sf, fmt):
        root = new_folder(spark, "tables")
        st.save_table(event_calls(spark, sf), root, "calls", AS_OF, fmt)
        return st.load_table(spark, root, "calls")

    columns = "call_id, \"timestamp\", duration, phone_number, agent_id, campaign, outcome, call_type, revenue, notes"
    add("s3_load_parquet", lambda spark, sf: saved(spark, sf, "parquet"), f" SELECT {columns} FROM calls")
    add(
        "k1_save_csv",
        lambda spark, sf: saved(spark, sf, "csv").select("call_id", F.col("duration").cast("double").alias("duration"), "campaign"),
        " SELECT call_id, duration, campaign FROM calls",
    )

    def ranged(spark, sf):
        root = new_folder(spark, "tables")
        st.save_table(st.by_day(event_calls(spark, sf)), root, "calls", AS_OF, partition_by=["call_date"])
        return st.load_range(st.load_table(spark, root, "calls"), date(2024, 1, 8), date(2024, 1, 14)).drop("call_date")

    add(
        "s4_load_range",
        ranged,
        f""" SELECT {columns} FROM calls WHERE "timestamp" >= TIMESTAMP '2024-01-08 00:00:00'
          AND "timestamp" <= TIMESTAMP '2024-01-14 23:59:59.999999'""",
    )

    def two_imports(c):
        """A table without the busy calls, and an import of the inbound ones that repeats
        the sales calls with a correction and has no agent for the survey."""
        i = F.col("call_id").cast("bigint")
        old = c.where("outcome <> 'busy'").withColumn("batch_seq", F.lit(1)).withColumn("row_seq", i)
        again = c.where("call_type = 'inbound'").withColumn("batch_seq", F.lit(2)).withColumn("revenue", F.col("revenue") + 1)
        fixed = again.where("campaign = 'sales'").withColumn("row_seq", i + 10**15).withColumn("outcome", F.lit("corrected"))
        new = again.withColumn("row_seq", i).unionByName(fixed)
        return old, new.withColumn("agent_id", F.when(F.col("campaign") != "survey", F.col("agent_id")))

    upserted = """ SELECT call_id,
        CASE WHEN call_type = 'inbound' AND campaign = 'sales' THEN 'corrected' ELSE outcome END AS outcome,
        CASE WHEN call_type = 'inbound' THEN revenue + 1 ELSE revenue END AS revenue,
        CASE WHEN call_type = 'inbound' AND campaign = 'survey' THEN NULL ELSE agent_id END AS agent_id
      FROM calls WHERE outcome <> 'busy' OR call_type = 'inbound'"""
    calls(
        "k2_upsert",
        lambda c: st.upsert(*two_imports(c), "call_id", ["batch_seq", "row_seq"]).select("call_id", "outcome", "revenue", "agent_id"),
        upserted,
    )
    calls(
        "w12_keep_last",
        lambda c: st.latest(two_imports(c)[0].unionByName(two_imports(c)[1]), "call_id", ["batch_seq", "row_seq"]).select(
            "call_id", "outcome", "revenue", "agent_id"
        ),
        upserted,
    )
    def compacted(spark, sf):
        root = new_folder(spark, "batches")
        old, new = two_imports(event_calls(spark, sf))
        place = [F.lit("f").alias("file_path"), F.lit(0).cast("bigint").alias("file_block")]
        st.write_batch(old.drop("batch_seq").select("*", *place), root, 1)
        st.compact(spark, root, "calls", AS_OF)
        st.write_batch(new.drop("batch_seq").select("*", *place), root, 2)
        return st.current_calls(spark, root).select("call_id", "outcome", "revenue", "agent_id")

    add("k2_compact_then_import", compacted, upserted)
    calls(
        "k2_rows_added",
        lambda c: st.rows_added(*two_imports(c), "call_id"),
        " SELECT count(*) AS rows_added FROM calls WHERE outcome = 'busy' AND call_type = 'inbound'",
    )

    def snapshot(spark, sf):
        root = new_folder(spark, "tables")
        name = st.create_snapshot(event_calls(spark, sf), root, "calls", AS_OF)
        return st.load_snapshot(spark, root, name).groupBy("outcome").agg(F.count(F.lit(1)).alias("calls"))

    add("k3_snapshot", snapshot, " SELECT outcome, count(*) AS calls FROM calls GROUP BY 1")

    def snapshots(spark, sf):
        root = new_folder(spark, "tables")
        st.create_snapshot(event_calls(spark, sf), root, "calls", AS_OF)
        return st.list_snapshots(spark, root).select("name", "record_count")

    add("k3_list_snapshots", snapshots, " SELECT 'calls_20240215_120000' AS name, count(*) AS record_count FROM calls")
    for profile, cols, fmt in (
        ("standard", "call_id, phone_number, agent_id, campaign, outcome, duration, revenue, notes", "%Y-%m-%d %H:%M:%S"),
        ("summary", "call_id, outcome, duration, revenue", "%Y-%m-%d"),
        ("detailed", columns.replace('"timestamp", ', ""), "%Y-%m-%d %H:%M:%S"),
    ):
        calls(
            f"k4_export_{profile}",
            lambda c, profile=profile: ex.export_columns(c, profile),
            f""" SELECT {cols}, strftime("timestamp", '{fmt}') AS "timestamp" FROM calls""",
        )

    def exported(spark, sf):
        path = new_folder(spark, "export")
        ex.export_csv(document_calls(spark, sf), path, "detailed")
        back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
        return back.select("call_id", F.sha2("transcript", 256).alias("transcript"), "campaign")

    q["k4_export_round_trip"] = (
        exported,
        with_documents(" SELECT call_id, sha256(transcript) AS transcript, campaign FROM calls"),
    )

    def as_json(spark, sf):
        path = new_folder(spark, "json")
        ex.export_json(event_calls(spark, sf), path)
        return spark.read.schema("call_id string, timestamp string, duration double, notes string").json(path)

    add(
        "k5_export_json",
        as_json,
        """ SELECT call_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp", duration, notes FROM calls""",
    )

    def parts(spark, sf):
        path = new_folder(spark, "analytics")
        odd = order_calls(spark, sf).withColumn("campaign", F.concat("campaign", F.lit("/a?b")))
        ex.export_for_analytics(odd, path, "campaign")
        back = spark.read.option("header", True).csv(f"{path}/data")
        return back.groupBy(F.col("split_name").cast("string").alias("split_name")).agg(
            F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("revenue").cast("double")), 2).alias("revenue")
        )

    q["k6_export_split"] = (
        parts,
        with_orders(
            " SELECT campaign || '_a_b' AS split_name, count(*) AS calls, round(sum(revenue), 2) AS revenue FROM calls GROUP BY 1"
        ),
    )
    calls(
        "k6_export_metadata",
        lambda c: ex.export_metadata(c, "campaign"),
        """ SELECT count(*) AS total_records, strftime(min("timestamp"), '%Y-%m-%dT%H:%M:%S.%f') AS start,
          strftime(max("timestamp"), '%Y-%m-%dT%H:%M:%S.%f') AS "end",
          'call_id, timestamp, duration, phone_number, agent_id, campaign, outcome, call_type, revenue, notes' AS columns,
          count(DISTINCT campaign) AS parts FROM calls""",
    )
    num = lambda e: f"format('{{:.4f}}', round({e}, 4))"
    calls(
        "k7_summary",
        ex.summary,
        f""", k AS (SELECT count(*) AS n, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') || ' to ' ||
            strftime(max("timestamp"), '%Y-%m-%d %H:%M:%S') AS span, count(DISTINCT agent_id) AS a,
            count(DISTINCT campaign) AS c, count(DISTINCT outcome) AS o, count(DISTINCT call_type) AS t,
            avg(duration) AS d, sum(duration) / 3600 AS h, sum(revenue) AS r, avg(revenue) AS ar FROM calls)
          SELECT 'Total Calls' AS "Metric", CAST(n AS VARCHAR) AS "Value" FROM k UNION ALL SELECT 'Date Range', span FROM k
          UNION ALL SELECT 'Unique Agent Ids', CAST(a AS VARCHAR) FROM k UNION ALL SELECT 'Unique Campaigns', CAST(c AS VARCHAR) FROM k
          UNION ALL SELECT 'Unique Outcomes', CAST(o AS VARCHAR) FROM k UNION ALL SELECT 'Unique Call Types', CAST(t AS VARCHAR) FROM k
          UNION ALL SELECT 'Average Duration (seconds)', {num('d')} FROM k UNION ALL SELECT 'Total Duration (hours)', {num('h')} FROM k
          UNION ALL SELECT 'Total Revenue', {num('r')} FROM k UNION ALL SELECT 'Average Revenue', {num('ar')} FROM k
          UNION ALL SELECT 'Outcome: ' || outcome, CAST(count(*) AS VARCHAR) FROM calls GROUP BY outcome""",
    )

    def filtered(spark, sf):
        path = new_folder(spark, "filtered")
        ex.export_filtered(f.in_list(event_calls(spark, sf), "outcome", ["busy"]), path, "parquet")
        return spark.read.parquet(path).select("call_id", "outcome", "duration")

    add("k8_export_filtered", filtered, " SELECT call_id, outcome, duration FROM calls WHERE outcome = 'busy'")
    log = lambda c: c.groupBy(F.to_date("timestamp").alias("day"), "campaign").agg(
        F.count(F.lit(1)).alias("records_imported"),
        F.when(F.count_if(F.col("outcome") == "failed") > 12, "failed").otherwise("success").alias("status"),
    )
    calls(
        "k9_import_summary",
        lambda c: st.import_summary(log(c)),
        """, l AS (SELECT CAST("timestamp" AS DATE) AS day, campaign, count(*) AS n,
            count(*) FILTER (WHERE outcome = 'failed') > 12 AS bad FROM calls GROUP BY 1, 2)
          SELECT count(*) AS total_imports, CAST(sum(n) AS BIGINT) AS total_records,
            count(*) FILTER (WHERE NOT bad) AS successful, count(*) FILTER (WHERE bad) AS failed FROM l""",
    )
    calls(
        "k10_table_range",
        st.table_range,
        """ SELECT count(*) AS total_records, min("timestamp") AS earliest, max("timestamp") AS latest FROM calls""",
    )

    def statistics(spark, sf):
        root = new_folder(spark, "tables")
        st.save_table(event_calls(spark, sf), root, "calls", AS_OF)
        st.create_snapshot(event_calls(spark, sf), root, "calls", AS_OF)
        return st.storage_statistics(st.load_table(spark, root, "calls"), root)

    add("k10_storage_statistics", statistics, None)

    def faulty(c):
        i = F.col("call_id").cast("bigint")
        return c.select(
            F.when(i % 11 != 0, F.col("call_id")).alias("call_id"),
            F.when(i % 13 == 0, F.lit("soon")).otherwise(F.date_format("timestamp", SECOND)).alias("start_time"),
            F.when(i % 7 == 0, F.lit("long")).when(i % 5 == 0, F.concat(F.lit("-"), F.col("duration").cast("string")))
            .otherwise(F.col("duration").cast("string")).alias("duration_seconds"),
            F.when(i % 17 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "notes")).alias("transcript"),
            F.col("revenue").cast("string").alias("amount"),
            F.when(i % 3 == 0, F.lit("x")).otherwise(F.lit("2")).alias("quantity"),
            "agent_id",
        )

    fault = """, x AS (SELECT CAST(call_id AS BIGINT) AS i, * FROM calls),
      y AS (SELECT CASE WHEN i % 11 <> 0 THEN call_id END AS call_id,
        CASE WHEN i % 13 <> 0 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "timestamp",
        CASE WHEN i % 7 = 0 THEN NULL WHEN i % 5 = 0 THEN -duration ELSE duration END AS duration,
        CASE WHEN i % 17 = 0 THEN '  ' ELSE ' ' || notes END AS transcript, agent_id, revenue,
        CASE WHEN i % 3 <> 0 THEN 2::BIGINT END AS quantity FROM x),
      z AS (SELECT *, CASE WHEN call_id IS NULL THEN 'call_id missing' WHEN "timestamp" IS NULL THEN 'timestamp missing'
        WHEN duration IS NULL THEN 'duration missing' WHEN duration < 0 THEN 'duration negative'
        WHEN trim(transcript) = '' THEN 'transcript empty' END AS reason FROM y)"""
    stamp = lambda: F.date_format("timestamp", SECOND).alias("timestamp")
    calls(
        "p5_typed_calls",
        lambda c: typed_calls(faulty(c)).select(
            "call_id", F.date_format("timestamp", SECOND).alias("timestamp"), "duration", "transcript", "agent_id",
            "revenue", "amount", "quantity", "campaign",
        ),
        fault + """ SELECT call_id, "timestamp", duration, transcript, agent_id, revenue, revenue AS amount, quantity,
          CAST(NULL AS VARCHAR) AS campaign FROM y""",
    )
    calls(
        "p6_record_rules",
        lambda c: record_rules(typed_calls(faulty(c))).select(
            "call_id", F.date_format("timestamp", SECOND).alias("timestamp"), "duration", "transcript", "reason"
        ),
        fault + """ SELECT call_id, "timestamp", duration, trim(transcript) AS transcript, reason FROM z""",
    )
    calls(
        "k11_error_report",
        lambda c: ing.error_report(record_rules(typed_calls(faulty(c)))),
        fault + " SELECT reason, count(*) AS count FROM z WHERE reason IS NOT NULL GROUP BY 1",
    )
    add(
        "p3_standardise_default_patterns",
        lambda spark, sf: ing.standardise(headed(raw_calls(spark, sf)), fields=None, strict=False).select(
            "call_id", "timestamp", "duration", "agent_id", "campaign", "outcome", "notes", "revenue", "phone_number",
            "customer_name",
        ).agg(
            *[F.count(c).alias(c) for c in ("call_id", "timestamp", "duration", "agent_id", "campaign", "outcome", "notes",
                                            "revenue", "phone_number", "customer_name")]
        ),
        RAW_SQL + """ SELECT count(*) AS call_id, count(*) AS "timestamp", count(*) AS duration, count(*) AS agent_id,
          count(*) AS campaign, count(*) FILTER (WHERE i % 5 <> 0) AS outcome, count(*) AS notes, count(*) AS revenue,
          count(*) AS phone_number, 0::BIGINT AS customer_name FROM raw""",
    )
    add(
        "p7_parse_dates",
        lambda spark, sf: ing.parse_dates(raw_calls(spark, sf)).select("call_id", stamp()),
        """ SELECT call_id, strftime("timestamp", '%Y-%m-%d %H:%M:%S') AS "timestamp" FROM calls""",
    )
    calls(
        "p7_parse_dates_whole_column",
        lambda c: ing.parse_dates(
            c.select("call_id", F.date_format("timestamp", "MM/dd/yyyy").alias("timestamp")), whole_column=True
        ).select("call_id", stamp()),
        """ SELECT call_id, strftime("timestamp", '%Y-%m-%d 00:00:00') AS "timestamp" FROM calls""",
    )
    i = lambda: F.col("call_id").cast("bigint")
    forms = ["yyyy/MM/dd HH:mm:ss", "yyyyMMdd", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "'on' yyyy"]

    def flexible(c):
        text = F.lit(None).cast("string")
        for n, form in enumerate(forms):
            text = F.when(i() % len(forms) == n, F.date_format("timestamp", form)).otherwise(text)
        return c.select(
            "call_id", F.date_format(p.flexible_timestamp(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"),
            F.date_format(p.flexible_timestamp(text, zone="America/New_York"), SECOND).alias("in_utc"),
        )

    calls(
        "p8_flexible_timestamp",
        flexible,
        """, x AS (SELECT call_id, CASE CAST(call_id AS BIGINT) % 5 WHEN 0 THEN date_trunc('second', "timestamp")
            WHEN 1 THEN date_trunc('day', "timestamp") WHEN 2 THEN
              CASE WHEN day("timestamp") <= 12 THEN date_trunc('second', "timestamp")
                - to_days(CAST(date_diff('day', make_date(year("timestamp"), day("timestamp"), month("timestamp")),
                    CAST("timestamp" AS DATE)) AS INT)) ELSE date_trunc('second', "timestamp") END
            WHEN 3 THEN "timestamp" END AS t FROM calls)
          SELECT call_id, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS parsed,
            strftime(t + CASE WHEN (t >= TIMESTAMP '2024-03-10 02:00:00' AND t < TIMESTAMP '2024-11-03 01:00:00')
              THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%d %H:%M:%S') AS in_utc FROM x""",
    )
    calls(
        "p9_duration_parse",
        lambda c: c.select(
            "call_id",
            p.duration_seconds(
                F.when(i() % 4 == 0, F.format_string("%d:%02d", F.floor("duration").cast("int"), (i() % 60).cast("int")))
                .when(i() % 4 == 1, F.format_string("%d:%02d:%02d", (i() % 9).cast("int"), (i() % 60).cast("int"), (i() % 59).cast("int")))
                .when(i() % 4 == 2, F.col("duration").cast("string"))
            ).alias("seconds"),
        ),
        """, x AS (SELECT CAST(call_id AS BIGINT) AS i, * FROM calls) SELECT call_id, CAST(CASE i % 4
            WHEN 0 THEN floor(duration) * 60 + i % 60 WHEN 1 THEN i % 9 * 3600 + i % 60 * 60 + i % 59
            WHEN 2 THEN duration ELSE 0 END AS DOUBLE) AS seconds FROM x""",
    )
    add(
        "p10_clean",
        lambda spark, sf: ing.clean(raw_calls(spark, sf).unionByName(raw_calls(spark, sf))).select(
            "call_id", "duration", "notes", "phone_number", "outcome"
        ),
        RAW_SQL + """ SELECT call_id, CASE WHEN i % 4 = 0 THEN floor(duration) ELSE duration END AS duration, notes,
          '55501' || lpad(phone_number, 5, '0') AS phone_number,
          CASE WHEN i % 5 <> 0 THEN outcome ELSE 'unknown' END AS outcome FROM raw""",
    )
    number = lambda: F.concat(F.lit("(555) 0"), F.lpad("call_id", 6, "0"), F.when(i() % 3 == 0, "9").otherwise(""))
    calls(
        "p11_phones",
        lambda c: c.select("call_id", p.phone_e164(number()).alias("e164"), p.phone_display(number()).alias("shown")),
        """, x AS (SELECT call_id, '5550' || lpad(call_id, 6, '0') || CASE WHEN CAST(call_id AS BIGINT) % 3 = 0
            THEN '9' ELSE '' END AS d, '(555) 0' || lpad(call_id, 6, '0') || CASE WHEN CAST(call_id AS BIGINT) % 3 = 0
            THEN '9' ELSE '' END AS raw FROM calls)
          SELECT call_id, CASE WHEN length(d) = 10 THEN '+1' || d ELSE '+' || d END AS e164,
            CASE WHEN length(d) = 10 THEN '+1 (' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] ELSE raw END AS shown FROM x""",
    )

    def audio(c):
        return c.select(
            F.when(i() % 9 == 0, "").otherwise(F.concat(F.lit("Call_"), "call_id", F.lit(".WAV"))).alias("audio_file"),
            F.concat(F.lit("M"), "call_id").alias("call_id"),
            F.when(i() % 8 == 0, "yesterday").otherwise(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"),
            F.when(i() % 7 == 0, "n/a").when(i() % 5 == 0, "").otherwise(F.col("duration").cast("string")).alias("duration_seconds"),
            F.col("revenue").cast("string").alias("revenue"), "campaign",
        )

    audio_sql = """, x AS (SELECT CAST(call_id AS BIGINT) AS i, * FROM calls),
      m AS (SELECT i, 'call_' || call_id || '.wav' AS file_key, 'M' || call_id AS call_id,
        CASE WHEN i % 8 <> 0 THEN strftime("timestamp", '%Y-%m-%d %H:%M:%S') END AS "timestamp",
        CASE WHEN i % 8 = 0 THEN 'yesterday' END AS timestamp_text,
        CASE WHEN i % 7 = 0 OR i % 5 = 0 THEN NULL ELSE duration END AS duration_seconds, revenue, campaign,
        i % 8 = 0 OR i % 7 = 0 AS dirty FROM x WHERE i % 9 <> 0)"""
    calls(
        "s6_audio_metadata",
        lambda c: ing.audio_metadata(audio(c)).select(
            "file_key", "call_id", stamp(), "timestamp_text", "duration_seconds", "revenue", "dirty"
        ),
        audio_sql + ' SELECT file_key, call_id, "timestamp", timestamp_text, duration_seconds, revenue, dirty FROM m',
    )

    def joined(spark, sf):
        d = table(spark, sf, "documents")
        spoken = d.select(
            F.concat(F.lit("call_"), F.col("doc_id").cast("string"), F.lit(".wav")).alias("file"),
            F.col("text").alias("transcript"), (F.col("n_chars") / 15.0).alias("duration_seconds"),
        )
        out = ing.transcript_records(
            spoken, ing.audio_metadata(audio(event_calls(spark, sf))), {"campaign": "none", "channel": "voice"}, AS_OF
        )
        return rounded(
            out.select("call_id", "phone_number", stamp(), "duration", "duration_minutes", "campaign", "channel", "revenue"),
            "duration", "duration_minutes",
        )

    add(
        "p12_transcript_records",
        joined,
        audio_sql + """ SELECT coalesce(m.call_id, 'audio_20240215_120000_call_' || doc_id || '.wav') AS call_id,
          'unknown' AS phone_number, coalesce("timestamp", '2024-02-15 12:00:00') AS "timestamp",
          round(coalesce(nullif(duration_seconds, 0), n_chars / 15.0), 6) AS duration,
          round(coalesce(nullif(duration_seconds, 0), n_chars / 15.0) / 60, 6) AS duration_minutes,
          coalesce(campaign, 'none') AS campaign, 'voice' AS channel, revenue
          FROM documents LEFT JOIN m ON m.file_key = 'call_' || doc_id || '.wav'""",
    )
    add(
        "o4_union_by_name",
        lambda spark, sf: event_calls(spark, sf)
        .unionByName(order_calls(spark, sf), allowMissingColumns=True)
        .groupBy("outcome")
        .agg(F.count(F.lit(1)).alias("rows"), F.count("notes").alias("with_notes")),
        """, o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'connected' WHEN 'O' THEN 'no_answer' ELSE 'voicemail' END
            AS outcome, NULL AS notes FROM orders)
          SELECT outcome, count(*) AS rows, count(notes) AS with_notes FROM
            (SELECT outcome, notes FROM calls UNION ALL SELECT outcome, notes FROM o) GROUP BY 1""",
    )
    calls(
        "o5_distinct_rows",
        lambda c: ing.drop_repeats(c.select("phone_number", "agent_id", "campaign", "outcome")),
        " SELECT DISTINCT phone_number, agent_id, campaign, outcome FROM calls",
    )

    def streamed(spark, sf):
        root, state = new_folder(spark, "stream"), new_folder(spark, "state")
        source = write_csv(spark, sf)
        stream.import_stream(stream.stream_csv(spark, source, list(HEADERS.values())), root, state).awaitTermination()
        return shown(st.current_calls(spark, root))

    add("r1_stream_import", streamed, RAW_SQL + CLEAN_SQL)

    def mixed_stream(spark, sf):
        root, state = new_folder(spark, "stream"), new_folder(spark, "state")
        rows = stream.stream_csv(spark, mixed(spark, sf), list(HEADERS.values()))
        stream.import_stream(rows, root, state).awaitTermination()
        return shown(st.current_calls(spark, root))

    add("r1_stream_mixed_headers", mixed_stream, RAW_SQL + CLEAN_SQL)

    def bad_stream(spark, sf):
        root, state, path = new_folder(spark, "stream"), new_folder(spark, "state"), new_folder(spark, "csv")
        c = event_calls(spark, sf)
        i = F.col("call_id").cast("bigint")
        line = F.concat_ws(",", "call_id", F.date_format("timestamp", SECOND), F.when(i % 6 == 0, "1,2,3").otherwise("12"), F.lit("text"))
        c.select(line.alias("Call ID,Start Time,Duration,Notes")).write.option("header", True).option("quote", "").csv(path)
        stream.import_stream(stream.stream_csv(spark, path, ["Call ID"]), root, state).awaitTermination()
        bad = spark.read.parquet(f"{root}/rejected").agg(F.count("row").alias("bad_rows"))
        return st.current_calls(spark, root).agg(F.count(F.lit(1)).alias("rows")).join(bad)

    add(
        "r1_stream_bad_rows",
        bad_stream,
        """ SELECT count(*) FILTER (WHERE CAST(call_id AS BIGINT) % 6 <> 0) AS rows,
          count(*) FILTER (WHERE CAST(call_id AS BIGINT) % 6 = 0) AS bad_rows FROM calls""",
    )

    def corrected(spark, sf):
        root, state = new_folder(spark, "stream"), new_folder(spark, "state")
        first, late = write_csv(spark, sf), new_folder(spark, "csv")
        fix = raw_calls(spark, sf).where("call_type = 'inbound'").withColumn("outcome", F.lit("corrected"))
        headed(fix).write.option("header", True).option("escape", '"').csv(late)
        names = list(HEADERS.values())
        stream.import_stream(stream.stream_csv(spark, first, names), root, f"{state}/a").awaitTermination()
        stream.import_stream(
            stream.stream_csv(spark, late, names), root, f"{state}/b", first_batch=1000
        ).awaitTermination()
        return st.current_calls(spark, root).select("call_id", "outcome", "batch_seq")

    add(
        "r2_stream_last_write_wins",
        lambda spark, sf: corrected(spark, sf).select("call_id", "outcome", (F.col("batch_seq") >= 1000).alias("late")),
        RAW_SQL + """ SELECT call_id, CASE WHEN call_type = 'inbound' THEN 'corrected' WHEN i % 5 <> 0 THEN outcome ELSE 'unknown' END
          AS outcome, call_type = 'inbound' AS late FROM raw""",
    )
    def late_batch(spark, sf):
        """Batches 10 and 20 are folded; then batch 15 arrives, and batch 20 again with other rows."""
        root, i = new_folder(spark, "tables"), F.col("call_id").cast("bigint")
        place = [F.lit("f").alias("file_path"), F.lit(0).alias("file_block"), F.lit(0).alias("row_seq")]
        calls = event_calls(spark, sf).select("call_id", "timestamp", "outcome", *place)
        st.write_batch(calls, root, 10)
        st.write_batch(calls.where(i % 5 == 0).withColumn("outcome", F.lit("corrected")), root, 20)
        st.compact(spark, root, "calls", AS_OF)
        st.write_batch(calls.where(i % 3 == 0).withColumn("outcome", F.lit("late")), root, 15)
        st.write_batch(calls.where(i % 10 == 0).withColumn("outcome", F.lit("again")), root, 20)
        return st.current_calls(spark, root).select("call_id", "outcome", F.col("batch_seq").cast("int").alias("batch_seq"))

    add(
        "r2_late_batch",
        late_batch,
        RAW_SQL + """ SELECT call_id, CASE WHEN i % 10 = 0 THEN 'again' WHEN i % 3 = 0 THEN 'late' ELSE outcome END AS outcome,
          CASE WHEN i % 10 = 0 THEN 20 WHEN i % 3 = 0 THEN 15 ELSE 10 END AS batch_seq FROM raw""",
    )
    window_sql = """ SELECT strftime(date_trunc('hour', "timestamp"), '%Y-%m-%d %H:%M:%S') AS window_start, agent_id,
        count(call_id) AS calls, count(*) FILTER (WHERE outcome = 'connected') AS connected_calls,
        round(avg(duration), 6) AS avg_duration, round(sum(revenue), 2) AS total_revenue FROM calls"""
    tidy = lambda d: rounded(
        rounded(d.withColumn("window_start", F.date_format("window_start", SECOND)), "avg_duration"), "total_revenue", digits=2
    )
    calls("r3_window_kpis", lambda c: tidy(stream.window_kpis(c)), window_sql + " GROUP BY 1, 2")

    def refreshed(spark, sf):
        """A rollup taken through three batches: half of the calls, the rest with corrections, a late one."""
        root, i = new_folder(spark, "tables"), F.col("call_id").cast("bigint")
        place = [F.lit("f").alias("file_path"), F.lit(0).alias("file_block"), F.lit(0).alias("row_seq")]
        calls = event_calls(spark, sf).select("call_id", "timestamp", "outcome", "duration", "revenue", "agent_id", *place)
        moved = calls.where(i % 5 == 0).withColumn("agent_id", F.lit("moved")).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 40 DAYS"))
        late = calls.where(i % 3 == 0).withColumn("outcome", F.lit("connected")).withColumn("revenue", F.lit(2.5))
        for number, rows in ((10, calls.where(i % 2 == 0)), (30, calls.where(i % 2 == 1).unionByName(moved.where(i % 2 == 0))), (20, late)):
            st.write_batch(rows, root, number)
            rollups.refresh_rollup(spark, root, "hourly")
        return root

    # the last batch wins per call: 30 has odd calls as they are and even multiples of 5 moved, 20 the other multiples of 3
    refreshed_sql = """, now AS (SELECT call_id, CASE WHEN i % 10 = 0 THEN "timestamp" + INTERVAL 40 DAY ELSE "timestamp" END AS "timestamp",
        CASE WHEN i % 6 = 0 AND i % 10 <> 0 THEN 'connected' ELSE outcome END AS outcome, duration,
        CASE WHEN i % 6 = 0 AND i % 10 <> 0 THEN 2.5 ELSE revenue END AS revenue,
        CASE WHEN i % 10 = 0 THEN 'moved' ELSE agent_id END AS agent_id
      FROM (SELECT *, CAST(call_id AS BIGINT) AS i FROM calls))"""
    exact = "round(CAST(sum(CAST(duration AS DECIMAL(38, 9))) AS DOUBLE) / count(duration), 6) AS avg_duration"
    add(
        "r3_rollup_kpis",
        lambda spark, sf: tidy(rollups.rollup_kpis(spark, refreshed(spark, sf), "hourly")),
        refreshed_sql + window_sql.replace("FROM calls", "FROM now").replace("round(avg(duration), 6) AS avg_duration", exact) + " GROUP BY 1, 2",
    )
    for period, unit in rollups.PERIODS.items():
        add(
            f"a10_rollup_trends_{period}",
            lambda spark, sf, period=period: rounded(
                rounded(rollups.rollup_trends(spark, refreshed(spark, sf), "hourly", period), "connection_rate", "avg_duration"), "total_revenue", digits=2
            ),
            refreshed_sql + f""" SELECT strftime(date_trunc('{unit}', "timestamp"), '%Y-%m-%d') AS period, count(call_id) AS calls,
              round(count(*) FILTER (WHERE outcome = 'connected') * 100.0::DOUBLE / count(*), 6) AS connection_rate,
              {exact}, round(sum(revenue), 2) AS total_revenue FROM now GROUP BY 1""",
        )

    def kpis(spark, sf):
        path, state = new_folder(spark, "kpi"), new_folder(spark, "state")
        source = new_folder(spark, "events")
        batch = event_calls(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        batch.write.parquet(source)
        rows = spark.readStream.schema(batch.schema).parquet(source)
        stream.kpi_stream(rows, path, state).awaitTermination()
        return tidy(spark.read.parquet(path))

    add(
        "r3_stream_kpis",
        kpis,
        window_sql + """ WHERE date_trunc('hour', "timestamp") + INTERVAL 1 HOUR <=
          (SELECT max("timestamp") - INTERVAL 1 HOUR FROM calls) GROUP BY 1, 2""",
    )
    return q


def _bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "csv")
    c = event_calls(spark, sf_dir).select("call_id", "outcome", "duration")
    i = F.col("call_id").cast("bigint")
    line = F.concat_ws(",", "call_id", "outcome", F.when(i % 6 == 0, "1,2,3").otherwise(F.col("duration").cast("string")))
    c.select(line.alias("call_id,outcome,duration")).write.option("header", True).option("quote", "").csv(path)
    rows = ing.read_csv(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("rows"), ing.bad_row_count(rows).alias("bad_rows"))
