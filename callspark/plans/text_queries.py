"""Registered text queries: T1 to T14."""

from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from ..functions import formats as fm
from ..functions.fixed_values import ENTITY_PATTERNS, MASKS, STOP_WORDS
from ..operators import text as t
from ..operators.compare import compare_groups
from .rounding import rounded
from .views import (
    SQL_BLANK,
    event_calls,
    order_calls,
    sql_round,
    sql_strip,
    sql_words,
    table,
    with_events,
    with_orders,
)

# The accented letters of the text tables, for the SQL side, which has no NFKD.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"


def _sql_nfkd(text: str) -> str:
    for letter in LETTERS:
        plain = unicodedata.normalize("NFKD", letter)
        if plain != letter:
            marks = " || ".join(f"chr({ord(c)})" for c in plain)
            text = f"replace({text}, '{letter}', {marks})"
    return text


def _sql_single_byte(text: str) -> str:
    """Map each accented letter to one unused control character."""
    codes = [*range(1, 9), *range(14, 32)][: len(LETTERS)]
    return f"translate({text}, '{LETTERS}', {' || '.join(f'chr({c})' for c in codes)})"


def _sql_clean(text: str, punctuation=False, lowercase=False, numbers=False) -> str:
    out = f"trim(regexp_replace({_sql_nfkd(text)}, '{SQL_BLANK}+', ' ', 'g'), ' ')"
    if lowercase:
        out = f"lower({out})"
    if punctuation:
        out = f"translate({out}, '{t.PUNCTUATION.replace(chr(39), chr(39) * 2)}', '')"
    if numbers:
        out = f"regexp_replace({out}, '\\p{{Nd}}+', '', 'g')"
    return sql_strip(out)


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def entries():
    q = {}

    def docs(name, run, sql, source="documents"):
        q[name] = (lambda spark, sf, run=run: run(table(spark, sf, source)), sql)

    docs(
        "t1_clean_text",
        lambda d: d.select(
            "doc_id",
            F.sha2(t.clean_text(F.col("text")), 256).alias("plain"),
            F.sha2(t.clean_text(F.col("text"), True, True, True), 256).alias("bare"),
        ),
        f"SELECT doc_id, sha256({_sql_clean('text')}) AS plain, "
        f"sha256({_sql_clean('text', True, True, True)}) AS bare FROM documents",
    )
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    keyed = f"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM
        (SELECT doc_id, {sql_words(_sql_clean('text', True, True))} AS ws FROM documents)),
      k AS (SELECT * FROM w WHERE length(word) >= 4 AND word NOT IN ({stop}))"""
    docs(
        "t2_keywords",
        lambda d: t.keywords(d, "doc_id", "text", 5, 4),
        f"""{keyed}, c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM k GROUP BY 1, 2),
          r AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS INT) AS rank FROM c)
          SELECT doc_id, rank, word, n FROM r WHERE rank <= 5""",
    )
    docs(
        "t2_corpus_keywords",
        lambda d: t.corpus_keywords(d, "text", 25, 4),
        f"{keyed} SELECT word, count(*) AS n FROM k GROUP BY word ORDER BY n DESC, word LIMIT 25",
    )
    split = {
        "word": sql_words("text"),
        "sentence": f"list_filter(list_transform(string_split_regex(text, '[.!?]+'), lambda s: {sql_strip('s')}),"
        " lambda s: s <> '')",
        "paragraph": f"list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda s: {sql_strip('s')}),"
        " lambda s: s <> '')",
    }
    for method, expr in split.items():
        docs(
            f"t3_tokens_{method}",
            lambda d, method=method: t.tokens(d, "doc_id", "text", method)
            .groupBy("doc_id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.max("pos").alias("last_pos"),
                F.sum(F.length("token") * (F.col("pos") % 97 + 1)).alias("weight"),
            ),
            f"""WITH w AS (SELECT doc_id, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM
                (SELECT doc_id, {expr} AS ws FROM documents))
              SELECT doc_id, count(*) AS n, CAST(max(pos) AS INT) AS last_pos,
                CAST(sum(length(token) * (pos % 97 + 1)) AS BIGINT) AS weight FROM w GROUP BY doc_id""",
        )
    docs(
        "t4_text_statistics",
        lambda d: t.text_statistics(d, "doc_id", "text"),
        f"""WITH p AS (SELECT doc_id, text, {split['word']} AS w, len({split['sentence']}) AS s FROM documents),
          c AS (SELECT doc_id, length(text) AS chars, len(w) AS n, s,
            coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS letters,
            len(list_distinct(list_transform(w, lambda x: lower(x)))) AS u FROM p)
          SELECT doc_id, CAST(chars AS INT) AS character_count, CAST(n AS INT) AS word_count,
            CAST(s AS INT) AS sentence_count,
            CASE WHEN n > 0 THEN {sql_round('letters / CAST(n AS DOUBLE)', 2)} ELSE 0 END AS average_word_length,
            CASE WHEN s > 0 THEN {sql_round('n / CAST(s AS DOUBLE)', 2)} ELSE 0 END AS average_sentence_length,
            CAST(u AS INT) AS unique_words,
            CASE WHEN n > 0 THEN {sql_round('u / CAST(n AS DOUBLE)', 3)} ELSE 0 END AS lexical_diversity FROM c""",
    )
    patterns = {
        "intl_phone": r"\+\d \(\d{3}\) \d{3}-\d{4}",
        "digits": r"\b\d{3,}\b",
        "mail_host": r"@([a-z0-9.]+)",
        "broken": "(unclosed",
        "licence": "license",
    }
    hits = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, {_q('(?i)' + p)}, "
        f"{1 if k == 'mail_host' else 0})) AS match FROM documents"
        for k, p in patterns.items() if k != "broken"
    )
    docs(
        "t5_pattern_hits",
        lambda d: t.pattern_hits(d, "doc_id", "text", patterns).select("doc_id", "kind", "match"),
        hits,
    )
    extra = {"intl_phones": patterns["intl_phone"]}
    for source, key, col in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
        sql = " UNION ALL ".join(
            f"SELECT {key}, '{k}' AS kind, unnest(regexp_extract_all({col}, {_q(p)})) AS match FROM {source}"
            for k, p in {**ENTITY_PATTERNS, **extra}.items()
        )
        docs(
            f"t6_entities_{source}",
            lambda d, key=key, col=col: t.entities(d, key, col, extra).select(key, "kind", "match"),
            sql,
            source,
        )
        docs(
            f"t6_entity_counts_{source}",
            lambda d, key=key, col=col: t.entity_counts(d, key, col, extra),
            f"SELECT kind, count(*) AS hits FROM ({sql}) GROUP BY kind",
            source,
        )
    more = [("intl_phone", patterns["intl_phone"], "[PHONE]")]
    masked, counts = "text", []
    for kind, pattern, mark in [*MASKS, *more]:
        counts.append(
            f"SELECT '{kind}' AS kind, CAST(sum(len(regexp_extract_all({masked}, {_q(pattern)}))) AS BIGINT)"
            " AS masked FROM documents"
        )
        masked = f"regexp_replace({masked}, {_q(pattern)}, '{mark}', 'g')"
    docs(
        "t7_mask_pii",
        lambda d: d.select("doc_id", F.sha2(t.mask_pii(F.col("text"), more), 256).alias("masked")),
        f"SELECT doc_id, sha256({masked}) AS masked FROM documents",
    )
    docs("t7_masked_counts", lambda d: t.masked_counts(d, "text", more), " UNION ALL ".join(counts))

    def cut(length, suffix, keep):
        room = length - len(suffix)
        head = f"substring(text, 1, {room})"
        at = f"(length({head}) - strpos(reverse({head}), ' '))"
        found = f"strpos({head}, ' ') > 0" if keep == 0 else f"strpos({head}, ' ') > 0 AND {at} > {room * keep}"
        return (
            f"CASE WHEN length(text) <= {length} THEN text ELSE "
            f"CASE WHEN {found} THEN substring({head}, 1, {at}) ELSE {head} END || '{suffix}' END"
        )

    docs(
        "t8_truncate",
        lambda d: d.select(
            "doc_id",
            t.truncate(F.col("text"), 80).alias("any_blank"),
            t.truncate(F.col("text"), 100, " [more]", 0.8).alias("late_blank"),
        ),
        f"SELECT doc_id, {cut(80, '...', 0)} AS any_blank, {cut(100, ' [more]', 0.8)} AS late_blank FROM documents",
    )
    docs(
        "t9_highlight",
        lambda d: d.select(
            "doc_id", F.sha2(t.highlight(F.col("text"), ["the", "thing", "a+b"]), 256).alias("marked")
        ),
        """SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text,
            '(?i)(thing)', '<mark>\\1</mark>', 'g'), '(?i)(the)', '<mark>\\1</mark>', 'g'),
            '(?i)(a\\+b)', '<mark>\\1</mark>', 'g')) AS marked FROM documents""",
    )

    def turns(spark, sf):
        c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
        nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
        pairs = c.join(nxt, ["conv_id", "turn"])
        out = t.pair_similarity(pairs, "text", "reply", ["jaccard", "cosine", "levenshtein"])
        return rounded(out.drop("text", "reply"), "jaccard", "cosine", "levenshtein")

    one_byte = _sql_single_byte
    q["t10_pair_similarity"] = (
        turns,
        f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a
            JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
          w AS (SELECT *, {sql_words('lower(x)')} AS wx, {sql_words('lower(y)')} AS wy FROM p),
          cx AS (SELECT conv_id, turn, word, count(*) AS n FROM
            (SELECT conv_id, turn, unnest(wx) AS word FROM w) GROUP BY ALL),
          cy AS (SELECT conv_id, turn, word, count(*) AS n FROM
            (SELECT conv_id, turn, unnest(wy) AS word FROM w) GROUP BY ALL),
          d AS (SELECT conv_id, turn, sum(cx.n * cy.n) AS dot FROM cx JOIN cy USING (conv_id, turn, word) GROUP BY ALL),
          nx AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS v FROM cx GROUP BY ALL),
          ny AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS v FROM cy GROUP BY ALL)
          SELECT w.conv_id, w.turn,
            round(len(list_intersect(list_distinct(wx), list_distinct(wy)))
              / CAST(len(list_distinct(list_concat(wx, wy))) AS DOUBLE), 6) AS jaccard,
            round(coalesce(dot, 0) / (nx.v * ny.v), 6) AS cosine,
            round(1 - levenshtein({one_byte('x')}, {one_byte('y')})
              / CAST(greatest(length(x), length(y)) AS DOUBLE), 6) AS levenshtein
          FROM w LEFT JOIN d USING (conv_id, turn) JOIN nx USING (conv_id, turn) JOIN ny USING (conv_id, turn)""",
    )
    docs(
        "t11_transcript_quality",
        lambda d: t.transcript_quality(d, "text").select("doc_id", "valid", "reason"),
        f"""WITH w AS (SELECT doc_id, len({split['word']}) AS n, len(list_distinct({split['word']})) AS d FROM documents),
          r AS (SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n < 20 THEN 'too short'
            WHEN d < n * 0.2 THEN 'repetitive' END AS reason FROM w)
          SELECT doc_id, reason IS NULL AS valid, reason FROM r""",
    )
    docs(
        "t12_assemble_transcripts",
        lambda c: t.assemble_transcripts(c, "conv_id", "turn", "text", number="turn").select(
            "conv_id", F.sha2("transcript", 256).alias("transcript"), "n_segments",
            F.round("confidence", 6).alias("confidence"),
        ),
        f"""SELECT conv_id, sha256(string_agg({sql_strip('text')}, ' ' ORDER BY turn)) AS transcript,
          CAST(count(*) AS INT) AS n_segments, 0.95::DOUBLE AS confidence FROM conversations
          WHERE {sql_strip('text')} <> '' GROUP BY conv_id""",
        "conversations",
    )

    def report(c):
        reference = F.lit("2024-02-15 12:00:00").cast("timestamp_ntz")
        secs = F.floor(F.col("duration") * 40)
        return c.select(
            "call_id",
            fm.duration_text(secs, "clock").alias("clock"),
            fm.duration_text(secs, "short").alias("short"),
            fm.duration_text(secs, "human").alias("human"),
            fm.metric_duration(secs).alias("metric"),
            fm.bytes_text(F.floor(F.col("duration") * F.col("duration") * 97)).alias("size"),
            fm.percent_text(F.col("duration") / 400, 1, True).alias("percent"),
            fm.currency_text(F.col("duration") * 1000).alias("dollars"),
            fm.currency_text(F.col("duration") * 1000, "JPY").alias("yen"),
            fm.time_ago(F.col("timestamp"), reference).alias("age"),
            fm.money_or_dash(F.col("revenue")).alias("revenue"),
            fm.list_text(F.split("agent_id", ""), 4).alias("letters"),
            fm.metric_text(F.col("duration") * 1000).alias("number"),
            fm.delta_text(F.col("duration") - 40, "currency").alias("delta"),
        )

    f1 = lambda e, d: f"format('{{:,.{d}f}}', {sql_round(e, d)})"
    plain = lambda e, d: f"format('{{:.{d}f}}', {sql_round(e, d)})"
    unit = lambda v, u: f"({v} || ' {u}' || CASE WHEN {v} = 1 THEN '' ELSE 's' END)"
    size = "CASE WHEN b < 1024 THEN b || ' B' " + " ".join(
        f"WHEN b < {1024 ** (i + 1)} THEN {plain(f'b / {1024.0 ** i}::DOUBLE', 2)} || ' {u}'"
        for i, u in enumerate(("KB", "MB", "GB"), start=1)
    ) + " END"
    q["t13_report_columns"] = (
        lambda spark, sf: report(event_calls(spark, sf)),
        with_events(
            f""", k AS (SELECT *, CAST(floor(duration * 40) AS BIGINT) AS s,
                CAST(floor(duration * duration * 97) AS BIGINT) AS b,
                epoch_us(TIMESTAMP '2024-02-15 12:00:00') - epoch_us("timestamp") AS us FROM calls),
              v AS (SELECT *, s // 3600 AS h, s % 3600 // 60 AS m, s % 60 AS x, us // 1000000 // 86400 AS days FROM k)
              SELECT call_id,
                CASE WHEN h > 0 THEN format('{{:02d}}:{{:02d}}:{{:02d}}', h, m, x) ELSE format('{{:02d}}:{{:02d}}', m, x) END AS clock,
                CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN m || 'm' || CASE WHEN x > 0 THEN ' ' || x || 's' ELSE '' END
                  ELSE h || 'h' || CASE WHEN m > 0 THEN ' ' || m || 'm' ELSE '' END END AS short,
                CASE WHEN s < 60 THEN {unit('s', 'second')}
                  WHEN s < 3600 THEN {unit('m', 'minute')} || CASE WHEN x > 0 THEN ' ' || {unit('x', 'second')} ELSE '' END
                  ELSE {unit('h', 'hour')} || CASE WHEN m > 0 THEN ' ' || {unit('m', 'minute')} ELSE '' END END AS human,
                CASE WHEN h > 0 THEN h || 'h ' || m || 'm' WHEN m > 0 THEN m || 'm ' || x || 's' ELSE x || 's' END AS metric,
                {size} AS size,
                CASE WHEN duration > 0 THEN '+' ELSE '' END || {plain('duration / 400 * 100', 1)} || '%' AS percent,
                '$' || {f1('duration * 1000', 2)} AS dollars, '¥' || {f1('duration * 1000', 0)} AS yen,
                CASE WHEN days > 30 THEN {unit('(days // 30)', 'month')} ELSE {unit('days', 'day')} END || ' ago' AS age,
                CASE WHEN revenue > 0 THEN '$' || {plain('revenue', 2)} ELSE '-' END AS revenue,
                array_to_string(list_slice(string_split(agent_id, ''), 1, 4), ', ') || ' (and '
                  || (length(agent_id) - 4) || ' more)' AS letters,
                {f1('duration * 1000', 1)} AS number,
                CASE WHEN abs(duration - 40) < 1e-9 THEN '$0.00' ELSE CASE WHEN duration < 40 THEN '-$' ELSE '+$' END
                  || {f1('abs(duration - 40)', 2)} END AS delta
              FROM v"""
        ),
    )
    q["t13_display_table"] = (
        lambda spark, sf: t.display_table(order_calls(spark, sf)),
        with_orders(
            f""", v AS (SELECT *, CAST(duration AS BIGINT) // 60 AS m, CAST(duration AS BIGINT) % 60 AS x FROM calls)
              SELECT call_id, phone_number, strftime("timestamp", '%Y-%m-%d %H:%M') AS "timestamp",
                CASE WHEN m > 0 THEN m || 'm ' || x || 's' ELSE x || 's' END AS duration, outcome, agent_id, campaign,
                CASE WHEN revenue > 0 THEN '$' || {plain('revenue', 2)} ELSE '-' END AS revenue FROM v"""
        ),
    )

    def changes(c):
        cur = c.where(F.dayofmonth("timestamp") > 15)
        prev = c.where(F.dayofmonth("timestamp") <= 15)
        table_ = compare_groups(cur, prev, "campaign", ["count"])
        return table_.select(
            "campaign", fm.change_text(F.col("count_Change"), F.col("count_Delta")).alias("change")
        )

    q["t13_change_text"] = (
        lambda spark, sf: changes(event_calls(spark, sf)),
        with_events(
            f""", k AS (SELECT campaign, count(*) FILTER (WHERE day("timestamp") > 15) AS a,
                count(*) FILTER (WHERE day("timestamp") <= 15) AS b FROM calls GROUP BY campaign),
              v AS (SELECT *, a - b AS d, greatest(-100, least(100, (a - b) / CAST(b AS DOUBLE) * 100)) AS p FROM k)
              SELECT campaign, CASE WHEN p > 0 THEN '↑' WHEN p < 0 THEN '↓' ELSE '→' END || ' '
                || {plain('abs(p)', 1)} || '%' || CASE WHEN d = 0 THEN '' ELSE ' (Δ '
                || CASE WHEN d < 0 THEN '-' ELSE '+' END || format('{{:,}}', abs(d)) || ')' END AS change FROM v"""
        ),
    )

    def checked(spark, sf):
        e = table(spark, sf, "events")
        i, u = F.col("event_id"), F.col("user_id")
        ts = F.col("ts").cast("timestamp_ntz")
        text = lambda c: c.cast("string")
        return e.select(
            "event_id",
            F.concat(
                F.lit("user"), text(u), F.when(u % 3 == 0, " at ").otherwise("@"), F.lit("mail.example."),
                F.when(u % 5 == 0, "c").otherwise("com"),
            ).alias("email"),
            F.concat(F.lit("(55"), text(i % 10), F.lit(") "), text(i * 997)).alias("phone"),
            F.concat(
                F.when(i % 4 == 0, "ftp").otherwise("https"), F.lit("://www.example.com/a?b="), text(i)
            ).alias("url"),
            F.concat(F.lit("id_"), text(i), F.when(i % 7 == 0, "!").otherwise("")).alias("id"),
            F.when(i % 3 == 0, F.date_format(ts, "dd/MM/yyyy")).otherwise(
                F.date_format(ts, "yyyy-MM-dd")
            ).alias("day"),
            F.when(i % 6 == 0, F.concat(F.lit("x"), text(i))).otherwise(text(F.col("value"))).alias("number"),
            F.col("event_type").alias("text"),
            F.when(i % 9 == 0, F.substring("props", 2, 100)).otherwise(F.col("props")).alias("json"),
            ts.alias("start"),
            (ts + F.make_dt_interval(hours=(i % 30 - 5).cast("int"))).alias("stop"),
        )

    rules = lambda: {
        "email": t.check("email", "email"),
        "phone": t.check("phone", "phone"),
        "phone_other": t.check("phone", "phone", region="other"),
        "url": t.check("url", "url"),
        "id": t.check("id", "id"),
        "date": t.check("date", "day", low="2024-01-10", high="2024-01-20"),
        "number": t.check("number", "number", low=5.0, high=100.0, negative=False),
        "text": t.check("text", "text", min_length=5, max_length=6, pattern="[a-z]+r"),
        "json": t.check("json", "json"),
        "time_range": t.check("time_range", "start", end="stop", max_hours=12),
    }
    frame = """WITH e AS (SELECT event_id AS i,
        'user' || user_id || CASE WHEN user_id % 3 = 0 THEN ' at ' ELSE '@' END || 'mail.example.'
          || CASE WHEN user_id % 5 = 0 THEN 'c' ELSE 'com' END AS email,
        '55' || event_id % 10 || (event_id * 997) AS phone,
        event_id % 4 <> 0 AS url, event_id % 7 <> 0 AS id,
        event_id % 3 <> 0 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AS day,
        event_id % 6 <> 0 AND value BETWEEN 5 AND 100 AS number,
        event_type AS text, event_id % 9 <> 0 AS json, event_id % 30 - 5 AS hours FROM events),
      r AS (SELECT i, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') AS email,
        regexp_matches(phone, '^1?[0-9]{10}$') AS phone, regexp_matches(phone, '^[0-9]{7,15}$') AS phone_other,
        url, id, day AS date, number, length(text) BETWEEN 5 AND 6 AND regexp_matches(text, '^[a-z]+r') AS text,
        json, hours > 0 AND hours <= 12 AS time_range FROM e)"""
    names = list("email phone phone_other url id date number text json time_range".split())
    q["t14_check_counts"] = (
        lambda spark, sf: t.check_counts(checked(spark, sf), rules()),
        frame + " " + " UNION ALL ".join(
            f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {n}) AS passed, count(*) FILTER (WHERE NOT {n}) AS failed FROM r"
            for n in names
        ),
    )
    q["t14_failing_rows"] = (
        lambda spark, sf: t.failing_rows(checked(spark, sf), rules()).select(
            "event_id", F.array_join("failed_rules", ",").alias("failed_rules")
        ),
        frame + " SELECT i AS event_id, array_to_string(list_filter([" + ", ".join(
            f"CASE WHEN NOT {n} THEN '{n}' END" for n in names
        ) + "], lambda x: x IS NOT NULL), ',') AS failed_rules FROM r WHERE NOT ("
        + " AND ".join(names) + ")",
    )
    return q
