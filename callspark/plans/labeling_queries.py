"""Registered labelling queries: L1 to L6, A27 and J2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labeling as lab
from ..operators import metrics as m
from .rounding import rounded
from .views import document_calls, sql_words, with_documents

# Rules whose keywords occur in the test documents. Ten keywords or fewer per section
# keep the confidence divisor at 1.
RULES = {
    "connection": {
        "min_duration_seconds": 30,
        "min_transcript_words": 40,
        "disconnection_keywords": ["eriner thanea.", "that the", "license"],
        "connection_keywords": ["the the", "erin", "attion", "ción"],
    },
    "call_types": {
        "inquiry": ["thing", "the and"],
        "billing_sales": ["attion", "of the"],
        "support": ["thble", "keit"],
        "complaint": ["license", "ción"],
    },
    "outcomes": {
        "resolved": ["erin", "the the"],
        "callback": ["thing", "keit"],
        "refund": ["attion", "ción"],
        "sale_close": ["thble"],
        "unresolved": ["license", "that the"],
    },
    "scoring": {
        "keyword_weight": 1.0,
        "phrase_weight": 2.0,
        "min_confidence_score": 0.6,
        "fuzzy_matching": False,
        "fuzzy_threshold": 0.85,
    },
    "priorities": {
        "call_type_priority": ["complaint", "support"],
        "outcome_priority": ["unresolved", "refund", "callback", "sale_close", "resolved"],
    },
    "custom_rules": {
        "urgent_complaint": r"(the|that)\s+(and|of)",
        "technical_escalation": r"(erin|attion)\s+(the|of)",
        "vip_customer": "license",
    },
}

# Thirty type keywords, so that the confidence threshold leaves calls Unknown.
MANY = {
    **RULES,
    "call_types": {
        "inquiry": ["thing", "the and", *[f"absent{i}" for i in range(8)]],
        "billing_sales": ["attion", "of the", "thble", *[f"missing{i}" for i in range(7)]],
        "support": ["keit", "erin", *[f"gone{i}" for i in range(8)]],
    },
}
EXACT = {**lab.LABEL_RULES, "scoring": {**lab.LABEL_RULES["scoring"], "fuzzy_matching": False}}
FUZZY = {**RULES, "scoring": {**RULES["scoring"], "fuzzy_matching": True}}


#: Near matches (call_id, part, form) of keywords: words or word windows whose matching blocks, found
#: longest first, make up the share. A segment is cut at its longest block into one on either side.
NEAR_SQL = """forms(form, n) AS (SELECT DISTINCT lower(keyword), len({keyword_words}) FROM kw),
      parts AS (SELECT call_id, 0 AS part, {text_words} AS ws FROM texts UNION ALL SELECT call_id, 1, {tail_words} FROM texts),
      windows AS (SELECT DISTINCT call_id, part, n, array_to_string(ws[i:i + n - 1], ' ') AS gram
        FROM (SELECT call_id, part, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM parts, (SELECT DISTINCT n FROM forms))),
      pairs AS (SELECT DISTINCT gram, form FROM windows JOIN forms USING (n)
        WHERE 200.0 * least(length(gram), length(form)) / (length(gram) + length(form)) >= {percent} - 1),
      near_pairs AS (
        WITH RECURSIVE segments(gram, form, a, b, c, d, matched) AS (
          SELECT gram, form, 0::BIGINT, length(gram)::BIGINT, 0::BIGINT, length(form)::BIGINT, 0::BIGINT FROM pairs
          UNION ALL
          SELECT gram, form, CASE WHEN side = 0 THEN a ELSE best.k - best.i END, CASE WHEN side = 0 THEN -best.i ELSE b END,
            CASE WHEN side = 0 THEN c ELSE best.k - best.j END, CASE WHEN side = 0 THEN -best.j ELSE d END,
            CASE WHEN side = 0 THEN best.k ELSE 0 END
          FROM (SELECT gram, form, a, b, c, d, max({{'k': k, 'i': -i, 'j': -j}}) AS best
            FROM (SELECT *, unnest(range(1, least(b - i, d - j) + 1)) AS k
              FROM (SELECT *, unnest(range(c, d)) AS j FROM (SELECT *, unnest(range(a, b)) AS i FROM segments))
              WHERE gram[i + 1] = form[j + 1])
            WHERE gram[i + 1:i + k] = form[j + 1:j + k] GROUP BY ALL), (VALUES (0), (1)) sides(side))
        SELECT gram, form FROM segments GROUP BY 1, 2
        HAVING round_even(100 * (2.0::DOUBLE * sum(matched) / (length(gram) + length(form))), 0) >= {percent}),
      near AS (SELECT DISTINCT call_id, part, form FROM windows JOIN near_pairs USING (gram)),
      """


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _ctes(rules) -> str:
    rows = ", ".join(
        f"({_text(sec)}, {_text(label)}, {i}, {_text(k)}, {w(k)}::DOUBLE)"
        for sec, label, keys, w in lab._sections(rules)
        for i, k in enumerate(keys)
    )
    conn = rules["connection"]

    def place(section, names):
        order = rules["priorities"][f"{section}_priority"]
        order = [x for x in order if x in names] + [x for x in names if x not in order]
        return ", ".join(f"({_text(x)}, {i})" for i, x in enumerate(order))

    def shown(names, sep):
        return "CASE label " + " ".join(
            f"WHEN {_text(x)} THEN {_text(x.replace('_', sep).title())}" for x in names
        ) + " END"

    def best(tag, section, names, sep, score):
        total = max(sum(len(k) for k in names.values()) * 0.1, 1)
        low = rules["scoring"]["min_confidence_score"]
        return f"""
      {tag}p(label, place) AS (VALUES {place('call_type' if section == 'call_types' else 'outcome', names)}),
      {tag}s AS (SELECT call_id, label, sum({score}) AS score, list(keyword ORDER BY pos) AS keys
        FROM hits WHERE section = '{section}' GROUP BY 1, 2),
      {tag}r AS (SELECT {tag}s.*, row_number() OVER (PARTITION BY call_id ORDER BY score DESC, place) AS rn
        FROM {tag}s JOIN {tag}p USING (label)),
      {tag} AS (SELECT call_id, least(1.0, score / {total}::DOUBLE) AS conf,
        CASE WHEN least(1.0, score / {total}::DOUBLE) >= {low} THEN {shown(names, sep)} ELSE 'Unknown' END AS label,
        CASE WHEN least(1.0, score / {total}::DOUBLE) >= {low} THEN keys ELSE [] END AS keys
        FROM {tag}r WHERE rn = 1)"""

    near, found, late = "", "contains(t, lower(keyword))", "contains(tail, lower(keyword))"
    if rules["scoring"]["fuzzy_matching"]:
        near = NEAR_SQL.format(
            keyword_words=sql_words("keyword"), text_words=sql_words("t"), tail_words=sql_words("tail"), percent=rules["scoring"]["fuzzy_threshold"] * 100
        )
        found += " OR EXISTS (FROM near WHERE part = 0 AND near.call_id = texts.call_id AND form = lower(keyword))"
        late += " OR EXISTS (FROM near WHERE part = 1 AND near.call_id = texts.call_id AND form = lower(keyword))"

    return f""", kw(section, label, pos, keyword, weight) AS (VALUES {rows}),
      texts AS (SELECT call_id, transcript, duration, lower(transcript) AS t,
        lower(CASE WHEN length(transcript) > 500
          THEN substring(transcript, CAST(floor(length(transcript) * 0.7::DOUBLE) AS INT) + 1) ELSE transcript END) AS tail,
        len({sql_words('transcript')}) AS n FROM calls),
      {near}hits AS (SELECT call_id, section, label, pos, keyword, weight, {late} AS late
        FROM texts, kw WHERE {found}),
      g AS (SELECT call_id, list(keyword ORDER BY pos) AS keys FROM hits
        WHERE section = 'connection' AND label = 'disconnection' GROUP BY 1),
      h AS (SELECT call_id, list(keyword ORDER BY pos) AS keys FROM hits
        WHERE section = 'connection' AND label = 'connection' GROUP BY 1),
      c AS (SELECT x.call_id, CASE WHEN g.keys IS NOT NULL OR duration < {conn['min_duration_seconds']}
            OR n < {conn['min_transcript_words']} THEN 'Disconnected' ELSE 'Connected' END AS label,
          CASE WHEN g.keys IS NOT NULL THEN 0.9::DOUBLE
            WHEN duration < {conn['min_duration_seconds']} OR n < {conn['min_transcript_words']} THEN 0.8
            WHEN h.keys IS NOT NULL THEN least(1.0, 0.5 + 0.2 * len(h.keys)) ELSE 0.7 END AS conf,
          CASE WHEN g.keys IS NOT NULL THEN g.keys[1:1]
            WHEN duration < {conn['min_duration_seconds']} OR n < {conn['min_transcript_words']} THEN []
            ELSE coalesce(h.keys, []) END AS keys
        FROM texts x LEFT JOIN g USING (call_id) LEFT JOIN h USING (call_id)),
      {best('y', 'call_types', rules['call_types'], '/', 'weight')},
      {best('z', 'outcomes', rules['outcomes'], '-', 'weight + CASE WHEN late THEN 0.5 ELSE 0 END')}"""


def _final(rules) -> str:
    urgent = _text("(?i)" + rules["custom_rules"]["urgent_complaint"].removeprefix("(?i)"))
    tech = _text("(?i)" + rules["custom_rules"]["technical_escalation"].removeprefix("(?i)"))
    return f""", f AS (SELECT x.call_id, c.label AS connection_status,
        CASE WHEN regexp_matches(transcript, {urgent}) THEN 'Complaint' ELSE coalesce(y.label, 'Unknown') END AS call_type,
        CASE WHEN regexp_matches(transcript, {tech}) THEN 'Callback' ELSE coalesce(z.label, 'Unknown') END AS outcome,
        round((c.conf + coalesce(y.conf, 0) + coalesce(z.conf, 0)) / 3, 6) AS labeling_confidence,
        list_concat(c.keys, list_concat(coalesce(y.keys, []), coalesce(z.keys, []))) AS ks
      FROM texts x JOIN c USING (call_id) LEFT JOIN y USING (call_id) LEFT JOIN z USING (call_id)),
    labelled AS (SELECT call_id, connection_status, call_type, outcome, labeling_confidence,
      array_to_string(list_transform(list_filter(range(1, len(ks) + 1),
        lambda i: list_position(ks, ks[i]) = i), lambda i: ks[i])[1:5], ', ') AS matched_keywords FROM f)"""


def entries():
    q = {}
    LABELS = ["call_id", "connection_status", "call_type", "outcome", "labeling_confidence", "matched_keywords"]

    def add(name, run, sql):
        q[name] = (lambda spark, sf, run=run: run(document_calls(spark, sf)), sql and with_documents(sql))

    def detail(c, column, rules=RULES):
        d = lab.label_details(c, rules=rules)
        return d.select(
            "call_id", F.col(column)["label"].alias("label"),
            F.round(F.col(column)["confidence"], 6).alias("confidence"),
            F.array_join(F.col(column)["keywords"], ", ").alias("keywords"),
        )

    add(
        "l1_keyword_hits",
        lambda c: lab.keyword_hits(c, "call_id", "transcript", RULES),
        _ctes(RULES) + "SELECT call_id, section, label, keyword FROM hits",
    )
    add(
        "l1_fuzzy_keyword_hits",
        lambda c: lab.keyword_hits(c, "call_id", "transcript", FUZZY),
        _ctes(FUZZY) + "SELECT call_id, section, label, keyword FROM hits",
    )
    add(
        "l2_connection_status",
        lambda c: detail(c, "connection"),
        _ctes(RULES) + "SELECT call_id, label, round(conf, 6) AS confidence, array_to_string(keys, ', ') AS keywords FROM c",
    )
    empty = ("coalesce({t}.label, 'Unknown') AS label, round(coalesce({t}.conf, 0), 6) AS confidence, "
             "coalesce(array_to_string({t}.keys, ', '), '') AS keywords")
    for name, column, tag, rules in (
        ("l3_call_type", "type", "y", RULES),
        ("l3_call_type_many_keywords", "type", "y", MANY),
        ("l4_outcome", "result", "z", RULES),
    ):
        add(
            name,
            lambda c, column=column, rules=rules: detail(c, column, rules),
            _ctes(rules) + f"SELECT texts.call_id, {empty.format(t=tag)} FROM texts LEFT JOIN {tag} USING (call_id)",
        )
    add(
        "l5_overrides",
        lambda c: lab.label_calls(c, rules=RULES).groupBy("call_type", "outcome").agg(
            F.count(F.lit(1)).alias("calls")
        ),
        _ctes(RULES) + _final(RULES) + "SELECT call_type, outcome, count(*) AS calls FROM labelled GROUP BY 1, 2",
    )
    add(
        "l6_label_calls",
        lambda c: rounded(lab.label_calls(c, rules=RULES).select(*LABELS), "labeling_confidence"),
        _ctes(RULES) + _final(RULES) + f"SELECT {', '.join(LABELS)} FROM labelled",
    )
    add(
        "l6_label_calls_fuzzy",
        lambda c: rounded(lab.label_calls(c, rules=FUZZY).select(*LABELS), "labeling_confidence"),
        _ctes(FUZZY) + _final(FUZZY) + f"SELECT {', '.join(LABELS)} FROM labelled",
    )
    add(
        "l6_default_rules",
        lambda c: lab.label_calls(c, rules=EXACT).groupBy("connection_status", "call_type", "outcome").agg(
            F.count(F.lit(1)).alias("calls")
        ),
        _ctes(EXACT) + _final(EXACT)
        + "SELECT connection_status, call_type, outcome, count(*) AS calls FROM labelled GROUP BY 1, 2, 3",
    )
    add(
        "a27_labelling_report",
        lambda c: rounded(m.labelling_report(lab.label_calls(c, rules=RULES)), "value", digits=4),
        _ctes(RULES) + _final(RULES) + """SELECT section, metric, round(CAST(value AS DOUBLE), 4) AS value FROM (
          SELECT 'total' AS section, 'total_calls' AS metric, CAST(count(*) AS DOUBLE) AS value FROM labelled
          UNION ALL SELECT 'total', 'average_confidence', avg(labeling_confidence) FROM labelled
          UNION ALL SELECT 'total', 'low_confidence_count', count(*) FILTER (WHERE labeling_confidence < 0.6) FROM labelled
          UNION ALL SELECT 'connection_status', connection_status, count(*) FROM labelled GROUP BY 2
          UNION ALL SELECT 'call_type', call_type, count(*) FROM labelled GROUP BY 2
          UNION ALL SELECT 'outcome', outcome, count(*) FROM labelled GROUP BY 2)""",
    )
    add(
        "j2_update_labels",
        lambda c: lab.update_labels(
            c, lab.label_calls(c, rules=RULES).where(F.col("connection_status") == "Connected").select(
                "call_id", "connection_status", "call_type", "outcome"
            )
        ).select("call_id", "connection_status", "call_type", "outcome"),
        _ctes(RULES) + _final(RULES) + """SELECT calls.call_id, l.connection_status,
          coalesce(l.call_type, calls.call_type) AS call_type, coalesce(l.outcome, calls.outcome) AS outcome
          FROM calls LEFT JOIN (SELECT * FROM labelled WHERE connection_status = 'Connected') l USING (call_id)""",
    )
    return q
