"""Rule-based labels of transcripts.

All rules are short lists, so they are literals of the plan. A call is labelled inside
its row: no exploded hits, no join, no shuffle.
"""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import LABEL_RULES
from ..functions.fuzzy import near_keywords
from ..functions.text import let, words

LONG_TEXT = 500
LAST_SHARE = 0.7


def load_rules(path: str) -> dict[str, Any]:
    """Rules from a TOML file with the sections of the default rules."""
    with open(path, "rb") as handle:
        return tomllib.load(handle)


def rule_table(df: DataFrame, rules: dict[str, Any] = LABEL_RULES) -> DataFrame:
    """The rules as rows (section, label, pos, keyword, weight)."""
    rows = [
        (section, label, i, k, w)
        for section, label, words_, weight in _sections(rules)
        for i, (k, w) in enumerate((k, weight(k)) for k in words_)
    ]
    return df.sparkSession.createDataFrame(
        rows, "section string, label string, pos int, keyword string, weight double"
    )


def _sections(rules: dict[str, Any]):
    """(section, label, keywords, scorer) of every keyword group.

    ``rules["scorers"]`` may give a function keyword -> weight for a label or a section; others
    weigh a keyword by the scoring section.
    """
    scoring, scorers = rules.get("scoring", {}), rules.get("scorers", {})
    one = float(scoring.get("keyword_weight", 1.0))
    phrase = float(scoring.get("phrase_weight", 2.0))
    connection = rules.get("connection", {})
    groups = [("connection", name, connection.get(f"{name}_keywords", [])) for name in ("disconnection", "connection")]
    groups += [(section, label, keys) for section in ("call_types", "outcomes") for label, keys in rules.get(section, {}).items()]
    for section, label, keys in groups:
        by_default = (lambda k: phrase if len(k.split()) > 1 else one) if section == "call_types" else (lambda k: one)
        yield section, label, keys, scorers.get(label) or scorers.get(section) or by_default


def _all_keywords(rules: dict[str, Any]) -> list[str]:
    return list(dict.fromkeys(k for _, _, keys, _ in _sections(rules) for k in keys))


def _candidates(rules: dict[str, Any], section: str, label: str | None = None) -> Column | None:
    rows = [
        F.struct(
            F.lit(lab).alias("label"),
            F.lit(k).alias("keyword"),
            F.lit(k.lower()).alias("form"),
            F.lit(float(weight(k))).alias("weight"),
        )
        for sec, lab, keys, weight in _sections(rules)
        if sec == section and label in (None, lab)
        for k in keys
    ]
    return F.array(*rows) if rows else None


def _no_hits() -> Column:
    row = F.struct(
        F.lit("").alias("label"), F.lit("").alias("keyword"), F.lit("").alias("form"),
        F.lit(0.0).alias("weight"),
    )
    return F.filter(F.array(row), lambda r: F.lit(False))


def _matches(candidates: Column | None, lower_text: Column, near: Column | None) -> Column:
    """The candidates found in the text, in rule order."""
    if candidates is None:
        return _no_hits()

    def is_hit(k: Column) -> Column:
        exact = F.contains(lower_text, k["form"])
        return exact if near is None else exact | F.array_contains(near, k["keyword"])

    return F.filter(candidates, is_hit)


def _prepare(df: DataFrame, text: str, rules: dict[str, Any], with_tail: bool = True) -> DataFrame:
    """Lower-case text and last part, and the near keywords of both when fuzzy is on."""
    scoring = rules.get("scoring", {})
    t = F.coalesce(F.col(text), F.lit(""))
    tail = F.when(
        F.length(t) > LONG_TEXT,
        F.substring(t, F.floor(F.length(t) * F.lit(LAST_SHARE)).cast("int") + 1, F.length(t)),
    )
    out = df.withColumn("_lower", F.lower(t)).withColumn("_tail", F.lower(F.coalesce(tail, t)))
    if scoring.get("fuzzy_matching", True):
        threshold = float(scoring.get("fuzzy_threshold", 0.85))
        keys = _all_keywords(rules)
        out = out.withColumn("_nears", near_keywords([F.col("_lower"), *[F.col("_tail")] * with_tail], keys, threshold))
        out = out.withColumns({"_near": F.col("_nears")[0], **({"_near_tail": F.col("_nears")[1]} if with_tail else {})})
    return out


def _near(df: DataFrame, name: str) -> Column | None:
    return F.col(name) if name in df.columns else None


def keyword_hits(df: DataFrame, key: str, text: str, rules: dict[str, Any] = LABEL_RULES) -> DataFrame:
    """(key, section, label, keyword) for every keyword that matches the text."""
    ready = _prepare(df, text, rules, with_tail=False)
    hits = []
    for section in ("connection", "call_types", "outcomes"):
        found = _matches(_candidates(rules, section), F.col("_lower"), _near(ready, "_near"))
        hits.append(F.transform(found, _with_section(section)))
    return ready.select(key, F.inline(F.concat(*hits)))


def _with_section(section: str):
    return lambda h: F.struct(
        F.lit(section).alias("section"), h["label"].alias("label"), h["keyword"].alias("keyword")
    )


def _connection(ready: DataFrame, duration: Column, rules: dict[str, Any]) -> Column:
    connection = rules.get("connection", {})
    near = _near(ready, "_near")
    gone = _matches(_candidates(rules, "connection", "disconnection"), F.col("_lower"), near)
    here = _matches(_candidates(rules, "connection", "connection"), F.col("_lower"), near)
    short = (duration < connection.get("min_duration_seconds", 30)) | (
        F.size(words(F.col("_lower"))) < connection.get("min_transcript_words", 40)
    )

    def result(status: str, confidence: Column, keywords: Column) -> Column:
        return F.struct(
            F.lit(status).alias("label"), confidence.alias("confidence"), keywords.alias("keywords")
        )

    none = F.array().cast("array<string>")

    def decide(h: Column) -> Column:
        gone_keys = F.transform(h["gone"], lambda k: k["keyword"])
        here_keys = F.transform(h["here"], lambda k: k["keyword"])
        return (
            F.when(F.size(gone_keys) > 0, result("Disconnected", F.lit(0.9), F.slice(gone_keys, 1, 1)))
            .when(short, result("Disconnected", F.lit(0.8), none))
            .when(
                F.size(here_keys) > 0,
                result("Connected", F.least(F.lit(1.0), 0.5 + 0.2 * F.size(here_keys)), here_keys),
            )
            .otherwise(result("Connected", F.lit(0.7), none))
        )

    return let(F.struct(gone.alias("gone"), here.alias("here")), decide)


def _best(hits: Column, labels: dict[str, list[str]], priority: list[str], title: str,
          scoring: dict[str, Any]) -> Column:
    """Label with the highest score, its confidence and its keywords.

    Equal scores go to the priority list, then to the order of the rules. Below the
    minimum confidence the label is Unknown, with the confidence kept.
    """
    order = [p for p in priority if p in labels] + [x for x in labels if x not in priority]
    total = max(sum(len(k) for k in labels.values()) * 0.1, 1)
    least = float(scoring.get("min_confidence_score", 0.6))

    def score(h: Column, label: str) -> Column:
        mine = F.filter(h, lambda k: k["label"] == label)
        return F.aggregate(mine, F.lit(0.0), lambda s, k: s + k["weight"])

    def decide(h: Column) -> Column:
        ranked = F.array_max(
            F.array(
                *[
                    F.struct(
                        score(h, label).alias("score"),
                        F.lit(-order.index(label)).alias("place"),
                        F.lit(label).alias("label"),
                        F.lit(label.replace("_", title).title()).alias("shown"),
                    )
                    for label in labels
                ]
            )
        )

        def finish(b: Column) -> Column:
            confidence = F.least(F.lit(1.0), b["score"] / F.lit(float(total)))
            sure = (b["score"] > 0) & (confidence >= least)
            mine = F.transform(F.filter(h, lambda k: k["label"] == b["label"]), lambda k: k["keyword"])
            return F.struct(
                F.when(sure, b["shown"]).otherwise(F.lit("Unknown")).alias("label"),
                confidence.alias("confidence"),
                F.when(sure, mine).otherwise(F.array().cast("array<string>")).alias("keywords"),
            )

        return let(ranked, finish)

    if not labels:
        return F.struct(
            F.lit("Unknown").alias("label"), F.lit(0.0).alias("confidence"),
            F.array().cast("array<string>").alias("keywords"),
        )
    return let(hits, decide)


def label_details(
    df: DataFrame, text: str = "transcript", duration: str = "duration", rules: dict[str, Any] = LABEL_RULES
) -> DataFrame:
    """Adds the structs connection, type and result: label, confidence, keywords."""
    ready = _prepare(df, text, rules)
    scoring, priorities = rules.get("scoring", {}), rules.get("priorities", {})
    near, near_tail = _near(ready, "_near"), _near(ready, "_near_tail")
    type_hits = _matches(_candidates(rules, "call_types"), F.col("_lower"), near)

    def bonus(k: Column) -> Column:
        in_tail = F.contains(F.col("_tail"), k["form"])
        if near_tail is not None:
            in_tail = in_tail | F.array_contains(near_tail, k["keyword"])
        return F.struct(
            k["label"].alias("label"), k["keyword"].alias("keyword"), k["form"].alias("form"),
            (k["weight"] + F.when(in_tail, 0.5).otherwise(0.0)).alias("weight"),
        )

    outcome_hits = F.transform(_matches(_candidates(rules, "outcomes"), F.col("_lower"), near), bonus)
    return (
        ready.withColumn("connection", _connection(ready, F.col(duration), rules))
        .withColumn(
            "type",
            _best(type_hits, rules.get("call_types", {}), priorities.get("call_type_priority", []), "/", scoring),
        )
        .withColumn(
            "result",
            _best(outcome_hits, rules.get("outcomes", {}), priorities.get("outcome_priority", []), "-", scoring),
        )
        .drop("_lower", "_tail", "_nears", "_near", "_near_tail")
    )


# Which pattern of the custom rules overrides which label.
OVERRIDES = {
    "urgent_complaint": ("type", "Complaint"),
    "technical_escalation": ("result", "Callback"),
}


def _override(text: str, target: str, rules: dict[str, Any]) -> Column:
    label = F.col(target)["label"]
    for name, pattern in rules.get("custom_rules", {}).items():
        column, value = OVERRIDES.get(name, (None, None))
        if column == target:
            # The patterns are searched in any case and with Unicode blanks.
            label = F.when(F.coalesce(F.col(text), F.lit("")).rlike("(?iU)" + pattern), F.lit(value)).otherwise(label)
    return label


def label_calls(
    df: DataFrame, text: str = "transcript", duration: str = "duration", rules: dict[str, Any] = LABEL_RULES
) -> DataFrame:
    """Adds the three labels, the mean confidence and up to five matched keywords.

    A call without a duration cannot be labelled: all Unknown and confidence 0.
    """
    for column in (text, duration):
        if column not in df.columns:
            raise ValueError(f"labelling needs the column {column}")
    done = label_details(df, text, duration, rules)
    known = F.col(duration).isNotNull()
    unknown = F.lit("Unknown")
    mean = (
        F.col("connection")["confidence"] + F.col("type")["confidence"] + F.col("result")["confidence"]
    ) / 3
    keys = F.array_distinct(
        F.concat(F.col("connection")["keywords"], F.col("type")["keywords"], F.col("result")["keywords"])
    )
    return done.withColumns(
        {
            "connection_status": F.when(known, F.col("connection")["label"]).otherwise(unknown),
            "call_type": F.when(known, _override(text, "type", rules)).otherwise(unknown),
            "outcome": F.when(known, _override(text, "result", rules)).otherwise(unknown),
            "labeling_confidence": F.when(known, mean).otherwise(F.lit(0.0)),
            "matched_keywords": F.when(known, F.array_join(F.slice(keys, 1, 5), ", ")).otherwise(F.lit("")),
        }
    ).drop("connection", "type", "result")


def update_labels(calls: DataFrame, labels: DataFrame) -> DataFrame:
    """Write the three labels of a label table (one row per call_id) into the calls.

    The label table may be large; both sides are joined on call_id, which is unique in
    the label table, so no call is repeated.
    """
    names = ["connection_status", "call_type", "outcome"]
    new = labels.select("call_id", *[F.col(n).alias(f"_{n}") for n in names if n in labels.columns])
    joined = calls.join(new, "call_id", "left")
    for n in names:
        if f"_{n}" in joined.columns:
            old = F.col(n) if n in calls.columns else F.lit(None).cast("string")
            joined = joined.withColumn(n, F.coalesce(F.col(f"_{n}"), old)).drop(f"_{n}")
    return joined
