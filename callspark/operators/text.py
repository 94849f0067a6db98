"""Text operators over transcripts: one pass per table, no shuffle unless rows are counted."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats
from ..functions.fixed_values import (
    EMAIL_FORM,
    ENTITY_PATTERNS,
    ID_FORM,
    MASKS,
    STOP_WORDS,
    URL_FORM,
)
from ..functions.parsing import phone_ok
from ..functions.text import (
    collapse,
    last_position,
    let,
    paragraphs,
    round_up,
    sentences,
    share,
    similarity,
    strip,
    top_words,
    words,
)
from ..functions.unicode import nfkd

# Fixed value: the ASCII punctuation characters.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def clean_text(
    text: Column, punctuation: bool = False, lowercase: bool = False, numbers: bool = False
) -> Column:
    """NFKD, single blanks; optionally drop punctuation and digits and fold case."""
    out = collapse(nfkd(F.coalesce(text, F.lit(""))))
    if lowercase:
        out = F.lower(out)
    if punctuation:
        out = F.translate(out, PUNCTUATION, "")
    if numbers:
        out = F.regexp_replace(out, "\\p{Nd}+", "")
    return strip(out)


def keyword_words(text: Column, min_length: int = 3) -> Column:
    """Cleaned lower-case words of some length that are no stop words."""
    tokens = words(clean_text(text, punctuation=True, lowercase=True))
    # A long literal list is tested as a hash set.
    return F.filter(tokens, lambda w: (F.length(w) >= min_length) & ~w.isin(STOP_WORDS))


def keywords(df: DataFrame, key: str, text: str, top_k: int = 10, min_length: int = 3) -> DataFrame:
    """Top words per text by frequency, ties by first occurrence: (key, rank, word, n).

    Words are counted inside the row, so a corpus of any size needs no shuffle.
    """
    ranked = let(keyword_words(F.col(text), min_length), lambda w: top_words(w, top_k))
    return df.select(key, F.posexplode(ranked).alias("pos", "top")).select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("top.word").alias("word"),
        F.col("top.n").cast("bigint").alias("n"),
    )


def corpus_keywords(df: DataFrame, text: str, top_k: int = 10, min_length: int = 3) -> DataFrame:
    """Top words of all texts together, ties by word."""
    return (
        df.select(F.explode(keyword_words(F.col(text), min_length)).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(top_k)
    )


TOKENIZERS = {"word": words, "sentence": sentences, "paragraph": paragraphs}


def tokens(df: DataFrame, key: str, text: str, method: str = "word") -> DataFrame:
    """(key, pos, token) rows of words, sentences or paragraphs."""
    if method not in TOKENIZERS:
        raise ValueError(f"unknown tokenization method: {method}")
    return df.select(key, F.posexplode(TOKENIZERS[method](F.col(text))).alias("pos", "token"))


def text_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """Counts, mean lengths and lexical diversity per text."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = df.select(key, t.alias("t"), words(t).alias("w"), F.size(sentences(t)).alias("s"))
    letters = F.aggregate("w", F.lit(0), lambda n, w: n + F.length(w))
    unique = F.size(F.array_distinct(F.transform("w", F.lower)))
    counted = parts.select(
        key,
        F.length("t").alias("character_count"),
        F.size("w").alias("word_count"),
        F.col("s").alias("sentence_count"),
        letters.alias("letters"),
        unique.alias("unique_words"),
    )
    return counted.select(
        key,
        "character_count",
        "word_count",
        "sentence_count",
        round_up(share(F.col("letters"), F.col("word_count")), 2).alias("average_word_length"),
        round_up(share(F.col("word_count"), F.col("sentence_count")), 2).alias("average_sentence_length"),
        "unique_words",
        round_up(share(F.col("unique_words"), F.col("word_count")), 3).alias("lexical_diversity"),
    )


def _usable(pattern: str) -> re.Pattern | None:
    try:
        return re.compile(pattern)
    except re.error:
        return None


def _hit(kind: str):
    return lambda match, pos: F.struct(
        F.lit(kind).alias("kind"), pos.alias("pos"), match.alias("match")
    )


def pattern_hits(
    df: DataFrame, key: str, text: str, patterns: dict[str, str], any_case: bool = True
) -> DataFrame:
    """(key, kind, pos, match) for every match; a pattern that does not compile is skipped.

    A pattern with a group yields its first group, as a find-all does.
    """
    found = []
    for kind, pattern in patterns.items():
        compiled = _usable(pattern)
        if compiled is None:
            continue
        group = min(compiled.groups, 1)
        form = ("(?i)" if any_case else "") + pattern
        matches = F.regexp_extract_all(F.col(text), F.lit(form), F.lit(group))
        found.append(F.transform(matches, _hit(kind)))
    # Texts are read once per pattern inside the row; only hits leave it.
    return df.where(F.col(text).isNotNull()).select(key, F.inline(F.concat(*found)))


def entities(df: DataFrame, key: str, text: str, extra: dict[str, str] | None = None) -> DataFrame:
    """E-mails, phones, URLs, dates, times and money as (key, kind, pos, match)."""
    return pattern_hits(df, key, text, {**ENTITY_PATTERNS, **(extra or {})}, any_case=False)


def entity_counts(df: DataFrame, key: str, text: str, extra: dict[str, str] | None = None) -> DataFrame:
    hits = entities(df, key, text, extra)
    return hits.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))


def mask_pii(text: Column, extra: list[tuple[str, str, str]] | None = None) -> Column:
    """Replace e-mails, phones, SSNs and card numbers, in this order."""
    out = text
    for _, pattern, mark in [*MASKS, *(extra or [])]:
        out = F.regexp_replace(out, pattern, re.sub(r"([$\\])", r"\\\1", mark))
    return out


def masked_counts(df: DataFrame, text: str, extra: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """Masks set per kind over all texts, in one pass.

    Each kind is counted on the text that the masks before it have left, because a
    phone that is already masked is no card number.
    """
    steps, left = [], F.col(text)
    rules = [*MASKS, *(extra or [])]
    staged = df.select(left.alias("t0"))
    for i, (_, pattern, mark) in enumerate(rules):
        replacement = re.sub(r"([$\\])", r"\\\1", mark)
        staged = staged.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, replacement))
        steps.append(F.sum(F.regexp_count(F.col(f"t{i}"), F.lit(pattern))).alias(f"n{i}"))
    one = staged.agg(*steps)
    pairs = [
        F.struct(F.lit(kind).alias("kind"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("masked"))
        for i, (kind, _, _) in enumerate(rules)
    ]
    return one.select(F.inline(F.array(*pairs)))


def truncate(text: Column, length: int, suffix: str = "...", keep: float = 0.0) -> Column:
    """Cut at the last blank that lies past ``keep`` of the room before the suffix.

    ``keep=0`` cuts at any blank; ``keep=0.8`` only at one in the last fifth.
    """
    room = length - len(suffix)
    head = F.substring(text, 1, room)
    at = last_position(head, " ") - 1
    edge = (at >= 0) if keep == 0 else (at > room * keep)
    cut = F.when(edge, F.substring(head, F.lit(1), at)).otherwise(head)
    return F.when(F.length(text) <= length, text).otherwise(F.concat(cut, F.lit(suffix)))


def highlight(text: Column, terms: list[str], tag: str = "mark") -> Column:
    """Wrap every term, longest first and in any case, in a tag."""
    out = text
    for term in sorted(terms, key=len, reverse=True):
        quoted = "(?i)\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        out = F.regexp_replace(out, quoted, f"<{tag}>$0</{tag}>")
    return out


def pair_similarity(pairs: DataFrame, a: str, b: str, methods: list[str]) -> DataFrame:
    """Similarity columns for a table of text pairs. The pairs come from the caller, so
    the work grows with them and never with the square of a table."""
    for m in methods:
        pairs = pairs.withColumn(m, similarity(F.col(a), F.col(b), m))
    return pairs


def transcript_quality(df: DataFrame, text: str, min_tokens: int = 20) -> DataFrame:
    """Adds valid and reason: enough tokens, and at least a fifth of them distinct."""
    w = words(F.coalesce(F.col(text), F.lit("")))
    out = df.withColumn("_w", F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d")))
    reason = (
        F.when(F.col("_w.n") == 0, "empty")
        .when(F.col("_w.n") < min_tokens, "too short")
        .when(F.col("_w.d") < F.col("_w.n") * 0.2, "repetitive")
    )
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_w")


def assemble_transcripts(
    segments: DataFrame,
    key: str,
    start: str,
    text: str,
    confidence: str | None = None,
    number: str | None = None,
) -> DataFrame:
    """Transcript, mean confidence and segment list per call, one row each, in time order.

    A group is one call, so its size is bounded by the call and not by the table. Equal start
    times follow the segment ``number``, if there is one.
    """
    value = F.col(confidence) if confidence else F.lit(0.95)
    # Fixed value: 0.95 is the confidence of a segment that carries none.
    trimmed = segments.select(
        key,
        F.struct(
            F.col(start).cast("double").alias("start"),
            strip(F.col(text)).alias("text"),
            F.coalesce(value, F.lit(0.95)).alias("confidence"),
        ).alias("s"),
    ).where(F.col("s.text") != "")
    gathered = trimmed.groupBy(key).agg(
        F.sort_array(F.collect_list("s")).alias("segments"),
        F.avg("s.confidence").alias("confidence"),
    )
    return gathered.select(
        key,
        F.array_join(F.col("segments.text"), " ").alias("transcript"),
        "confidence",
        F.size("segments").alias("n_segments"),
        "segments",
    )


def display_table(df: DataFrame, show_transcript: bool = False) -> DataFrame:
    """The report table of calls: formatted time, duration and revenue, text preview."""
    shown = {
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd HH:mm"),
        "duration": formats.metric_duration(F.coalesce("duration", F.lit(0.0))),
        "revenue": formats.money_or_dash(F.col("revenue")),
    }
    names = ["call_id", "phone_number", "timestamp", "duration", "outcome", "agent_id", "campaign"]
    if show_transcript:
        names.append("transcript")
        if "transcript" in df.columns:
            shown["transcript"] = F.concat(F.substring("transcript", 1, 100), F.lit("..."))
    names.append("revenue")
    return df.select(*[shown.get(n, F.col(n)).alias(n) for n in names if n in df.columns])


def check(kind: str, column: str, **p) -> Column:
    """One column check as a condition; null never passes.

    Kinds: email, phone, url, id, date, number, text, json, time_range.
    """
    c = F.col(column)
    text = c.cast("string")
    tests: list[Column] = []
    if kind == "email":
        tests = [text.rlike(EMAIL_FORM)]
    elif kind == "phone":
        tests = [c.isNotNull(), phone_ok(text, p.get("region", "US"))]
    elif kind == "url":
        tests = [text.rlike(URL_FORM)]
    elif kind == "id":
        tests = [text.rlike(p.get("pattern", ID_FORM))]
    elif kind == "date":
        day = F.try_to_timestamp(text, F.lit(p.get("format", "yyyy-MM-dd"))).cast("date")
        tests = [day.isNotNull(), *_between(day, p.get("low"), p.get("high"))]
    elif kind == "number":
        number = text.try_cast("double")
        tests = [number.isNotNull(), *_between(number, p.get("low"), p.get("high"))]
        tests += [] if p.get("negative", True) else [number >= 0]
    elif kind == "text":
        tests = [F.length(text) >= p.get("min_length", 0)]
        tests += [F.length(text) <= p["max_length"]] if p.get("max_length") is not None else []
        tests += [text.rlike("^(?:" + p["pattern"] + ")")] if p.get("pattern") else []
    elif kind == "json":
        # The parser stops after the first value; a marker behind it proves that it was the last.
        whole = F.concat(F.lit('{"value":'), text, F.lit(',"end_of_text":1}'))
        marker = F.try_variant_get(F.try_parse_json(whole), "$.end_of_text", "int")
        tests = [F.try_parse_json(text).isNotNull(), marker == 1]
    elif kind == "time_range":
        end = F.col(p["end"])
        tests = [c < end]
        if p.get("max_hours"):
            tests.append(F.timestamp_diff("SECOND", c, end) <= p["max_hours"] * 3600)
    else:
        raise ValueError(f"unknown check: {kind}")
    return F.coalesce(reduce(and_, tests), F.lit(False))


def _between(value: Column, low, high) -> list[Column]:
    out = [value >= F.lit(low)] if low is not None else []
    return out + ([value <= F.lit(high)] if high is not None else [])


def check_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, passed, failed) for all rules in one pass over the table."""
    one = df.agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(ok).alias(name) for name, ok in rules.items()]
    )
    lines = [
        F.struct(
            F.lit(n).alias("rule"), F.col(n).alias("passed"), (F.col("_n") - F.col(n)).alias("failed")
        )
        for n in rules
    ]
    return one.select(F.inline(F.array(*lines)))


def failing_rows(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The quarantine: rows that fail a rule, with the names of the failed rules."""
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))
    return df.withColumn("failed_rules", failed).where(F.size("failed_rules") > 0)
