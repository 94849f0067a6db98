import math
import random
import re
import string
import tracemalloc
import unicodedata
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callspark.functions import formats as fm
from callspark.functions import fuzzy
from callspark.functions.fixed_values import STOP_WORDS
from callspark.functions.fuzzy import near_matches, ratio
from callspark.functions.parsing import duration_seconds, phone_display, phone_e164
from callspark.functions.text import similarity
from callspark.functions.unicode import decomposed
from callspark.operators import text as t


def one(spark, value, build):
    return spark.createDataFrame([(value,)], "t string").select(build(F.col("t")).alias("r")).first()["r"]


def test_clean_text_golden(spark):
    got = one(spark, " Hello, WORLD! Call 1234. ", lambda c: t.clean_text(c, True, True, True))
    assert got == "hello world call"


def test_clean_text_equals_python(spark):
    texts = ["Café   naïve ﬁn 12٣!", "", "  ", "a\x1cb\x85c", "ÀÉ 1,2;3"]

    def plain(x):
        x = " ".join(unicodedata.normalize("NFKD", x).split()).lower()
        x = x.translate(str.maketrans("", "", string.punctuation))
        return re.sub(r"\d+", "", x).strip()

    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(t.clean_text(F.col("t"), True, True, True)).collect()]
    assert got == [plain(x) for x in texts]


def test_keywords_by_count_then_first_place(spark):
    text = "The agent quickly found it. Quickly, the agent helped; support was slow"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string")
    got = [(r["rank"], r["word"], r["n"]) for r in t.keywords(df, "id", "t", 3, 4).orderBy("rank").collect()]
    assert got == [(1, "agent", 2), (2, "quickly", 2), (3, "found", 1)]


def test_keywords_against_brute_force(spark):
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "xy"]) for _ in range(rnd.randrange(40))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {}
    for r in t.keywords(df, "id", "t", 3).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["word"])
    for i, text in enumerate(texts):
        kept = [w for w in text.split() if len(w) >= 3 and w not in STOP_WORDS]
        assert got.get(i, []) == [w for w, _ in Counter(kept).most_common(3)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "One two.  Three?! \n\n Next para...")], "id int, t string")
    assert [r["token"] for r in t.tokens(df, "id", "t", "sentence").collect()] == ["One two", "Three", "Next para"]
    assert [r["token"] for r in t.tokens(df, "id", "t", "paragraph").collect()] == ["One two.  Three?!", "Next para..."]
    with pytest.raises(ValueError):
        t.tokens(df, "id", "t", "letter")


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "  ")], "id int, t string")
    for r in t.text_statistics(df, "id", "t").collect():
        assert r["word_count"] == 0 and r["lexical_diversity"] == 0 and r["average_word_length"] == 0


@pytest.mark.parametrize("method", ["jaccard", "cosine", "levenshtein"])
def test_similarity_golden(spark, method):
    df = spark.createDataFrame([("same text here", "same text here"), ("", "x"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(similarity(F.col("a"), F.col("b"), method)).collect()] == pytest.approx([1.0, 0.0, 0.0])


def test_similarity_unknown_method(spark):
    with pytest.raises(ValueError):
        similarity(F.col("a"), F.col("b"), "soundex")


def test_similarity_against_brute_force(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c", "dd", "E", "e"]
    pairs = [tuple(" ".join(rnd.choices(words, k=rnd.randrange(1, 12))) for _ in range(2)) for _ in range(80)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in t.pair_similarity(df, "a", "b", ["jaccard", "cosine"]).collect():
        x, y = Counter(r["a"].lower().split()), Counter(r["b"].lower().split())
        assert r["jaccard"] == pytest.approx(len(set(x) & set(y)) / len(set(x) | set(y)))
        norm = math.sqrt(sum(v * v for v in x.values())) * math.sqrt(sum(v * v for v in y.values()))
        assert r["cosine"] == pytest.approx(sum(x[w] * y[w] for w in x) / norm)


def test_masks(spark):
    text = "mail a.b@example.com or 555-123-4567, card 1234 5678 9012 3456, ssn 123-45-6789"
    got = one(spark, text, t.mask_pii)
    assert got == "mail [EMAIL] or [PHONE], card [CREDIT_CARD], ssn [SSN]"
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert {r["kind"]: r["masked"] for r in t.masked_counts(df, "t").collect()} == {
        "email": 1, "phone": 1, "ssn": 1, "credit_card": 1,
    }


def test_pattern_hits_skip_bad_regex(spark):
    df = spark.createDataFrame([(1, "Call A1 and a2")], "id int, t string")
    rows = t.pattern_hits(df, "id", "t", {"bad": "(", "group": r"a(\d)"}).collect()
    assert [(r["kind"], r["match"]) for r in rows] == [("group", "1"), ("group", "2")]


def test_truncate_and_highlight(spark):
    assert one(spark, "hello wide world", lambda c: t.truncate(c, 12)) == "hello..."
    assert one(spark, "hello wide world", lambda c: t.truncate(c, 12, "...", 0.8)) == "hello wid..."
    assert one(spark, "short", lambda c: t.truncate(c, 12)) == "short"
    assert one(spark, "The a+b the", lambda c: t.highlight(c, ["the", "A+B"])) == (
        "<mark>The</mark> <mark>a+b</mark> <mark>the</mark>"
    )


def test_transcript_quality(spark):
    rows = [("a b " * 15,), (" ".join(f"w{i}" for i in range(20)),), ("few words",), (" ",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r["reason"] for r in t.transcript_quality(df, "t").collect()] == ["repetitive", None, "too short", "empty"]


def test_a_long_call_is_one_transcript(spark):
    rows = [("hot", i, f" s{i} ") for i in range(10_500)] + [("b", 1, "x"), ("b", 0, "y"), ("b", 2, "  ")]
    df = spark.createDataFrame(rows, "id string, n int, t string")
    parts = t.assemble_transcripts(df, "id", "n", "t").orderBy("id").collect()
    assert [(r["id"], r["n_segments"]) for r in parts] == [("b", 2), ("hot", 10_500)]
    assert parts[0]["transcript"] == "y x" and parts[0]["confidence"] == pytest.approx(0.95)
    assert parts[1]["transcript"] == " ".join(f"s{i}" for i in range(10_500))


def test_formats(spark):
    df = spark.createDataFrame([(0.0,), (59.0,), (61.0,), (3600.0,), (7325.9,), (-1.0,), (None,)], "x double")
    show = lambda c: [r[0] for r in df.select(c).collect()]
    assert show(fm.duration_text(F.col("x"), "clock")) == ["00:00", "00:59", "01:01", "01:00:00", "02:02:05", "0s", "0s"]
    assert show(fm.duration_text(F.col("x"), "short")) == ["0s", "59s", "1m 1s", "1h", "2h 2m", "0s", "0s"]
    assert show(fm.duration_text(F.col("x")))[2:5] == ["1 minute 1 second", "1 hour", "2 hours 2 minutes"]
    assert show(fm.bytes_text(F.col("x") * 1024))[1:4] == ["59.00 KB", "61.00 KB", "3.52 MB"]
    assert show(fm.currency_text(F.col("x"), "EUR"))[4] == "€7,325.90"
    assert show(fm.currency_text(F.col("x"), "CHF"))[4] == "CHF 7,325.90"
    assert show(fm.delta_text(F.col("x"), "percent"))[:2] == ["0.0%", "+59.0%"]
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    then = lambda s: F.lit(s).cast("timestamp_ntz")
    ages = ["2022-12-31", "2024-01-01", "2024-02-29", "2024-02-29 21:00:00", "2024-02-29 23:58:00", "2024-03-02"]
    got = df.limit(1).select(*[fm.time_ago(then(a), now).alias(f"a{i}") for i, a in enumerate(ages)]).first()
    assert list(got) == ["1 year ago", "2 months ago", "1 day ago", "3 hours ago", "2 minutes ago", "just now"]


def test_parsing(spark):
    df = spark.createDataFrame([("3:05",), ("1:02:03",), ("7.5",), (None,), ("x",)], "d string")
    assert [r[0] for r in df.select(duration_seconds(F.col("d"))).collect()] == [185.0, 3723.0, 7.5, 0.0, None]
    assert one(spark, "(555) 123-4567", phone_e164) == "+15551234567"
    assert one(spark, "44 20 1234", phone_e164) == "+44201234"
    assert one(spark, "1 555 123 4567", phone_display) == "+1 (555) 123-4567"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abc de", max_size=30), st.lists(st.sampled_from(["abc", "abd", "de", "ab cd", "a b c"]), max_size=4, unique=True))
def test_near_matches_equal_all_pairs(text, keywords):
    words = text.split()
    want = set()
    for k in keywords:
        n = len(k.split())
        grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
        if any(ratio(g, k) >= 85 for g in grams):
            want.add(k)
    assert near_matches([text, ""], keywords, 85) == [want, set()]


@pytest.mark.parametrize("step", [1, 2, 3, 1000])
def test_near_matches_do_not_depend_on_the_step(monkeypatch, step):
    monkeypatch.setattr(fuzzy, "STEP_WORDS", step)
    texts, keywords = ["a b c", "x  y abd\tz", "", " ", "x abc", "x y z a", "b c a b c ", "abx a bc"], ["abc", "abd", "a b c", "ab cd"]
    want = [{k for k in keywords if any(ratio(g, k) >= 85 for g in grams(x.split(), len(k.split())))} for x in texts]
    assert near_matches(texts, keywords, 85) == want and want[0] == want[6] == {"a b c"}


def grams(words, n):
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def test_near_matches_of_many_words_stay_in_bounded_memory():
    texts = [" ".join(f"w{i * 500 + j} abcdefgx" for j in range(500)) for i in range(1000)]
    tracemalloc.start()
    got = near_matches(texts, ["abcdefgh", "w1 abcdefgh w2"], 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all("abcdefgh" in g for g in got)
    assert peak < 200 << 20


def test_decomposition_holds_few_texts_as_strings():
    texts = pa.array(["é ﬁ " * 2_000, None, "日本" * 4_000, "", "plain"] * 400)
    tracemalloc.start()
    got = decomposed(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist()[:5] == ["e\u0301 fi " * 2_000, None, "日本" * 4_000, "", "plain"] and len(got) == 2_000
    assert peak < 4 << 20
