"""Token files, packing, mixing, top-k, pages and classifiers against brute force and round trips."""

import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from callspark.llm import cotraining, html_text, mixing, packing, token_files, topk, toxicity
from callspark.llm.queries import VOCABULARY
from callspark.llm.tokens import WordTokenizer

DATA = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(VOCABULARY)
ODD = [
    "", " ", "  a", "a  b", "a \n b", "x\n\ny z", " lead", "trail ", "it's  'tis don't", "a\x1c b", "　 x y",
    "<|endoftext|> a <|endoftext|>b", "日本 語", "a\t b \t c", "é à  ü", "\u0085 x", "12 3 4,5 6", "A" * 3000 + " b", "Word. word, WORD! word.",
]


@lru_cache
def _ids(text):
    return _library().encode(text or "", add_special_tokens=False).ids


@lru_cache
def _library():
    return Tokenizer.from_file(PATH)


def test_word_tokenizer_equals_the_library():
    words = WordTokenizer(PATH)
    for _ in range(2):
        assert words.encode(ODD) == [np.asarray(_ids(t), "<u4").tobytes() for t in ODD]


def _docs(spark, texts):
    rows = [(i, t, f"s{i % 3}", "other", 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, start string, n_chars long")


TEXTS = [*ODD, None, *("word%d and some more of it " % i * (1 + i * 7 % 90) for i in range(60)), "long text here " * 3000, "same", "same"]


def test_token_files_round_trip(spark, tmp_path):
    docs = _docs(spark, TEXTS)
    token_files.write_token_files(docs.select("doc_id", "text"), PATH, f"{tmp_path}/ids", ["doc_id"], 3, end_id=2)
    back = token_files.read_token_files(spark, f"{tmp_path}/ids")
    found = {r["doc_id"]: r for r in token_files.digests(back, ["doc_id"]).collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        ids = np.asarray([*_ids(text), 2], "<u4")
        assert (found[i]["start"], found[i]["n_tokens"], found[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    one = token_files.read_documents(spark, f"{tmp_path}/ids", [7]).select("token_ids", token_files.ids_crc32().alias("crc")).first()
    assert one["token_ids"] == [*_ids(TEXTS[7]), 2] and one["crc"] == found[7]["ids_crc32"]


def test_token_files_of_repeated_and_no_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "b"), (1, "x y"), (1, "x y"), (1, None)], "doc_id long, text string")
    token_files.write_token_files(rows, PATH, f"{tmp_path}/a", ["doc_id"], 2, end_id=2)
    found = token_files.digests(token_files.read_token_files(spark, f"{tmp_path}/a"), ["doc_id"]).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 1]
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]
    token_files.write_token_files(rows.limit(0), PATH, f"{tmp_path}/b", ["doc_id"], 2, end_id=2)
    schema = "doc_id long, file_no int, token_ids array<int>"
    assert token_files.digests(spark.read.schema(schema).orc(f"{tmp_path}/b"), ["doc_id"]).count() == 0


@pytest.mark.parametrize("group", [20_000, 15])
def test_packing_keeps_every_id_once(spark, group):
    docs = _docs(spark, TEXTS).withColumn("offset", F.lit("own"))
    pieces = packing.cut_pieces(docs, PATH, end_id=1, capacity=128, with_ids=True)
    packed = packing.pack(pieces, 128, group)
    rows = packed.collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, text in enumerate(TEXTS):
        ids = [*_ids(text), 1]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["token_ids"]] == ids and all(r["doc_tokens"] == len(ids) for r in own)
        assert [r["start"] for r in own] == list(range(0, len(ids), 128))
        assert all(r["ids_crc32"] == zlib.crc32(np.asarray(r["token_ids"], "<u4").tobytes()) for r in own)
    for own in by_sequence.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert sum(r["length"] for r in own) <= 128
    tokens = sum(r["length"] for r in rows)
    assert 128 * len(by_sequence) < 1.1 * tokens if group > 1000 else True
    filled = packing.sequences(packed, 128, 0).collect()
    assert len(filled) == len(by_sequence)
    for r in filled:
        whole = r["n_tokens"] & (r["n_tokens"] - 1) == 0
        assert len(r["token_ids"]) == (r["n_tokens"] if whole else 128)
    assert packing.pack(packing.cut_pieces(docs.limit(0), PATH, 1, 128), 128).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 65, 400)
    window, offset = packing.best_fit_decreasing(lengths, 64)
    rooms = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in rooms if r >= lengths[i]]
        room = min(fits) if fits else 64
        assert offset[i] == 64 - room
        if fits:
            rooms.remove(room)
        rooms.append(room - int(lengths[i]))
    assert len(rooms) == window.max() + 1


def _targets(sizes, weights, most):
    names = sorted([n for n in sizes if n is not None], key=lambda n: [ord(c) for c in n]) + [n for n in sizes if n is None]
    weight, cap = {n: weights[i % len(weights)] for i, n in enumerate(names)}, {}
    while True:
        free = [n for n in names if n not in cap]
        share = (sum(sizes.values()) - sum(cap.values())) / sum(weight[n] for n in free) if free else 0
        over = [n for n in free if share * weight[n] > most * sizes[n]]
        if not over:
            return {n: cap.get(n, share * weight[n]) for n in names}
        cap |= {n: most * sizes[n] for n in over}


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        source = ["b", "", "\U00010000", None, "z", "tiny", "none"][0 if i % 3 == 0 else i % 6]
        rows.append((i, "w " * int(rng.integers(0, 60)), source, i))
    rows += [(1000, None, "none", 0), (1001, "  ", "none", 0), (5, rows[5][1], rows[5][2], 5), (None, "a b c", "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    plan = mixing.mix_plan(docs, [5, 2, 1]).collect()
    assert len(plan) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len((text or "").split())
    want = _targets(sizes, [5, 2, 1], 3)
    taken, largest = Counter(), Counter()
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["copies"] * r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - want[s]) <= max(largest[s], 1) for s in want)
    mixed = mixing.mix(docs, [5, 2, 1])
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in plan:
        copies[r["doc_id"], r["size"]] += r["copies"]
    got = Counter((r["doc_id"], len((r["text"] or "").split())) for r in mixed.collect())
    assert got == Counter({k: n for k, n in copies.items() if n})
    assert sorted(map(str, mixing.mix_plan(docs, [5, 2, 1]).collect())) == sorted(map(str, plan))
    assert mixing.mix(docs.limit(0), [5, 2, 1]).count() == 0
    odd = docs.limit(50).withColumns({c: F.lit(1) for c in ("mix_id", "mix_rows", "h", "size", "target", "text_tag", "p")})
    assert mixing.mix(odd, [5, 2, 1]).columns == odd.columns


def test_pivotal_rounding_keeps_expectations(spark):
    parts = spark.range(3000).select(
        F.lit("s").alias("source"), F.col("id"), F.xxhash64("id").alias("h"), (F.col("id") % 5 + 1).alias("size"), F.lit(0.3).alias("p")
    )
    means = []
    for seed in (1, 50, 900):
        got = mixing.round_copies(parts, seed, group_docs=16).agg(F.sum(F.col("up") * F.col("size")), F.sum("up"), F.count("*")).first()
        assert got[2] == 3000 and abs(got[0] - 0.3 * 9000) <= 5
        means.append(got[1] / 3000)
    assert abs(np.mean(means) - 0.3) < 0.03


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), rng.integers(-2, 3, 6).astype(float).tolist()) for i in rng.permutation(400)]
    vectors += [(900, None), (950, [float("nan")] * 6), (1000, [1.0] * 6), (1050, [1.0, 2.0]), (1051, [3.0, 4.0]), (50, [0.5] * 6), (None, [1.0] * 6), (1100, []), (1150, [float("inf")] + [0.0] * 5)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(frame, "vec_id", "embedding")
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and np.isfinite(v).all()]
    queries = ints.where("id % 50 = 0")
    for rows in (10_000, 9):
        found = defaultdict(list)
        for r in topk.top_k(queries, ints, 5, query_rows=3, shard_rows=rows).orderBy("query_id", "rank").collect():
            found[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
        for i, v in good:
            if i % 50 or i == 50 or not v:
                continue
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in good if j != i and len(w) == len(v))[:5]
            assert found[i] == [(j, -s, k + 1) for k, (s, j) in enumerate(best)]
    assert topk.top_k(queries.limit(0), ints, 5).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<div class="cookie-notice">We use cookies on this site, please read and accept this long notice before you go on.</div>
<header><h1>Site name</h1></header><nav><a href="/">one</a> <a href="/">two</a></nav>{open}<div id="content"><h1>Title &amp; more</h1>
<p>First paragraph  with a
 line end and <b>bold</b> text.</p><aside>Side text that is not part of it</aside><div class="advert">Buy now</div><p>Short.</p>
<ul><li>one<li>two</ul><form><input name="a"><button>Go</button></form><p>Last&nbsp;one.<br>Still &lt;it&gt;.</p></div>
<section class="comments"><p>Nice post, thanks a lot for it, I have read all of it.</p></section>{close}
<footer>&copy; site, all the rights are reserved here</footer></body></html>"""
MAIN = "Title & more\nFirst paragraph with a line end and bold text.\nShort.\none\ntwo\nLast one. Still <it>."


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<article>", "")])
def test_main_text_of_a_page(start, end):
    assert html_text.main_text(PAGE.replace("{open}", start).replace("{close}", end)) == MAIN


BODY = "".join(f"<p>Paragraph {i} of the story, with enough words to count as running text.</p>" for i in range(40))


def test_main_text_outside_of_a_card():
    """A short article element beside a long body, before, after and far from it."""
    want = [f"Paragraph {i} of the story, with enough words to count as running text." for i in range(40)]
    card = "<article><p>Another story that you may like to read as well, with a short line on it.</p></article>"
    for gap in ("", "<nav>x</nav>"):
        for page in (f"<div>{BODY}</div>{gap}{card}", f"{card}{gap}<div>{BODY}</div>"):
            assert [x for x in html_text.main_text(f"<body>{page}</body>").split("\n") if x.startswith("Para")] == want


def test_main_text_of_sibling_articles():
    parts = BODY.split("<p>Paragraph 20")
    page = f"<body><div>Menu</div><article>{parts[0]}</article><article><p>Paragraph 20{parts[1]}</article><p>End</p></body>"
    assert html_text.main_text(page).split("\n") == [
        f"Paragraph {i} of the story, with enough words to count as running text." for i in range(40)
    ]


@pytest.mark.parametrize("wrapper", [
    '<form id="aspnetForm">{}</form>', '<div class="page has-sidebar">{}</div>', '<div id="search"><div class="legal">{}</div></div>',
    '<form><div class="tags">{}', '<aside role="complementary">{}</aside>',
])
def test_main_text_in_a_wrapper(wrapper):
    around = '<nav>Menu of the site with some words in it</nav>{}<div class="sidebar">Side text that is not part of the story at all.</div>'
    inner = '<div class="share">Share this story with all of your friends and others.</div>'
    page = "<body>" + around.format(wrapper.format(BODY + inner)) + "</body>"
    assert html_text.main_text(page).split("\n") == [
        f"Paragraph {i} of the story, with enough words to count as running text." for i in range(40)
    ]


def test_wrappers_that_stay_dropped():
    hidden = '<div class="sidebar" style="display: none">' + BODY + "</div>"
    story = "<p>A story that is short but long enough to be found as a stretch of text.</p>"
    for page in (f"<div>{story}</div>{hidden}", f'<div>{story}</div><div hidden><form>{BODY}</form></div>', f'<div>{story}</div><div class="site-footer">Some text of it</div>'):
        assert html_text.main_text(f"<body>{page}</body>") == story[3:-4]


def test_main_text_of_an_article_with_lists_of_links():
    """The parts of an article count as one against a text beside it."""
    links = '<ul>' + '<li><a href="/">link to more of it</a></li>' * 5 + '</ul>'
    section = "<p>" + "a part of the article " * 20 + "</p>"
    page = f"<body><article>{(section + links) * 4}</article><nav>x</nav><div><p>{'some other text ' * 50}</p></div></body>"
    text = html_text.main_text(page)
    assert text.count("a part of the article") == 80 and "other" not in text


def test_odd_pages(spark):
    pages = [None, "", "plain & text", "<p>a<p>b", '<div class="ad">x<div>open<article><p>hello there</p></article>', "<" * 50, "<!-- open", "<p>" + "x" * 200_000]
    want = ["", "", "plain & text", "a\nb", "hello there", None, "", "x" * 200_000]
    frame = spark.createDataFrame([(i, "u", p, "t", "c") for i, p in enumerate(pages)], "page_id long, url string, html string, text string, other string")
    found = html_text.extract_main_text(frame)
    assert found.columns == ["page_id", "url", "other", "text", "n_chars"]
    for r in found.collect():
        assert r["n_chars"] == len(r["text"]) and want[r["page_id"]] in (None, r["text"])
    assert html_text.extract_main_text(frame.limit(0)).count() == 0


def test_pages_of_the_data(spark):
    import re

    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    found = html_text.extract_main_text(rows).join(rows.select("page_id", "html"), "page_id").collect()
    for r in found:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        assert re.sub(r"\s+", "", html_text.html.unescape(re.sub(r"<[^>]*>", " ", article))) == re.sub(r"\s+", "", r["text"])


def test_toxicity_on_held_out_labels(spark):
    data = DATA.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = toxicity.fit(docs, labels.where(toxicity.training_half()))
    scored = toxicity.score(docs, model).join(labels, "doc_id").where(~toxicity.training_half())
    rows = scored.select("toxic", "score").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.85
    ones, zeros = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.85


def test_classifiers_without_labels_and_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "x" * 100_000, "c"), (3, "y", "d"), (3, "y", "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(3, 1), (None, 0), (2, 7)], "doc_id long, toxic int")
    for labels in (none, one):
        model = toxicity.fit(docs, labels)
        scores = [r["score"] for r in toxicity.score(docs, model).collect()]
        assert len(scores) == 5 and len(set(scores)) == 1 and 0 <= scores[0] <= 1
        kept = toxicity.without_toxic(docs, model)
        assert kept.columns == docs.columns
    assert toxicity.score(docs.limit(0), model).count() == 0
    for labels in (none, one):
        model = cotraining.fit(docs, labels, "toxic", ["doc_id"])
        assert all(0 <= r["score"] <= 1 for r in cotraining.score(docs.drop("score"), model, ["doc_id"]).collect())


def test_co_training_on_held_out_labels(spark):
    data, meta = DATA.replace("sf0.001", "sf0.01"), ["lang", "source", "n_chars"]
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = cotraining.fit(docs, labels.where(toxicity.training_half()), "quality", meta)
    rows = cotraining.score(docs, model, meta).join(labels, "doc_id").where(~toxicity.training_half()).select("quality", "score").collect()
    ones, zeros = ([r["score"] for r in rows if r["quality"] == t] for t in (1, 0))
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9


def test_co_training_teaches_the_weaker_view():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 3000).astype(float)
    view = lambda d: np.column_stack([y[:, None] * 2 - 1 + rng.standard_normal((3000, d)) * 1.5, np.ones(3000)])
    a, b = view(6), view(3)
    model = cotraining.co_train([a[:60], b[:60]], y[:60], [a[60:2000], b[60:2000]])
    scores = model.scores(a[2000:], b[2000:])
    right = ((scores >= 0.5) == (y[2000:, None] == 1)).mean(axis=0)
    assert right[2] >= right[1] - 0.02 and right[2] > 0.9


@pytest.mark.parametrize(
    "piece", ["<div ", '<a "', "<a '", "<div =\"", "<script ", "<!", "</", "<!--", "<![CDATA[", "<svg>x</svg ", "<p title=don't>", "<a \"x' ", "< = ", "<style>"]
)
def test_malformed_pages_take_time_in_proportion(piece):
    import time

    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 10
    story = "<p>" + "A sentence of the story that is long enough to stay. " * 4 + "</p>"
    assert "sentence of the story" in html_text.main_text(f"<article>{story * 3}</article>{piece * 3}")


def test_tags_without_an_end_and_quotes_in_tags():
    story = "A sentence of the story that is long enough to stay, and then some more of it."
    page = f"<article><p title=don't>{story}</p><p data-x=\"a < b > c\">{story}</p><p class='x' {'<b'}>{story}</b></p><script data-x=\"a<b\">code()</script></article>"
    assert html_text.main_text(page) == "\n".join([story] * 3)


@pytest.mark.parametrize(
    ("element", "stays"),
    [("section id='search-algorithms'", True), ("div class='legal-analysis'", True), ("div class='side-effects'", True), ("section id='form-and-function'", True),
     ("p class='related-work'", True), ("div class='share-buttons'", False), ("div class='related-posts'", False), ("div class='newsletter-signup'", False), ("aside", False)],
)
def test_sections_of_an_article_named_by_their_subject_stay(element, stays):
    story = "A sentence of the story that is long enough to stay, and then some more of it. " * 2
    page = f"<body><article><h1>Title</h1><p>{story}</p><{element}>{story} within</{element.split()[0]}><p>{story}</p></article></body>"
    assert ("within" in html_text.main_text(page)) == stays


def test_repeated_rows_are_mixed_and_packed_like_others(spark):
    """One row 30,000 times: rounded as one item, written out again, and dealt over all groups."""
    p = 0.3701
    parts = spark.range(30_500).select(
        F.lit("s").alias("source"), F.greatest(F.col("id"), F.lit(30_000)).alias("id"), F.lit(1).cast("long").alias("h"),
        F.lit(7).cast("long").alias("size"), F.lit(p).alias("p"),
    )
    ups = mixing.round_copies(parts, group_docs=16)
    by_id = {r["id"]: (r["n"], r["up"]) for r in ups.groupBy("id").agg(F.count("*").alias("n"), F.sum("up").alias("up")).collect()}
    assert by_id[30_000][0] == 30_001 and abs(by_id[30_000][1] - 30_001 * p) < 1
    assert len(by_id) == 500 and all(n == 1 and up in (0, 1) for i, (n, up) in by_id.items() if i != 30_000)
    assert abs(sum(up for _, up in by_id.values()) - 30_500 * p) <= 0.5 + 1e-6
    pieces = spark.range(4_000).select(
        F.lit(1).alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("length"),
        F.lit(9).cast("long").alias("ids_crc32"), F.lit(5).cast("long").alias("doc_tokens"),
    )
    packed = packing.pack(pieces, 16, group_pieces=500)
    assert packed.groupBy(F.shiftright("sequence_id", 40)).count().agg(F.max("count")).first()[0] < 700
    assert packed.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty() and packed.count() == 4_000


def test_scores_beyond_a_long_count_as_its_end(spark):
    rows = [(1, [1e300, 1.0]), (2, [1e300, 2.0]), (3, [-1e300, 0.0]), (4, [1e14, -1.0]), (5, [0.0, 3.0])]
    vectors = topk.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    kept = {r["id"]: [int(x) for x in r["v"]] for r in vectors.collect()}
    end = 2**63 - 1
    want = []
    for q, a in kept.items():
        scores = sorted((-max(-end, min(end, sum(x * y for x, y in zip(a, b, strict=True)))), i) for i, b in kept.items() if i != q)
        want += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:3])]
    assert sorted(map(tuple, topk.top_k(vectors, vectors, 3).collect())) == sorted(want)
