"""Text columns. All of them stay in the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words. The first ten are ASCII.
ASCII_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "
OTHER_BLANKS = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# A class of single ASCII characters is one bit test per letter; ranges and far letters
# in the class make the scan several times slower, so the other blanks go first.
BLANKS = "[\\t\\n\\x0b\\f\\r\\x1c\\x1d\\x1e\\x1f ]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``."""
    return F.transform(F.array(value), body)[0]


def ascii_blanks(text: Column) -> Column:
    """The text with every other blank turned into a plain one; most texts have none."""

    def swap(t: Column) -> Column:
        has_other = reduce(or_, [F.contains(t, F.lit(c)) for c in OTHER_BLANKS])
        return F.when(has_other, F.translate(t, OTHER_BLANKS, " " * len(OTHER_BLANKS))).otherwise(t)

    return let(text, swap)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(ASCII_BLANKS + OTHER_BLANKS))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_blanks(text), BLANKS, " "))


def words(text: Column) -> Column:
    """Blank-separated words; an empty text has none."""
    return F.filter(F.split(ascii_blanks(text), BLANKS), lambda w: w != "")


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, "[.!?]+"), strip)
    return F.filter(parts, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, "\n\n"), strip)
    return F.filter(parts, lambda p: p != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def round_up(value: Column, digits: int) -> Column:
    """Round half up; one formula, so that every engine gives the same digits."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / F.lit(scale)


def last_position(text: Column, char: str) -> Column:
    """1-based position of the last ``char``; 0 when absent."""
    found = F.instr(F.reverse(text), char)
    return F.when(found > 0, F.length(text) - found + 1).otherwise(F.lit(0))


def counted(tokens: Column) -> Column:
    """Array of (word, n, first) per distinct word of an array.

    Sorts (word, position) pairs and cuts the runs of equal words, which is
    n log n per row and needs neither an explode nor a shuffle.
    """
    pairs = F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(p: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(p) - 1),
            lambda i: (i == 0) | (F.get(p, i)["w"] != F.get(p, i - 1)["w"]),
        )

        def cut(s: Column) -> Column:
            ends = F.concat(F.slice(s, 2, F.size(s)), F.array(F.size(p)))
            return F.zip_with(
                s,
                ends,
                lambda a, b: F.struct(
                    F.get(p, a)["w"].alias("word"),
                    (b - a).alias("n"),
                    F.get(p, a)["i"].alias("first"),
                ),
            )

        return let(starts, cut)

    empty = F.filter(
        F.array(F.struct(F.lit("").alias("word"), F.lit(0).alias("n"), F.lit(0).alias("first"))),
        lambda r: r["n"] > 0,
    )
    return F.when(F.size(tokens) > 0, let(pairs, runs)).otherwise(empty)


def top_words(tokens: Column, k: int) -> Column:
    """The k most frequent words of an array, ties by first occurrence."""
    ranked = F.sort_array(
        F.transform(
            counted(tokens),
            lambda r: F.struct((-r["n"]).alias("o"), r["first"].alias("first"), r["word"].alias("word")),
        )
    )
    return F.transform(
        F.slice(ranked, 1, k), lambda r: F.struct(r["word"].alias("word"), (-r["o"]).alias("n"))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 when a text is empty."""

    def of_sets(s: Column) -> Column:
        return F.when(
            F.size(F.array_union(s["a"], s["b"])) > 0,
            F.size(F.array_intersect(s["a"], s["b"])) / F.size(F.array_union(s["a"], s["b"])),
        ).otherwise(F.lit(1.0))

    value = let(F.struct(word_set(a).alias("a"), word_set(b).alias("b")), of_sets)
    return _unless_empty(a, b, value)


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two texts; 0 when a text is empty.

    Walks the words of both texts in order once. A word whose count goes from c to
    c + 1 adds 2c + 1 to its squared norm; a word of text b adds its count in a to the
    dot product, because the words of a come first within a run.
    """
    pairs = F.sort_array(
        F.concat(
            F.transform(words(F.lower(a)), lambda w: F.struct(w.alias("w"), F.lit(0).alias("s"))),
            F.transform(words(F.lower(b)), lambda w: F.struct(w.alias("w"), F.lit(1).alias("s"))),
        )
    )
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        F.lit("").alias("w"),
        zero.alias("ca"),
        zero.alias("cb"),
        zero.alias("dot"),
        zero.alias("na"),
        zero.alias("nb"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = acc["w"] == x["w"]
        ca = F.when(same, acc["ca"]).otherwise(zero)
        cb = F.when(same, acc["cb"]).otherwise(zero)
        in_a = x["s"] == 0
        return F.struct(
            x["w"].alias("w"),
            F.when(in_a, ca + 1).otherwise(ca).alias("ca"),
            F.when(in_a, cb).otherwise(cb + 1).alias("cb"),
            F.when(in_a, acc["dot"]).otherwise(acc["dot"] + ca).alias("dot"),
            F.when(in_a, acc["na"] + 2 * ca + 1).otherwise(acc["na"]).alias("na"),
            F.when(in_a, acc["nb"]).otherwise(acc["nb"] + 2 * cb + 1).alias("nb"),
        )

    def finish(acc: Column) -> Column:
        norm = F.sqrt(acc["na"].cast("double")) * F.sqrt(acc["nb"].cast("double"))
        return F.when(norm > 0, acc["dot"] / norm).otherwise(F.lit(0.0))

    return _unless_empty(a, b, F.aggregate(pairs, start, step, finish))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when a text is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return _unless_empty(a, b, 1 - F.levenshtein(a, b) / longest)


SIMILARITIES = {"jaccard": jaccard, "cosine": bag_cosine, "levenshtein": edit_similarity}


def similarity(a: Column, b: Column, method: str = "jaccard") -> Column:
    if method not in SIMILARITIES:
        raise ValueError(f"unknown similarity method: {method}")
    return SIMILARITIES[method](a, b)


def _unless_empty(a: Column, b: Column, value: Column) -> Column:
    filled = (F.coalesce(F.length(a), F.lit(0)) > 0) & (F.coalesce(F.length(b), F.lit(0)) > 0)
    return F.when(filled, value).otherwise(F.lit(0.0))
