"""Near matches of keywords in a text, for spelling variants.

Spark has no matching-blocks ratio, so this is one Arrow UDF over the text column. It
needs no shuffle: each batch compares its distinct words (or word windows) with the
keywords, a bounded number of words at a time, and a letter count that bounds the ratio
from above leaves few pairs to score.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 64
#: Words that are compared together; only memory depends on it.
STEP_WORDS = 1 << 16


@lru_cache(maxsize=1 << 16)
def ratio(a: str, b: str) -> int:
    """2 * matching characters / all characters, as a whole percent."""
    return int(round(100 * SequenceMatcher(None, a, b).ratio()))


def letter_counts(texts: list[str]) -> np.ndarray:
    """Letters per bucket; two letters may share one, which only raises the bound."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    counts = np.bincount(row * BUCKETS + codes % BUCKETS, minlength=len(texts) * BUCKETS)
    return counts.astype(np.int32).reshape(-1, BUCKETS)


def windows(ids: np.ndarray, start: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of n word numbers, and for every start the number of its window."""
    code = ids[start]
    for j in range(1, n):
        code = np.unique(code * size + ids[start + j], return_inverse=True)[1].reshape(-1)
    _, first, place = np.unique(code, return_index=True, return_inverse=True)
    return np.stack([ids[start[first] + j] for j in range(n)], axis=1), place.reshape(-1)


def word_steps(texts: list[str], overlap: int) -> Iterator[tuple[list[str], list[int]]]:
    """(words, text of each word), some ``STEP_WORDS`` at a time; the parts of a text that is
    cut share ``overlap`` words, so that no window is lost."""
    words: list[str] = []
    owner: list[int] = []
    for i, rest in enumerate(texts):
        last: list[str] = []
        while rest:
            part = rest.split(None, STEP_WORDS)
            rest = part.pop() if len(part) > STEP_WORDS else ""
            part = last + part
            last = part[len(part) - overlap :] if len(part) > overlap else part
            words += part
            owner += [i] * len(part)
            if len(words) >= STEP_WORDS:
                yield words, owner
                words, owner = [], []
    if words:
        yield words, owner


def near_matches(texts: list[str], keywords: list[str], percent: float) -> list[set[str]]:
    """Per text the keywords that a word, or a window of as many words, comes close to."""
    found: list[set[str]] = [set() for _ in texts]
    longest = max((len(k.split()) for k in keywords), default=1)
    for words, owner in word_steps(texts, longest - 1):
        _match(words, np.array(owner), keywords, percent, found)
    return found


def _match(words: list[str], owner: np.ndarray, keywords: list[str], percent: float, found: list[set[str]]) -> None:
    """Add the keywords that the words of one step come close to."""
    ids, vocabulary = pd.factorize(np.array(words, dtype=object))
    counts = letter_counts(list(vocabulary))
    lengths = np.array([len(w) for w in vocabulary])
    for n in {len(k.split()) for k in keywords}:
        start = np.arange(len(ids) - n + 1)
        if not len(start):
            continue
        start = start[owner[start] == owner[start + n - 1]]
        if not len(start):
            continue
        grams, place = windows(ids, start, n, len(vocabulary))
        gram_length = lengths[grams].sum(axis=1) + n - 1
        for k in (k for k in keywords if len(k.split()) == n):
            form = k.lower()
            need = (percent - 0.5) / 100 * (gram_length + len(form)) / 2
            fits = np.flatnonzero(np.minimum(gram_length, len(form)) >= need)
            letters = sum(counts[grams[fits, j]] for j in range(n))
            letters[:, ord(" ") % BUCKETS] += n - 1
            shared = np.minimum(letters, letter_counts([form])).sum(axis=1)
            hits = [
                g
                for g in fits[shared >= need[fits]]
                if ratio(" ".join(vocabulary[grams[g]]), form) >= percent
            ]
            for i in np.unique(owner[start[np.isin(place, hits)]]):
                found[i].add(k)


def near_keywords(texts: list[Column], keywords: list[str], threshold: float) -> Column:
    """For each of ``texts`` an array of the keywords with a near match, all in one pass.

    ``threshold`` is a share, 0.85 in the default rules. Equal texts of a batch are compared
    once, and a pair of a word and a keyword is scored once per worker, as long as it is kept.
    """

    @F.pandas_udf("array<array<string>>")
    def near(*columns: pd.Series) -> pd.Series:
        place, distinct = pd.factorize(pd.concat(columns, ignore_index=True).fillna("").str.lower())
        hits = near_matches(list(distinct), keywords, threshold * 100)
        found = [[k for k in keywords if k in h] for h in hits]
        rows = place.reshape(len(columns), -1).T.tolist()
        return pd.Series([[found[i] for i in row] for row in rows], index=columns[0].index, dtype=object)

    return near(*texts)
