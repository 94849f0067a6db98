"""Token ids of whole texts by the tokenizers library, with a word cache in front of it.

A byte-level vocabulary always starts a new token before a single space that stands between
two other characters. A text is therefore the sequence of its words, each with the space
before it, and the ids of a word do not depend on its neighbours. Words that a worker has not
met are encoded together; texts with other white space between words, or with the string of
an added token, are left to the library as a whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .batches import steps

#: Words that a Python worker keeps; later ones are encoded again for each batch.
CACHE_WORDS = 500_000
_JOINED = 256
#: Characters of text that are worked on together; only memory depends on it.
_STEP_CHARS = 1 << 23
_ENDS = ".,;:!?"


class WordTokenizer:
    """ids of texts as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added_tokens = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, self.added_tokens))) if self.added_tokens else None
        blank = next(iter(self.library.encode(" ", add_special_tokens=False).tokens))
        self.starts_word = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.starts_word[i] = token.startswith(blank)
        self.words: dict[str, bytes] = {}
        self.ends = {x: self.whole(x) for x in _ENDS}

    def whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str], known: dict[str, bytes]) -> None:
        """Encode words, each after a space, many at a time."""
        parts = [words[i : i + _JOINED] for i in range(0, len(words), _JOINED)]
        coded = self.library.encode_batch_fast([" " + " ".join(p) for p in parts], add_special_tokens=False)
        for part, code in zip(parts, coded, strict=True):
            ids = np.asarray(code.ids, "<u4")
            at = np.flatnonzero(self.starts_word[ids])
            if len(at) == len(part):
                at = [*(4 * at).tolist(), 4 * len(ids)]
                ids = ids.tobytes()
                for i, word in enumerate(part):
                    known[word] = ids[at[i] : at[i + 1]]
            else:
                for word in part:
                    known[word] = self.whole(" " + word)

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        sizes = np.cumsum([0, *(len(t) for t in texts)])
        for i, j in steps(sizes, _STEP_CHARS):
            out += self._encode(texts[i:j])
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Words are split, told apart and put together again by arrays; only different ones are handled one by one."""
        column = pa.array(texts, pa.large_string())
        split = pc.split_pattern(column, " ")
        bounds = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        places, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        starts = places[bounds[:-1]]
        later = np.ones(len(places), bool)
        later[bounds[:-1]] = False
        used = np.zeros(len(words), bool)
        used[places[later]] = True
        ids = list(map(self.words.get, words))
        new = [i for i in np.flatnonzero(used).tolist() if ids[i] is None]
        torn = np.zeros(len(words) + len(texts), bool)
        torn[[i for i in new if not (w := words[i]) or w[-1].isspace() or self.added and self.added.search(w)]] = True
        new = [i for i in new if not torn[i]]
        known = self.words if len(self.words) < CACHE_WORDS else _Later(self.words)
        self._learn_all([words[i] for i in new], known)
        for i in new:
            ids[i] = known[words[i]]
        for i in np.flatnonzero(~used | torn[: len(words)]).tolist():
            ids[i] = ids[i] or b""
        # The first word of a text has no blank before it and is encoded on its own.
        ids += [self.whole(words[i]) for i in starts.tolist()]
        places[bounds[:-1]] = np.arange(len(words), len(words) + len(texts))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        data, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
        n = sizes[places]
        ends = np.append(0, np.cumsum(n))
        whole = data[np.arange(ends[-1]) + np.repeat(begin[places] - ends[:-1], n)].tobytes()
        at = (4 * ends[bounds]).tolist()
        odd = np.add.reduceat(torn[places], bounds[:-1]) > 0
        odd |= np.array([words[i][-1:].isspace() for i in starts.tolist()])
        for token in self.added_tokens:
            odd |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        return [self.whole(text) if o else whole[at[i] : at[i + 1]] for i, (text, o) in enumerate(zip(texts, odd.tolist(), strict=True))]

    def _learn_all(self, unknown: list[str], known: dict[str, bytes]) -> None:
        ended = [(w, stem) for w in unknown if w[-1] in self.ends and (stem := w[:-1]).isalpha()]
        rest = set(unknown).difference(w for w, _ in ended)
        rest.update(stem for _, stem in ended if stem not in self.words)
        self._learn(list(rest), known)
        for word, stem in ended:
            known[word] = known[stem] + self.ends[word[-1]]


class _Later(dict):
    """The words of one batch, once the kept ones are full."""

    def __init__(self, kept: dict[str, bytes]):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: str) -> bytes:
        return self.kept[word]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker."""
    return WordTokenizer(path)
