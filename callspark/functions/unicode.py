"""Compatibility decomposition of text, the one text step Spark has no function for."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that are Python strings at once; only memory depends on it.
STEP_ROWS = 64


def decomposed(texts: pa.Array) -> pa.Array:
    """NFKD form of an Arrow column."""
    parts = (texts.slice(i, STEP_ROWS).to_pylist() for i in range(0, len(texts), STEP_ROWS))
    done = [pa.array([t and unicodedata.normalize("NFKD", t) for t in part], texts.type) for part in parts]
    return pa.concat_arrays(done) if done else texts


def nfkd(text: Column) -> Column:
    """NFKD form. Only texts with a non-ASCII character travel to Python.

    A batch stays in Arrow but for a few texts at a time, as Python strings take several times
    their bytes.
    """

    @F.arrow_udf("string")
    def decompose(texts: pa.Array) -> pa.Array:
        return decomposed(texts)

    foreign = text.rlike("[^\\x00-\\x7f]")
    return F.coalesce(decompose(F.when(foreign, text)), text)
