"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from . import (
    filter_queries,
    intent_queries,
    labeling_queries,
    metric_queries,
    series_queries,
    source_queries,
    text_queries,
    vector_queries,
)

MODULES = [
    filter_queries,
    metric_queries,
    series_queries,
    text_queries,
    labeling_queries,
    intent_queries,
    vector_queries,
    source_queries,
]


def catalog() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, pair in module.entries().items():
            if name in out:
                raise ValueError(f"query registered twice: {name}")
            out[name] = pair
    return out
