"""Operators of a training-data pipeline, with their registered queries.

Each module holds one operator, ``QUERIES`` and ``SQL`` (none where SQL cannot express it; a brute-force version in the
tests stands in). Nothing else in the library imports this subpackage. All modules are imported with it, so that a missing
requirement shows where the subpackage is asked for.
"""

from __future__ import annotations

from paperloom.llm import bpe, compression, embeddings, langid, lines, middle, mixing, pii, resample, secret_scan, sharding, simhash, urls

import corpus_pipeline  # isort: skip  # stages are made of the operators above

MODULES = (embeddings, simhash, pii, sharding, mixing, compression, bpe, langid, lines, urls, middle, resample, secret_scan)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for module in MODULES:
        found |= getattr(module, attribute)
    return found


def all_queries() -> dict:
    """Every operator's query, and the pipeline that joins five of them."""
    return _gather("QUERIES") | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict:
    return _gather("SQL")
