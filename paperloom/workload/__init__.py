"""The registered queries over the given tables, with their SQL oracles.

Each module holds ``QUERIES`` (name -> function of a session and a folder) and ``SQL`` (name -> the same
question asked in plain SQL, written independently of the Spark code).
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "assessment",
    "scalars",
    "corpus",
    "audits",
    "labelling",
    "training",
    "sheets",
    "numbering",
    "people",
    "changes",
    "quality",
    "streams",
    "stored",
)


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{name}"), attribute).items():
            if key in found:
                raise ValueError(f"query {key} is registered twice")
            found[key] = value
    return found


def all_queries() -> dict:
    return _gather("QUERIES")


def all_sql() -> dict:
    return _gather("SQL")
