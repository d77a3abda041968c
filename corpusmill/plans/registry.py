"""The queries over the driver tables and their SQL."""

from __future__ import annotations

import importlib

from ..session import shipped

#: Modules with QUERIES: name -> (query, SQL or None).
MODULES = ["search", "texts", "ordered", "linking", "laid_out", "evaluating", "judged"]


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f".{name}", __package__).QUERIES
    return out


def queries() -> dict:
    return {name: shipped(q) for name, (q, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
