"""Query registry: every implemented operator as ``(spark, sf_dir) -> DataFrame``
plus, where SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

import importlib

PLAN_MODULES = [
    "textlab.plans.social",
    "textlab.plans.text",
    "textlab.plans.evaluation",
    "textlab.plans.ingest",
    "textlab.plans.vocab",
    "textlab.plans.topics",
    "textlab.plans.models",
]


def _collect():
    queries, sql = {}, {}
    for name in PLAN_MODULES:
        mod = importlib.import_module(name)
        for k, fn in mod.QUERIES.items():
            if k in queries:
                raise ValueError(f"duplicate query {k}")
            queries[k] = fn
        sql.update(getattr(mod, "SQL", {}))
    missing = set(sql) - set(queries)
    if missing:
        raise ValueError(f"oracle without query: {sorted(missing)}")
    return queries, sql


def queries():
    return _collect()[0]


def oracle_sql():
    return _collect()[1]
