"""All registered queries and their checks."""

from __future__ import annotations

from riskloom.plans import catalog_checks, catalog_inputs, catalog_labels, catalog_models  # noqa: F401
from riskloom.plans.registry import QUERIES, Runner


def queries() -> dict[str, Runner]:
    return {name: q.run for name, q in QUERIES.items()}


def checks() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql is not None}
