"""All queries of the engine over the driver's tables, with the SQL each is held against."""

from __future__ import annotations

from granary.plans import documents, naming, pages, parsed, relational, stages, stored

_MODULES = (documents, parsed, pages, naming, relational, stages, stored)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _MODULES for k, v in m.oracle_sql().items()}
