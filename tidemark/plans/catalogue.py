"""All queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from tidemark.plans import activity, episodes, evidence, filtering, ingest, lifecycle, memory, persona, prompts, recall, rendering, search, social  # noqa: F401  they register their queries
from tidemark.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
