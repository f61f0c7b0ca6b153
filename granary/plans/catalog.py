"""All queries of the engine's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from granary.plans import checks, details, ingestion, retrieval, service, text, usage

QUERIES: dict = {**retrieval.QUERIES, **text.QUERIES, **usage.QUERIES, **checks.QUERIES, **details.QUERIES, **ingestion.QUERIES, **service.QUERIES}
ORACLE_SQL: dict[str, str] = {**retrieval.SQL, **text.SQL, **usage.SQL, **checks.SQL, **details.SQL, **ingestion.SQL, **service.SQL}
