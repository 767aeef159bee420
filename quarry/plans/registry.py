"""All queries of the library and the SQL that says the same."""

from __future__ import annotations

from quarry.plans import analytics, entities, ingest, retrieval, rules, sessions, snapshot, streams, webhooks

FAMILIES = (retrieval, analytics, entities, rules, sessions, ingest, streams, snapshot, webhooks)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
