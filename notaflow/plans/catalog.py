"""Registered queries of the engine's own operators, each with the SQL that checks it."""

from . import batch, cascades, context, documents, health, lines, reports, runs, scalar, whole

_PARTS = (scalar, batch, reports, documents, context, health, whole, lines, runs, cascades)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}
FLAGSHIP = "quality_by_type"
