"""Queries over the driver's tables, one for each operator, with SQL for the other engine."""

from . import aggregates, documents, games, joins, ordered, scalars, teams

_PARTS = (aggregates, ordered, joins, scalars, documents, teams, games)
QUERIES = {name: f for part in _PARTS for name, f in part.registry.queries.items()}
ORACLE_SQL = {name: sql for part in _PARTS for name, sql in part.registry.sql.items()}
