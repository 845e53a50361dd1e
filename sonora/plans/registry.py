"""All queries of the reference's own operators, by name."""

from sonora.plans import results, scoring, signals, texts

_MODULES = (scoring, texts, signals, results)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
