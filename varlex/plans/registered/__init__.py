"""Registered queries: every operator over the given tables, with reference SQL."""

from varlex.plans.registered import embedding, harmonising, indexing, observing, scanning, searching

_MODULES = (scanning, harmonising, embedding, searching, indexing, observing)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
