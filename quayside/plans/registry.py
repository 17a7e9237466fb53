"""Registered queries and their oracle SQL, by name."""

from __future__ import annotations

from . import entity_queries, feed_queries, lookup_queries, state_queries

_MODULES = (feed_queries, entity_queries, state_queries, lookup_queries)

QUERIES = {name: run for module in _MODULES for name, run in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
