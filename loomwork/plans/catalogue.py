"""All named queries over the driver's tables, each with an equivalent SQL statement where SQL has one."""

from __future__ import annotations

from . import changes, graphs, lookups, observed, ordered, parsing, rollups, service, texts, timers, wordings

_PARTS = (changes, rollups, ordered, texts, parsing, service, lookups, timers, graphs, wordings, observed)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
