"""The catalogue of queries and of the SQL that checks them."""

from __future__ import annotations

from corpusmill.plans import curation, dialogue, matching, metrics

_MODULES = (curation, dialogue, matching, metrics)

QUERIES: dict = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
