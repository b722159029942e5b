"""Named queries over the standard tables, each next to the SQL it must agree with."""

from __future__ import annotations

from leakscan.catalog import document_models, features, files, learning, models, pii, profiling, synthesis, vectors

_MODULES = (pii, features, profiling, learning, vectors, files, synthesis, models, document_models)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
