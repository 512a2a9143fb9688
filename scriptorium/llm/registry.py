"""All queries of the subpackage and the SQL for them."""

from __future__ import annotations

import importlib

MODULES = ["neighbours", "sharding", "chat", "mixing", "simhash", "licenses", "parsing", "bpe", "pii", "quality"]
_LOADED = [importlib.import_module(f"{__package__}.{m}") for m in MODULES]
QUERIES = {k: q for m in _LOADED for k, q in m.QUERIES.items()}
ORACLE = {k: q for m in _LOADED for k, q in m.ORACLE.items()}
