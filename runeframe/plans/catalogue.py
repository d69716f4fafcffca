"""All named queries of the core."""

from __future__ import annotations

from runeframe.plans import cipher, corpus, notation, packed, search, sessions, stats, streams

MODULES = (sessions, packed, stats, cipher, notation, search, corpus, streams)
FLAGSHIP = "flagship"


def queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
