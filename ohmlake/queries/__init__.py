"""Driver queries of the operators, over the given tables or tables that Spark derives from them."""

from __future__ import annotations

from . import circuits, streams, texts
from .base import with_derived

MODULES = [circuits, texts, streams]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: with_derived(sql) for m in MODULES for name, sql in m.SQL.items()}
