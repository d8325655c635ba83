"""All queries of the library's own operators, with the SQL that gives the same rows."""

from __future__ import annotations

from quern.plans import REGISTRY

QUERIES = {name: q for part in REGISTRY for name, q in part.QUERIES.items()}
SQL = {name: s for part in REGISTRY for name, s in part.SQL.items()}
