"""Queries of the engine's own operators, with the SQL that must give the same rows."""

from __future__ import annotations

from isobath.plans import closed_forms, estimates, files, marches, relational, scenarios, searches, systems

_MODULES = (closed_forms, relational, marches, estimates, scenarios, files, systems, searches)
QUERIES = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
