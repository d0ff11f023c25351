"""All queries over the record, with their DuckDB SQL."""

from __future__ import annotations

from . import analytics, changes, entities, intake, loop, process, rebuilt, reporting, upkeep

_PARTS = (analytics, process, entities, intake, reporting, upkeep, changes, loop, rebuilt)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
