"""All queries on the driver's tables, by name, each with the DuckDB SQL of the same result where SQL has one."""

from __future__ import annotations

from . import grid_queries, match_queries, sim_queries, system_queries

QUERIES: dict = {**grid_queries.QUERIES, **match_queries.QUERIES, **system_queries.QUERIES, **sim_queries.QUERIES}
ORACLES: dict = {**grid_queries.ORACLES, **match_queries.ORACLES, **system_queries.ORACLES}
