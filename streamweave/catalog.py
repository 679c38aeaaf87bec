"""All queries of the library by name, with their DuckDB oracles."""

from __future__ import annotations

from streamweave.plans import area_queries, flow_queries, network_queries, relational_queries, series_queries

QUERIES = {**series_queries.Q, **relational_queries.Q, **network_queries.Q, **area_queries.Q, **flow_queries.Q}
ORACLE_SQL = {**series_queries.SQL, **relational_queries.SQL, **network_queries.SQL, **area_queries.SQL, **flow_queries.SQL}
