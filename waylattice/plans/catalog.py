"""All queries outside the optional subpackage, with their SQL."""

from __future__ import annotations

from . import loop_queries, map_queries, mapping_queries, recall_queries, rule_queries, sensor_queries, stateful_queries, trajectory_queries
from .views import nan_safe

_MODULES = (sensor_queries, trajectory_queries, loop_queries, map_queries, stateful_queries, rule_queries, recall_queries, mapping_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: nan_safe(v) for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = trajectory_queries.ate_3d
