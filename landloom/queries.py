"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from landloom.plans import q_functions, q_jobs, q_land, q_spatial

_MODULES = (q_functions, q_spatial, q_land, q_jobs)
QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _m in _MODULES:
    QUERIES |= _m.Q
    ORACLE_SQL |= _m.SQL
FLAGSHIP = q_jobs.flagship
