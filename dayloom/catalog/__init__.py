"""Named queries on the shared test tables, each with an equivalent SQL text where SQL can say it."""

from __future__ import annotations

from dayloom.catalog import daily, forests, models, reports, samples, stored, streams, tables
from dayloom.catalog.base import Query

QUERIES: dict[str, Query] = {}
for _module in (samples, daily, tables, models, forests, streams, reports, stored):
    for _q in _module.QUERIES:
        if _q.name in QUERIES:
            raise ValueError(f"query {_q.name} registered twice")
        QUERIES[_q.name] = _q
