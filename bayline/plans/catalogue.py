"""All registered analytics queries with their SQL counterparts."""

from __future__ import annotations

from bayline.plans import catalogues, comparisons, evaluation, fitted, observations, records, regions, runs, scenes

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (runs, observations, catalogues, scenes, comparisons, evaluation, records, fitted, regions):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
