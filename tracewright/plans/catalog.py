"""Registered queries of the engine and their DuckDB oracles, by theme."""

from __future__ import annotations

from tracewright.plans import checks, evaluation, labelling, records, rewarding, selection, text

QUERIES: dict = {}
ORACLES: dict = {}
for _part in (selection, text, evaluation, labelling, rewarding, checks, records):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
