"""Queries on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from chronostrata.plans import links, objects, playback, reading, records, scalars, sessions, streams, timeline, transactions, validation

FAMILIES = (timeline, links, scalars, objects, validation, records, streams, transactions, playback, reading, sessions)
QUERIES = {k: v for f in FAMILIES for k, v in f.QUERIES.items()}
ORACLES = {k: v for f in FAMILIES for k, v in f.ORACLES.items()}
