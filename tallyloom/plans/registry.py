"""All registered queries of the library (the training-data operators add theirs in the entry module)."""

from __future__ import annotations

from tallyloom.plans import catalog, details, documents, ingest, lookup, matching, resolution, rules, text, timeline, vectors, windows
from tallyloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "catalog", "details", "documents", "ingest", "lookup", "matching", "resolution", "rules", "text", "timeline", "vectors", "windows"]
