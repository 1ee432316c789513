"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from threatloom.plans import detect, ingest, learn, streams, texts

MODULES = (ingest, texts, detect, learn, streams)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
