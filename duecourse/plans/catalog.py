"""All registered queries of the reconciliation part, and their SQL."""

from __future__ import annotations

from . import casework, evidence, extended, registry

FLAGSHIP = registry.FLAGSHIP
QUERIES = {**registry.QUERIES, **casework.QUERIES, **evidence.QUERIES, **extended.QUERIES}
ORACLES = {**registry.ORACLES, **casework.ORACLES, **evidence.ORACLES, **extended.ORACLES}
