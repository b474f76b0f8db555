"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from siltstone.plans import audits, corpus, evaluation, pairs, quality, relational, scans  # noqa: F401
from siltstone.plans.base import ORACLES, QUERIES  # noqa: F401
