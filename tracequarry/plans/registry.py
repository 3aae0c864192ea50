"""All core queries by name, with their SQL twins."""

from __future__ import annotations

from tracequarry.operators import alignment, assignment, audits, bundles, conversations, documents, episodes, gates, json_edits, requests, rollups, selection, structures, tools, trace, validation  # noqa: F401
from tracequarry.plans.catalog import ORACLE_SQL, QUERIES

FLAGSHIP = "a2_trajectory_profile"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
