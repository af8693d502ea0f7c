"""Names of the queries, what they run and the SQL that gives the same rows."""

from __future__ import annotations

from flowloom.plans import analysis, models, network, sources

FLAGSHIP = "node_strength_A1"


def queries() -> dict:
    return {k: f for part in (network, analysis, models, sources) for k, f in part.query.functions.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in (network, analysis, models, sources) for k, s in part.query.sql.items()}
