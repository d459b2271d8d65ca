"""All core queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from strandline.plans import behaviour, edits, events, evidence, fixtures, problems, reads, tpch

MODULES = (problems, events, edits, behaviour, reads, evidence, fixtures, tpch)

FLAGSHIP = events.exposure_mh


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
