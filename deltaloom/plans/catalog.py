"""All queries over the table model."""

from __future__ import annotations

from . import aggregates, chunks, joins, log, placement, policy, predicates, scalar, sequences, versions, views
from .registry import ORACLES, QUERIES

__all__ = ["aggregates", "chunks", "joins", "log", "placement", "policy", "predicates", "scalar", "sequences", "versions", "views"]


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
