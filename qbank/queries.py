
from __future__ import annotations

from qbank.plans import aggregates, fields, filters, io, joins, scalars, statements, streams, windows  # noqa: F401
from qbank.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
