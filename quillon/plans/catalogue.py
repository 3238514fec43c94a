"""The registered queries and the SQL they are held against."""

from __future__ import annotations

from . import adjudications, audit, closings, fixtures, ledgers, repairs, residuals, scalars, spans, subjects, unions

MODULES = [spans, scalars, subjects, audit, ledgers, repairs, unions, residuals, closings, adjudications, fixtures]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
