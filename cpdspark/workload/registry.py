"""All registered queries."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("relational", "models", "generated"):
    _module = importlib.import_module(f"cpdspark.workload.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)

from cpdspark.workload.models import flagship, line_scores  # noqa: E402, F401
