"""Queries of the library over the driver's tables, and SQL that gives the same results."""

from __future__ import annotations

import importlib

#: Modules of ``weftline.plans`` with ``QUERIES`` and ``ORACLES``.
MODULES = ["catalog_queries", "operator_queries", "domain_queries", "analysis_queries", "signal_queries", "flow_queries"]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"weftline.plans.{_name}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
