"""All queries of the building-stock operators, by name, with their SQL."""

from __future__ import annotations

from lithos.plans import building_queries, cloud_queries, footprint_queries, fragment_queries, hub_queries, model_queries, rule_queries

MODULES = (model_queries, building_queries, hub_queries, cloud_queries, footprint_queries, fragment_queries, rule_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
