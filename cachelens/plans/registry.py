"""All registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from cachelens.plans import audit_queries, fleet_queries, identity_queries, kv_queries, metric_queries, more_queries, panel_queries, policy_queries, prefix_queries, scrape_queries, source_queries

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (identity_queries, kv_queries, prefix_queries, fleet_queries, metric_queries, policy_queries, source_queries, more_queries, scrape_queries, panel_queries, audit_queries):
    QUERIES |= _module.Q.queries
    ORACLES |= _module.Q.oracles
