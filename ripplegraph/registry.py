"""The queries of the analytics engine, with the SQL that checks them."""

from __future__ import annotations

from ripplegraph.functions import markup, pages, text  # noqa: F401  each module registers its queries
from ripplegraph.operators import audits, cohorts, events, exits, graph, headlines, housekeeping, hubs, knowledge, market, news, propagate, regulators, resolve, study, upkeep, verdicts  # noqa: F401
from ripplegraph.plans.catalog import ORACLE_SQL, QUERIES
from ripplegraph.streaming import backlog, live, progress  # noqa: F401
from ripplegraph.streaming import events as stream_events  # noqa: F401

__all__ = ["ORACLE_SQL", "QUERIES"]
