"""All queries that do not need the training-data operators, by name."""

from __future__ import annotations

from attesta.plans import catalogue, evidence, graph_queries
from attesta.streaming import jobs, runner

QUERIES = evidence.QUERIES | graph_queries.QUERIES | catalogue.QUERIES | jobs.QUERIES | runner.QUERIES
ORACLES = evidence.ORACLES | graph_queries.ORACLES | catalogue.ORACLES | jobs.ORACLES | runner.ORACLES
