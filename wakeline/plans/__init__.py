"""All registered queries."""

from wakeline.plans import queries  # isort: skip  (the first registered query is the flagship)
from wakeline.plans import console, cycles, decisions, judged, records
from wakeline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "console", "cycles", "decisions", "judged", "queries", "records"]
