"""Loads every query module, so that the registry is complete."""

from peerscope.plans import queries_groups, queries_links, queries_numbers, queries_reads, queries_text  # noqa: F401
from peerscope.plans.registry import ORACLES, QUERIES  # noqa: F401
