"""All queries of :mod:`depquarry.plans`, by name, and their SQL."""

from depquarry.plans import audit_queries, deep_queries, entry_queries, more_queries, queries, report_queries, rest_queries  # noqa: F401

QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
