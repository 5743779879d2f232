"""All queries of the library and the SQL that states the same results."""

from siltstone.plans import allocation, contracts, gates, generators, responses, sampling, scoring, screening, sources, stats, streaming, text  # noqa: F401
from siltstone.plans.base import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "f3_reason_counts"
