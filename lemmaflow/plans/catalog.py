"""All registered queries of the library and their SQL."""

from lemmaflow.plans import attempt_queries, population_queries  # noqa: F401  (they register themselves)
from lemmaflow.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
