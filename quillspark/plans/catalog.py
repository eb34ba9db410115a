"""The registry of named queries."""

from quillspark.plans.queries import ORACLE_SQL, QUERIES

FLAGSHIP = QUERIES["cell_evaluation"]

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
