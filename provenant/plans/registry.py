"""The library's own queries and, where SQL can express them, the SQL of the same rows."""

from provenant.plans import claims, decisions, evidence, files, gold, kernels, origins, scans  # noqa: F401  they register their queries
from provenant.plans.tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
