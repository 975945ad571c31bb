"""Named queries over the standard tables, each with the SQL that says the same."""

from glotmill.plans import annotated, evaluation, loading, resampled  # noqa: F401  they register their queries
from glotmill.plans.reference import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
