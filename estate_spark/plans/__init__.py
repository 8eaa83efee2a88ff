"""Named queries over the given tables; importing this package registers them all."""

from estate_spark.plans import (curation, evaluation, exploration, modelling,  # noqa: F401
                                neighbours, reporting, sampling)
from estate_spark.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
