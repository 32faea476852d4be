"""All queries of the library by name, with the DuckDB SQL that gives the same rows."""

from . import algebra_plans, alignment_plans, detector_plans, further_plans, graph_plans, interval_plans, more_plans, region_plans, sequence_plans, simulator_plans, stream_plans, tree_plans  # noqa: F401  they register themselves
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
