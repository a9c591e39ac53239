"""Relational operators that keep global orders, skewed keys and uneven joins distributed."""

from .guardrail import row_cap
from .joins import JoinPlan, asof_join, joined, range_join
from .ordered import global_rank, percent_of_total, running_total

__all__ = ["JoinPlan", "asof_join", "global_rank", "joined", "percent_of_total", "range_join", "row_cap", "running_total"]
