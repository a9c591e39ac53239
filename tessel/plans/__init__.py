"""Looking at plans: what was pushed down, which operators run, and rules over plan trees."""

from .inspect import PlanNode, Spec, executed_operators, optimized, plan_tree, pushed_filters, read_columns
from .rules import REGISTRY, PlanRule, apply_rules, operator_spec, probe_fields

__all__ = [
    "REGISTRY", "PlanNode", "PlanRule", "Spec", "apply_rules", "executed_operators", "operator_spec", "optimized", "plan_tree", "probe_fields", "pushed_filters",
    "read_columns",
]
