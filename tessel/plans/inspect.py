"""Plan inspection through the session's query execution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PlanNode:
    """A node of a plan: its operator, the names of its output columns, and its children."""

    name: str
    output: tuple[str, ...] = ()
    children: tuple[PlanNode, ...] = field(default=())

    def names(self) -> list[str]:
        return [self.name, *(n for c in self.children for n in c.names())]


@dataclass(frozen=True)
class Spec:
    """An operator that a rule replaces: the node's name, the columns it must put out, and the replacement's name."""

    name: str
    required: tuple[str, ...]
    replacement: str


def optimized(df: DataFrame) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def formatted(df: DataFrame) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed_filters(df: DataFrame) -> list[str]:
    """Filters that reached the scans."""
    return [x.strip() for m in re.findall(r"PushedFilters: \[([^\n]*)\]", formatted(df)) for x in re.split(r", (?=[A-Z])", m) if x.strip()]


def read_columns(df: DataFrame) -> list[str]:
    """Columns that the scans read."""
    return [c.split(":")[0] for m in re.findall(r"ReadSchema: struct<([^\n]*)>", formatted(df)) for c in re.split(r",(?![^<(]*[>)])", m) if c]


def _children(node) -> list:
    kids = node.children()
    own = [kids.apply(k) for k in range(kids.size())]
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        own = [node.executedPlan()]
    elif node.getClass().getSimpleName().endswith("QueryStageExec"):
        own = [node.plan()]
    return own


def _tree(node) -> PlanNode:
    out = node.output()
    return PlanNode(re.sub(r"\W.*", "", node.nodeName()), tuple(out.apply(k).name() for k in range(out.size())), tuple(map(_tree, _children(node))))


def plan_tree(df: DataFrame) -> PlanNode:
    """The physical plan; after an action, the plan that adaptive execution chose."""
    return _tree(df._jdf.queryExecution().executedPlan())


def executed_operators(df: DataFrame) -> list[str]:
    return plan_tree(df).names()
