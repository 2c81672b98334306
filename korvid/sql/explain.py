"""Plans as text: our logical steps, then what Spark makes of them."""

from __future__ import annotations

import re

from korvid.sql.lower import Bound, Node


def render(bound: Bound, actual: int | None, planning_ms: float, execution_ms: float | None) -> list[str]:
    rows, size = estimate(bound)
    head = f"  (cost=0.00..{size:.2f} rows={rows})"
    if actual is not None:
        head += f" (actual time=0.000..{execution_ms:.3f} rows={actual} loops=1)"
    lines: list[str] = []

    def walk(node: Node, depth: int) -> None:
        pad = "  " * depth + ("->  " if depth else "")
        lines.append(pad + node.label + (head if not depth else ""))
        lines.extend("  " * depth + ("      " if depth else "  ") + f"{k}: {v}" for k, v in node.details.items())
        for child in node.children:
            walk(child, depth + 1)

    walk(bound.node, 0)
    lines.append(f"Planning Time: {planning_ms:.3f} ms")
    if execution_ms is not None:
        lines.append(f"Execution Time: {execution_ms:.3f} ms")
    lines.append("Physical Plan:")
    lines += ["  " + x for x in bound.df._jdf.queryExecution().executedPlan().toString().rstrip().split("\n")]
    return lines


def estimate(bound: Bound) -> tuple[int, float]:
    """(rows, bytes) by Spark's statistics; rows are -1 where it has none."""
    stats = bound.df._jdf.queryExecution().optimizedPlan().stats()
    rows = stats.rowCount()
    return int(str(rows.get())) if rows.isDefined() else -1, float(str(stats.sizeInBytes()))


def nodes(bound: Bound) -> list[dict]:
    """The logical steps as a list, with their depth."""
    out: list[dict] = []

    def walk(node: Node, depth: int) -> None:
        out.append({"depth": depth, "label": node.label, "details": node.details})
        for child in node.children:
            walk(child, depth + 1)

    walk(bound.node, 0)
    return out


def profile(df) -> dict[str, int]:
    """Spark's own counters of an executed DataFrame, summed by name."""
    found: dict[str, int] = {}

    def walk(plan) -> None:
        metrics = plan.metrics()
        keys = metrics.keysIterator()
        while keys.hasNext():
            key = keys.next()
            found[key] = found.get(key, 0) + int(metrics.apply(key).value())
        inner = plan.children()
        for i in range(inner.size()):
            walk(inner.apply(i))
        name = plan.getClass().getSimpleName()
        if re.match("AdaptiveSparkPlanExec", name):
            walk(plan.executedPlan())
        elif re.search("QueryStageExec", name):
            walk(plan.plan())

    walk(df._jdf.queryExecution().executedPlan())
    return found
