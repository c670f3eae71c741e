"""No look ahead: past-only features may not change when later rows come.

Two checks, as neither sees all.  ``in_plan`` reads the window frames and the
offsets of lead and lag from the analysed plan, and says which reach beyond
their row; it sees no Python kernel and no aggregate that is joined back.
``changed`` compares a run on a series that ends early with the run on the whole
one; it sees whatever matters for the rows at hand.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

SPARK = "org.apache.spark.sql.catalyst.expressions."


class Node:
    """An expression of a plan's JSON, where a node is followed by its children."""

    def __init__(self, fields: dict, nodes: Iterator[dict]):
        self.kind = fields["class"].removeprefix(SPARK).rstrip("$")
        self.fields = fields
        self.children = [Node(next(nodes), nodes) for _ in range(fields["num-children"])]

    def within(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.within()

    def number(self) -> float | None:
        """A literal's value, with the sign of the minus around it."""
        if self.kind == "Literal":
            try:
                return float(self.fields["value"])
            except (TypeError, ValueError):
                return None
        below = self.children[0].number() if len(self.children) == 1 else None
        return None if below is None else -below if self.kind == "UnaryMinus" else below


def _expressions(part: object) -> Iterator[Node]:
    if isinstance(part, list):
        if part and isinstance(part[0], dict) and "num-children" in part[0] and part[0]["class"].startswith(SPARK):
            nodes = iter(part)
            yield Node(next(nodes), nodes)
        else:
            for inner in part:
                yield from _expressions(inner)


def _reaches(bound: Node, side: str) -> bool:
    if bound.kind.startswith("Unbounded"):
        return bound.kind == f"Unbounded{side}"
    if bound.kind == "CurrentRow":
        return False
    n = bound.number()
    return n is None or (n > 0 if side == "Following" else n < 0)


def _about(window: Node) -> list[str]:
    spec = window.children[-1]
    orders = [c for c in spec.children if c.kind == "SortOrder"]
    if not orders:
        return ["a window without order"]
    back = "Descending" in str(orders[0].fields["direction"])
    found = []
    for node in window.children[0].within():
        if node.kind in ("Lead", "Lag"):
            n = node.children[1].number()
            ahead = (node.kind == "Lead") != back
            if n is None or (n > 0) == ahead and n != 0:
                found.append(f"{node.kind.lower()} by {node.children[1].fields.get('value', '?')}" + " in descending order" * back)
            return found
        if node.kind in ("PercentRank", "CumeDist", "NTile"):
            return [f"{node.kind} of the whole partition"]
    frame = spec.children[-1]
    if frame.kind == "SpecifiedWindowFrame":
        low, high = frame.children
        if _reaches(low, "Preceding") if back else _reaches(high, "Following"):
            found.append("a frame that reaches behind its row" if not back else "a frame over descending order")
    elif back:
        found.append("a frame over descending order")
    return found


def in_plan(df: DataFrame) -> list[str]:
    """What in the windows of a query reaches beyond a row; empty if nothing."""
    found = []
    for node in json.loads(df._jdf.queryExecution().analyzed().toJSON()):
        for value in node.values():
            for expression in _expressions(value):
                for inner in expression.within():
                    if inner.kind == "WindowExpression":
                        found += _about(inner)
    return found


def changed(early: DataFrame, whole: DataFrame) -> DataFrame:
    """Rows of the run on the series that ends early which the run on the whole
    one has not: whatever came later changed them."""
    return early.exceptAll(whole.select(*early.columns))
