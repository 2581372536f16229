"""Catalyst's unresolved logical plan as Python nodes.

The only module that reaches for Spark's private parser handle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

from py4j.java_gateway import JavaObject
from pyspark.errors import ParseException
from pyspark.sql import SparkSession


def _seq(x) -> list:
    return [x.apply(n) for n in range(x.size())]


#: Plan nodes that are not in the package of plans.
_PLANS = {"UnresolvedRelation", "UnresolvedInlineTable", "UnresolvedHaving", "PlanWithUnresolvedIdentifier", "UnresolvedTableValuedFunction"}


class Node:
    """A plan node or an expression."""

    def __init__(self, java: JavaObject):
        self.java = java

    @cached_property
    def kind(self) -> str:
        return self.java.getClass().getSimpleName().rstrip("$")

    @cached_property
    def children(self) -> list[Node]:
        return [Node(x) for x in _seq(self.java.children())]

    @cached_property
    def expressions(self) -> list[Node]:
        """Expressions of a plan node; none of an expression."""
        return [Node(x) for x in _seq(self.java.expressions())] if hasattr(self.java, "expressions") and self.is_plan else []

    @cached_property
    def is_plan(self) -> bool:
        return ".plans.logical." in (name := self.java.getClass().getName()) or name.rpartition(".")[2] in _PLANS

    def names(self, method: str) -> list[str]:
        return [str(x) for x in _seq(getattr(self.java, method)())]

    def get(self, method: str) -> Node:
        return Node(getattr(self.java, method)())

    def many(self, method: str) -> list[Node]:
        return [Node(x) for x in _seq(getattr(self.java, method)())]

    def text(self) -> str:
        return self.java.toString()

    def sql(self) -> str:
        try:
            return self.java.sql()
        except Exception:  # noqa: BLE001  some unresolved expressions have no SQL
            return self.text()

    def walk(self, windows: bool = True) -> Iterator[Node]:
        """This expression and all below it, without the plans of subqueries."""
        if self.kind == "WindowExpression" and not windows:
            return
        yield self
        for child in self.children:
            yield from child.walk(windows)

    @property
    def subquery(self) -> Node | None:
        """The plan of a subquery expression."""
        if self.kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            return self.get("plan")
        if self.kind == "InSubquery":
            return self.get("query").get("plan")
        return None


def parse(spark: SparkSession, sql: str) -> Node:
    """The unresolved plan of one statement; raises ParseException."""
    return Node(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


def analysed(spark: SparkSession, plan: Node) -> Node:
    """The analysed form of a parsed plan; no command in it is run."""
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    return Node(spark._jsparkSession.sessionState().executePlan(plan.java, skip).analyzed())


def name_parts(spark: SparkSession, name: str) -> list[str]:
    """The parts of a qualified name; raises ParseException."""
    return [str(x) for x in _seq(spark._jsparkSession.sessionState().sqlParser().parseMultipartIdentifier(name))]


def ctes(node: Node) -> list[tuple[str, Node]]:
    """Names and plans of an UnresolvedWith."""
    out = []
    for n in range(node.java.cteRelations().size()):
        pair = node.java.cteRelations().apply(n)
        out.append((str(pair.productElement(0)), Node(pair.productElement(1))))
    return out


__all__ = ["Node", "ParseException", "analysed", "ctes", "name_parts", "parse"]
