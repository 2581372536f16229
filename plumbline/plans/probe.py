"""Whether a condition holds whatever the row, told by trying it.

A condition is evaluated over rows of extreme and ordinary values of its columns'
types, the literals it names, and their neighbours.  One that is never false (null
where a column is null) widens an OR to everything.  Inequalities, which
hardly any row breaks, are believed only if both sides read the same columns.
"""

from __future__ import annotations

import itertools
import logging
import re
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .walker import Node

#: Rows that a condition is tried over.
ROWS = 96
_INTEGER = [0, 1, -1, 2, 3, 5, 7, 10, 13, 64, 100, 255, -10, -128, 127]
_LARGE = {"tinyint": 127, "smallint": 32_767, "int": 2_147_483_647, "bigint": 9_223_372_036_854_775_807}
_REAL = ["0.0", "1.0", "-1.0", "0.5", "-0.5", "2.5", "3.0", "10.0", "99.99", "-1e6", "1e6", "1e300", "-1e300", "1e-9"]
_TEXT = ["", "a", "b", "A", "Z", "0", "1", "12", "-1", " ", "  ", "abc", "ABC", "%", "_", "x_y", "é", "1997-01-01", "true", *("q" * n for n in range(2, 41, 3)), "\U0010fffd"]
_DATE = ["0001-01-01", "1970-01-01", "1996-02-29", "1997-01-01", "1999-12-31", "2000-06-15", "2024-07-04", "9999-12-31"]
_COMPARED = {"EqualTo", "EqualNullSafe", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Like", "ILike", "RLike", "In"}
_NEGATED = re.compile(r"<>|!=|\bNOT\b", re.I)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pool(kind: str, literals: list[str], extreme: bool = True) -> list[str] | None:
    """SQL of values of a type, null among them, and extreme ones if wanted; None for types that are not tried."""
    numbers = [float(x) for x in literals if re.fullmatch(r"-?\d+(\.\d+)?", x)]
    near = sorted({n + d for n in numbers for d in (-1, 0, 1)})
    if kind in _LARGE:
        most = _LARGE[kind]
        values = [x for x in [*_INTEGER, *((most, -most) if extreme else ()), *map(int, near)] if -most <= x <= most]
        return ["NULL", *(f"CAST({x} AS {kind})" for x in dict.fromkeys(values))]
    if kind in ("double", "float") or kind.startswith("decimal"):
        return ["NULL", *(f"TRY_CAST({_quoted(str(x))} AS {kind})" for x in [*_REAL, *near] if extreme or abs(float(x)) < 1e9)]
    if kind == "string":
        return ["NULL", *map(_quoted, dict.fromkeys([*literals, *(x + "a" for x in literals), *(x[:-1] for x in literals), *_TEXT]))]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        days = [x for x in literals if re.match(r"\d{4}-\d{2}-\d{2}", x)]
        return ["NULL", *(f"TRY_CAST({_quoted(x)} AS {kind})" for x in [*days, *_DATE])]
    return ["NULL", "TRUE", "FALSE"] if kind == "boolean" else None


def _nested(columns: dict[tuple[str, ...], str]) -> dict:
    tree: dict = {}
    for parts, alias in columns.items():
        at = tree
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = alias
    return tree


def _shown(tree: dict | str) -> str:
    if isinstance(tree, str):
        return tree
    return "named_struct(" + ", ".join(f"{_quoted(k)}, {_shown(v)}" for k, v in tree.items()) + ")"


def never_false(spark: SparkSession, condition: Node, types: dict[str, set[str]]) -> bool:
    """Whether an unresolved condition over columns of these types is false for none of the rows tried."""
    names = list(dict.fromkeys(tuple(x.lower() for x in e.names("nameParts")) for e in condition.walk() if e.kind == "UnresolvedAttribute"))
    literals = [x.text() for x in condition.walk() if x.kind == "Literal"]
    if not names or any(e.subquery or e.kind.startswith("UnresolvedStar") for e in condition.walk()):
        return False
    if _NEGATED.search(condition.sql()) and not _same_columns(condition):
        return False
    kinds = [types.get(parts[-1], set()) for parts in names]
    if any(len(k) != 1 for k in kinds):
        return False
    aliases = {parts: f"p{n}" for n, parts in enumerate(names)}
    made = ", ".join(f"{_shown(v)} AS `{k}`" for k, v in _nested(aliases).items())
    held: set[bool | None] = set()
    for extreme in (False, True):
        pools = [pool(next(iter(k)), literals, extreme) for k in kinds]
        if None in pools:
            return False
        given = ", ".join(f"({', '.join(r)})" for r in _rows(pools))
        try:
            with _quiet():
                held |= {r.held for r in spark.sql(f"SELECT CAST(({condition.sql()}) AS boolean) AS held FROM (SELECT {made} FROM VALUES {given} AS t({', '.join(aliases.values())}))").collect()}
        except (PySparkException, Py4JJavaError):
            return extreme  # calculations may fail on extreme values; on ordinary ones, it cannot be judged alone
        if False in held or True not in held:
            return False
    return True


@contextmanager
def _quiet() -> Iterator[None]:
    """Errors that are looked for are not logged."""
    log = logging.getLogger("SQLQueryContextLogger")
    held, log.disabled = log.disabled, True
    try:
        yield
    finally:
        log.disabled = held


def _rows(pools: list[list[str]]) -> list[list[str]]:
    """Rows of the columns' values: in step first, then with steps that differ from column to column, so that many combinations meet."""
    rows = [[values[n % len(values)] for values in pools] for n in range(max(map(len, pools)))]
    return rows + [[values[(n * (2 * j + 1) + n * n * j // 3) % len(values)] for j, values in enumerate(pools)] for n in range(ROWS)]


def _same_columns(condition: Node) -> bool:
    """Whether each comparison under negation has the same columns on both sides."""
    read = lambda e: {x.text().lower() for x in e.walk() if x.kind == "UnresolvedAttribute"}
    sides = [(read(a), read(b)) for e in condition.walk() if e.kind in _COMPARED for a, b in itertools.pairwise(e.children)]
    return bool(sides) and all(a == b for a, b in sides)
