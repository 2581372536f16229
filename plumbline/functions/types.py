"""SQL and Spark types as XSD types, in the two profiles of the ontology and of R2RML."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered patterns on the lower-cased type; the first that is found counts.
ONTOLOGY = (
    ("tinyint", "byte"), ("int|serial", "integer"), ("char|text|string|clob|blob", "string"), ("timestamp|datetime", "dateTime"), ("^date", "date"), ("^time", "time"),
    ("float|real", "float"), ("double", "double"), ("decimal|numeric|number|money", "decimal"), ("bool|bit", "boolean"), ("binary|bytea", "base64Binary"), ("", "string"),
)
R2RML = (
    ("tinyint", "byte"), ("int|serial", "integer"), ("numeric|decimal|money", "decimal"), ("float|real", "float"), ("double", "double"), ("timestamp|datetime", "dateTime"),
    ("^date", "date"), ("^time", "time"), ("bool", "boolean"), ("bytea|binary|blob", "base64Binary"), ("", "string"),
)
PROFILES = {"ontology": ONTOLOGY, "r2rml": R2RML}

#: Words that mark a column as a count.
QUANTITY = ("quantity", "qty", "count", "cnt", "number", "num", "amount", "amt")
_FRACTIONAL = re.compile("float|double|decimal|numeric|real")
_CATEGORY = {"integer": "numeric", "decimal": "numeric", "float": "numeric", "double": "numeric", "byte": "numeric", "string": "string", "date": "temporal", "time": "temporal", "dateTime": "temporal", "boolean": "boolean"}


@dataclass(frozen=True)
class TypeOverride:
    table: str
    column: str
    sql_type: str
    reason: str


def xsd(sql_type: str, profile: str = "ontology") -> str:
    """Local name of the XSD type."""
    lower = sql_type.lower()
    return next(out for pattern, out in PROFILES[profile] if re.search(pattern, lower))


def xsd_column(sql_type: Column, profile: str = "ontology") -> Column:
    out, lower = F.lit("string"), F.lower(sql_type)
    for pattern, name in reversed(PROFILES[profile][:-1]):
        out = F.when(lower.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def is_quantity(column: str, by_word: bool = False) -> bool:
    """``by_word``: only whole parts of the name count, so that ``discount`` is none."""
    lower = column.lower()
    return any(w in lower.split("_") for w in QUANTITY) if by_word else any(w in lower for w in QUANTITY)


def column_xsd(sql_type: str, column: str, table: str = "", by_word: bool = False) -> tuple[str, TypeOverride | None]:
    """The type of a column; a quantity of a fractional type is an integer, with a remark."""
    if is_quantity(column, by_word) and _FRACTIONAL.search(sql_type.lower()):
        return "integer", TypeOverride(table, column, sql_type, f"{column} names a quantity; {sql_type} read as integer")
    return xsd(sql_type), None


def category(name: str | None) -> str | None:
    """numeric, string, temporal or boolean; None is compatible with all."""
    return _CATEGORY.get(name or "")


def compatible(one: str | None, other: str | None) -> bool:
    a, b = category(one), category(other)
    return a is None or b is None or a == b
