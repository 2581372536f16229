"""Chronological order of quarter and month labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_LEADING = r"(?i)^\s*Q([1-4])\s*[-/]?\s*([0-9]{4})\s*$"
_TRAILING = r"(?i)^\s*([0-9]{4})\s*[-/]?\s*Q([1-4])\s*$"


def quarter_order(label: Column) -> Column:
    """Year times four plus quarter of ``Q1 2024``, ``2024-Q1`` and the like; null for others."""
    key = lambda pattern, year, quarter: F.regexp_extract(label, pattern, year).cast("int") * 4 + F.regexp_extract(label, pattern, quarter).cast("int")
    return F.when(label.rlike(_LEADING), key(_LEADING, 2, 1)).when(label.rlike(_TRAILING), key(_TRAILING, 1, 2))


def month_order(label: Column) -> Column:
    """1 to 12 of an English month name or its first three letters; null for others."""
    lower = F.lower(F.trim(label))
    names = [(n, k) for k, m in enumerate(MONTHS, 1) for n in dict.fromkeys((m, m[:3]))]
    return F.element_at(F.create_map(*(F.lit(x) for pair in names for x in pair)), lower)
