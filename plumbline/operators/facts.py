"""Totals over several facts that no join can inflate."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a fact: its rows, its key, and its measures by name.
Fact = tuple[DataFrame, Column | str, Mapping[str, Column | str]]


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def union_facts(key: str, facts: Mapping[str, Fact]) -> DataFrame:
    """One row per fact row: key, fact_type and all measures, those of other facts 0."""
    measures = list(dict.fromkeys(m for _, _, given in facts.values() for m in given))

    def one(name: str, fact: Fact) -> DataFrame:
        rows, own, given = fact
        return rows.select(_col(own).alias(key), F.lit(name).alias("fact_type"), *((_col(given[m]) if m in given else F.lit(0)).alias(m) for m in measures))

    return reduce(DataFrame.unionByName, (one(n, f) for n, f in facts.items()))


def total_by_key(key: str, facts: Mapping[str, Fact]) -> DataFrame:
    """Sums of every measure by key; one shuffle, combined before it."""
    rows = union_facts(key, facts)
    return rows.groupBy(key).agg(*(F.sum(m).alias(m) for m in rows.columns if m not in (key, "fact_type")))


def preaggregate_facts(spine: DataFrame, key: str, facts: Mapping[str, Fact]) -> DataFrame:
    """``spine`` with each fact's sums by key, 0 where it has none."""
    out = spine
    for rows, own, given in facts.values():
        sums = rows.groupBy(_col(own).alias(key)).agg(*(F.sum(_col(c)).alias(m) for m, c in given.items()))
        out = out.join(sums, key, "left").withColumns({m: F.coalesce(m, F.lit(0)) for m in given})
    return out


def verify_total(result: DataFrame, measure: str, base: DataFrame, column: Column | str) -> DataFrame:
    """result_total, base_total and their difference; above 0 is inflation, below 0 lost rows."""
    both = result.select(F.col(measure).alias("result"), F.lit(None).alias("base")).unionByName(base.select(F.lit(None).alias("result"), _col(column).alias("base")))
    sums = both.agg(F.sum("result").alias("result_total"), F.sum("base").alias("base_total"))
    return sums.withColumn("difference", F.col("result_total") - F.col("base_total"))
