"""How often a join along declared links repeats a row, measured on the data.

Links lead from many rows to one.  Their transitive closure, by iterated joins,
gives every path from a table up to another; along a path rows are counted hop
by hop, each hop adding up what its children count by the key they refer to, so
that nothing is ever joined out to its multiplicity.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import KEYS, TableMeta

RESULT = "descendant string, ancestor string, path string, hops int, keys long, rows long, most long"
#: Links that a path may hold.
MOST_HOPS = 16


def paths(links: DataFrame, most: int = MOST_HOPS) -> DataFrame:
    """descendant, ancestor, tables and columns of every path of ``links`` (KEYS) that comes through no table twice."""
    step = links.select("table_name", "column_name", "referenced_table", "referenced_column")
    found = step.select(F.col("table_name").alias("descendant"), F.col("referenced_table").alias("ancestor"), F.array("table_name", "referenced_table").alias("tables"), F.array("column_name").alias("columns"), F.array("referenced_column").alias("keys"))
    found = found.where("descendant <> ancestor")
    out, last = [found], found
    for _ in range(most - 1):
        longer = last.join(step, F.col("ancestor") == F.col("table_name")).where(~F.array_contains("tables", F.col("referenced_table")))
        last = longer.select("descendant", F.col("referenced_table").alias("ancestor"), F.concat("tables", F.array("referenced_table")).alias("tables"), F.concat("columns", F.array("column_name")).alias("columns"), F.concat("keys", F.array("referenced_column")).alias("keys"))
        rows = last.collect()  # a row a path of the declared links
        if not rows:
            break
        last = links.sparkSession.createDataFrame(rows, last.schema)
        out.append(last)
    return reduce(DataFrame.unionByName, out)


def measure(spark: SparkSession, tables: list[TableMeta], read: Callable[[str], DataFrame]) -> DataFrame:
    """RESULT: of each path the ancestor's keys that are reached, the descendant's rows that reach them, and most rows to one key.

    Paths with a common beginning share its counts.
    """
    links = spark.createDataFrame([(t.name, k.column, k.referenced_table, k.referenced_column) for t in tables for k in t.foreign_keys], KEYS)
    counts: dict[tuple, DataFrame] = {}

    def along(names: tuple[str, ...], columns: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
        """key, n: the first table's rows by the key of the last."""
        place = (names, columns)
        if place not in counts:
            if len(columns) == 1:
                found = read(names[0]).groupBy(F.col(f"`{columns[0]}`").alias("key")).agg(F.count("*").alias("n"))
            else:
                below = along(names[:-1], columns[:-1], keys[:-1]).withColumnRenamed("key", "below")
                up = read(names[-2]).select(F.col(f"`{keys[-2]}`").alias("own"), F.col(f"`{columns[-1]}`").alias("key"))
                found = up.join(below, F.col("own") == F.col("below")).groupBy("key").agg(F.sum("n").alias("n"))
            counts[place] = found.where("key is not null")
        return counts[place]

    out = []
    for p in paths(links).collect():  # a row a path
        n = along(tuple(p.tables), tuple(p.columns), tuple(p["keys"]))
        told = n.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        out.append(told.select(F.lit(p.descendant).alias("descendant"), F.lit(p.ancestor).alias("ancestor"), F.lit(">".join(p.tables)).alias("path"), F.lit(len(p.columns)).alias("hops"), "keys", "rows", "most"))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], RESULT)


def traps(measured: DataFrame) -> DataFrame:
    """left, right, ancestor, left_factor, right_factor: pairs of tables that repeat each other's rows when joined through an ancestor of both."""
    side = lambda n: measured.where("most > 1").select(F.col("descendant").alias(n), F.col("ancestor").alias(f"{n}_at"), F.col("path").alias(f"{n}_path"), F.col("most").alias(f"{n}_most"))
    pairs = side("left").join(side("right"), (F.col("left_at") == F.col("right_at")) & (F.col("left") < F.col("right")))
    apart = ~F.array_contains(F.split("left_path", ">"), F.col("right")) & ~F.array_contains(F.split("right_path", ">"), F.col("left"))
    return pairs.where(apart).groupBy("left", "right", F.col("left_at").alias("ancestor")).agg(F.max("right_most").alias("left_factor"), F.max("left_most").alias("right_factor"))
