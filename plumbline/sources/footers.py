"""What Parquet footers say of tables: rows, nulls, least and greatest values.

One job over all tables for counts and one for bounds; Spark pushes the
aggregates into the footers, a task a file, and reads no data page.  Least and greatest values are there for whole and
fractional numbers, dates and booleans; of texts and timestamps a footer may
hold shortened bounds, so they are left out, and nested columns have rows alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE = "table_name string, column_name string, rows long, nulls long, least string, most string"
#: Types whose bounds footers hold exactly.
BOUNDED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)


@contextmanager
def pushed(spark: SparkSession) -> Iterator[None]:
    """Aggregates over Parquet go to the footers inside."""
    wanted = {"spark.sql.parquet.aggregatePushdown": "true", "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text"}
    held = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def counts_of(frame: DataFrame) -> DataFrame:
    """A row: the table's rows, and of each column the values that are not null."""
    flat = [(n, f) for n, f in enumerate(frame.schema.fields) if not isinstance(f.dataType, NESTED)]
    return frame.agg(F.count("*").alias("rows"), *(F.count(_quoted(f.name)).alias(f"n{n}") for n, f in flat))


def bounds_of(frame: DataFrame, places: list[int]) -> DataFrame:
    """A row: least and greatest value of some columns."""
    names = [(n, _quoted(frame.schema.fields[n].name)) for n in places]
    return frame.agg(*(f(c).alias(f"{a}{n}") for n, c in names for a, f in (("a", F.min), ("b", F.max))))


def _at_once(frames: dict[str, DataFrame]) -> dict[str, dict]:
    """The rows of one-row frames of different columns, in one job."""
    told = [frame.select(F.lit(name).alias("name"), F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in frame.columns))).alias("row")) for name, frame in frames.items()]
    return {r.name: json.loads(r.row) for r in reduce(DataFrame.unionByName, told).collect()} if told else {}


def profile(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """PROFILE of the tables (name to path); a row a column comes to the driver.

    A file without any value of a column has no bounds of it, so columns that
    hold nulls have theirs from a scan of these columns alone.
    """
    with pushed(spark):
        frames = {name: spark.read.parquet(path) for name, path in paths.items()}
        counts = _at_once({name: counts_of(f) for name, f in frames.items()})
        full, some = {}, {}
        for name, frame in frames.items():
            for n, f in enumerate(frame.schema.fields):
                if isinstance(f.dataType, BOUNDED) and (held := int(counts[name][f"n{n}"])):
                    (full if held == int(counts[name]["rows"]) else some).setdefault(name, []).append(n)
        try:
            bounds = _at_once({name: bounds_of(frames[name], places) for name, places in full.items()})
        except (PySparkException, Py4JJavaError):  # footers without bounds, as of columns that hold NaN
            bounds, some = {}, {name: sorted(full.get(name, []) + some.get(name, [])) for name in {*full, *some}}
    scanned = _at_once({name: bounds_of(spark.read.parquet(paths[name]), places) for name, places in some.items()})
    rows = []
    for name, frame in frames.items():
        held = bounds.get(name, {}) | scanned.get(name, {})
        total = int(counts[name]["rows"])
        for n, f in enumerate(frame.schema.fields):
            nulls = total - int(counts[name][f"n{n}"]) if f"n{n}" in counts[name] else None
            rows.append((name, f.name, total, nulls, held.get(f"a{n}"), held.get(f"b{n}")))
    return spark.createDataFrame(rows, PROFILE)


def row_counts(spark: SparkSession, paths: Mapping[str, str]) -> dict[str, int]:
    """Rows of the tables, from their footers alone."""
    with pushed(spark):
        return {name: int(row["n"]) for name, row in _at_once({name: spark.read.parquet(path).agg(F.count("*").alias("n")) for name, path in paths.items()}).items()}
