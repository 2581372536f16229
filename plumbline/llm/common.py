"""Helpers shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir`` and are deleted when the application ends; nulls,
repeated rows and empty tables go through all of these as they are.
"""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokenize

WORD = r"[^\x20\x09-\x0D]+"

#: Rows of one key that one task puts in order.
TASK_ROWS = 20_000

_shipped: set[str] = set()
_scopes: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may leave that unset, as tests do; then a temporary
    folder of this machine is used.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    local = os.path.join(tempfile.gettempdir(), f"plumbline-{os.getpid()}")
    if not os.path.isdir(local):
        os.makedirs(local)
        atexit.register(shutil.rmtree, local, ignore_errors=True)
    return f"file://{local}"


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def release_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete ``path`` when the application ends."""
    for held in _scopes:
        held.append(path)
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


@contextmanager
def scratch_made() -> Iterator[list[str]]:
    """The scratch paths that are made inside, in order."""
    held: list[str] = []
    _scopes.append(held)
    try:
        yield held
    finally:
        _scopes[:] = [x for x in _scopes if x is not held]


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete scratch that nothing will read again."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of less memory for what runs inside; the session's settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
    held = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, tokens: bool = False) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, few at a time; a worker whose task has no use for ``tokens`` lets its tokenizers go."""
    if not tokens:
        tokenize.forget()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    with small_batches(spark):
        df.write.parquet(path)
    release_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """The column of exactly this name, whatever it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(docs: DataFrame, run: Callable, *more: T.StructField) -> DataFrame:
    """``docs`` through ``mapInArrow``, all columns by their places and ``more`` after them; names do not matter to it."""
    plain = docs.toDF(*(f"c{n}" for n in range(len(docs.columns))))
    schema = T.StructType([*plain.schema.fields, *(T.StructField(f"m{n}", f.dataType, f.nullable) for n, f in enumerate(more))])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *(f.name for f in more))


def private(*columns: str) -> str:
    """A beginning that none of the columns has, for the names of helper columns."""
    begin = "__"
    while any(c.lower().startswith(begin) for c in columns):
        begin += "_"
    return begin


def numbered(df: DataFrame, tag: str, number: str) -> DataFrame:
    """``df`` materialised, with a number of its own for every row: file, then place in it."""
    made = materialise(df, tag)
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).cast("long")
    more = F.regexp_extract("_metadata.file_name", r"-c(\d+)\.", 1).cast("long")
    return made.select(*map(column, df.columns), (F.shiftleft(part, 42) + F.shiftleft(more, 32) + F.col("_metadata.row_index")).alias(number))


def occurrences(rows: DataFrame, by: list[str], number: str, name: str) -> DataFrame:
    """``rows`` with ``name``: 0, 1, ... for rows equal in ``by``, in the order of ``number``.

    Which numbers a set of equal rows gets does not depend on where they lie.
    A group is counted by salts, and each salt's rows are ordered in a task of
    their own, so a group may hold any share of the rows.
    """
    p = private(*rows.columns, name)
    held = rows.groupBy(*map(column, by)).agg(F.count("*").alias(f"{p}n")).where(F.col(f"{p}n") > 1)
    held = materialise(held.select(*(column(c).alias(f"{p}{k}") for k, c in enumerate(by)), f"{p}n"), "repeated")
    total = held.agg(F.sum(f"{p}n")).first()[0]
    if not total:
        return rows.withColumn(name, F.lit(0).cast("long"))
    keys = [f"{p}{k}" for k in range(len(by))]
    same = reduce(Column.__and__, (column(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys, strict=True)))
    copies = rows.join(held, same).select(number, *keys, F.pmod(F.xxhash64(number), F.lit(-(-total // TASK_ROWS))).alias(f"{p}salt"))
    salts = copies.groupBy(*keys, f"{p}salt").agg(F.count("*").alias(f"{p}own"))
    before = Window.partitionBy(*keys).orderBy(f"{p}salt").rowsBetween(Window.unboundedPreceding, -1)
    salts = salts.select(*(F.col(k).alias(f"{k}s") for k in keys), F.col(f"{p}salt").alias(f"{p}salts"), F.coalesce(F.sum(f"{p}own").over(before), F.lit(0)).alias(f"{p}ahead"))
    here = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"{k}s")) for k in keys)) & (F.col(f"{p}salt") == F.col(f"{p}salts"))
    place = F.row_number().over(Window.partitionBy(*keys, f"{p}salt").orderBy(number)) - 1
    found = copies.withColumn(f"{p}place", place).join(salts, here).select(F.col(number).alias(f"{p}row"), (F.col(f"{p}place") + F.col(f"{p}ahead")).alias(f"{p}place"))
    return rows.join(found, F.col(number) == F.col(f"{p}row"), "left").select(*map(column, rows.columns), F.coalesce(f"{p}place", F.lit(0)).cast("long").alias(name))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever they run and whatever their search path.

    Once per application an archive goes to the shared folder, from which each
    executor fetches it, those that replace a lost one too.
    """
    context, package = spark.sparkContext, Path(__file__).resolve().parents[1]
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if not package.is_dir():  # imported from an archive that Spark has shipped itself
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(package.rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(package.parent))), file.read_bytes())
    raw = held.getvalue()
    name = f"{scratch_root(spark)}/{package.name}-{hashlib.sha256(raw).hexdigest()[:16]}-{context.applicationId}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(raw)
    out.close()
    context.addPyFile(name)


def ship_file(spark: SparkSession, path: str) -> str:
    """Have every executor fetch a file of the driver; returns the name for ``shipped``."""
    key = f"{spark.sparkContext.applicationId}:{path}"
    if key not in _shipped:
        _shipped.add(key)
        spark.sparkContext.addFile(path)
    return os.path.basename(path)


def shipped(name: str) -> str:
    """Where a worker finds a file that ``ship_file`` sent."""
    return SparkFiles.get(name)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
