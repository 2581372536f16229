"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into source partitions by hash.  How many rows of each partition go
to each shard is drawn exactly, from the multivariate hypergeometric law of a
uniform permutation; each partition permutes its rows and hands the first of
them to shard 0, and so on; each shard permutes what it got.  Draws and
permutations follow from the seed and the rows, and for equal rows from which of them it is, so lost
tasks and reruns do the same.  The matrix is drawn in two steps, for GROUPS groups of
partitions on the driver and for the partitions of a group in a task.

Law ``rows``: shard sizes are at most one apart.  Equal texts are not held
together: every permutation is as likely.  Defined results: a null text has
size 16 and checksum 0; a null doc_id is a value like others; equal rows are
dealt each for itself; an empty table gives no rows; columns not named are not
read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows a task permutes, and groups of partitions.
PARTITION_ROWS, GROUPS = 20_000, 1024


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Good ones among ``drawn``; beyond numpy's range by Stadlober's ratio of uniforms."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn))
    few, total = min(good, bad), good + bad
    m = min(drawn, total - drawn)
    share, centre = few / total, m * few / total + 0.5
    spread = math.sqrt((total - m) * m * share * (1 - share) / (total - 1) + 0.5)
    width = 1.7155277699214135 * spread + 0.8989161620588988
    lg = lambda z: math.lgamma(z + 1) + math.lgamma(few - z + 1) + math.lgamma(m - z + 1) + math.lgamma(total - few - m + z + 1)
    mode = lg((m + 1) * (few + 1) // (total + 2))
    top = min(min(m, few) + 1, math.floor(centre + 16 * spread))
    while True:
        x = 1 - rng.random()
        w = centre + width * (rng.random() - 0.5) / x
        if 0 <= w < top and 2 * math.log(x) <= mode - lg(math.floor(w)):
            z = math.floor(w)
            break
    z = z if good <= bad else m - z
    return z if m == drawn else good - z


def communication_matrix(rng: np.random.Generator, sources: list[int], shards: list[int]) -> list[list[int]]:
    """Rows of each source for each shard; row and column sums are exact."""
    left, out = list(shards), []
    for held in sources:
        row, need, rest = [], held, sum(left)
        for k, room in enumerate(left):
            rest -= room
            take = need if not rest else hypergeometric(rng, room, rest, need) if need and room else 0
            row.append(take)
            left[k] -= take
            need -= take
        out.append(row)
    return out


def group_ends(counts: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """part and ends (rows up to each shard) from part, group and n; a group's rows for each shard are in ``quotas``."""
    held = counts.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).join(quotas, "group")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ends = [], []
            for row in batch.to_pylist():
                rng = np.random.default_rng([seed, row["group"]])
                matrix = communication_matrix(rng, [x["n"] for x in row["parts"]], row["quota"])
                parts += [x["part"] for x in row["parts"]]
                ends += [np.cumsum(x) for x in matrix]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["part", "ends"])

    common.ship_package(counts.sparkSession)
    return held.select("group", "parts", "quota").mapInArrow(draw, "part long, ends array<long>")


def shuffle_rows(rows: DataFrame, shards: int, seed: int = 11) -> DataFrame:
    """``rows`` (small columns) with ``shard`` and ``slot``."""
    spark, columns = rows.sparkSession, rows.columns
    p = common.private(*columns)
    rows = common.occurrences(common.numbered(rows, "rows", f"{p}row"), columns, f"{p}row", f"{p}copy")
    each = [F.col(f"`{c}`") for c in columns]
    total = rows.count()
    parts = max(1, -(-total // PARTITION_ROWS))
    keyed = rows.select(*each, *(F.xxhash64(F.lit(f"{seed}/{n}"), f"{p}copy", *each).alias(f"{p}h{n}") for n in range(3)))
    keyed = keyed.withColumn(f"{p}part", F.pmod(f"{p}h0", F.lit(parts)))
    counts = keyed.groupBy(F.col(f"{p}part").alias("part")).agg(F.count("*").alias("n")).withColumn("group", F.col("part") % GROUPS)
    counts = common.materialise(counts, "counts")
    held = {r["group"]: r["n"] for r in counts.groupBy("group").agg(F.sum("n").alias("n")).collect()}  # at most GROUPS
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    names = sorted(held)
    matrix = communication_matrix(np.random.default_rng(seed), [held[g] for g in names], sizes)
    quotas = spark.createDataFrame(list(zip(names, matrix, strict=True)), "group long, quota array<long>")
    table = common.materialise(group_ends(counts, quotas, seed), "ends").select(F.col("part").alias(f"{p}part"), F.col("ends").alias(f"{p}ends"))
    local = Window.partitionBy(f"{p}part").orderBy(f"{p}h1", f"{p}h2")
    dealt = keyed.withColumn(f"{p}rank", F.row_number().over(local) - 1).join(table, f"{p}part")
    dealt = dealt.withColumn("shard", F.size(F.filter(f"{p}ends", lambda end: end <= F.col(f"{p}rank"))))
    # A shard's order is that of the third hash; its runs are ordered each in a task of its own.
    runs = min(1 << 30, max(1, -(-total // (shards * PARTITION_ROWS))))
    dealt = dealt.withColumn(f"{p}run", F.floor((F.shiftrightunsigned(f"{p}h2", 11) / F.lit(float(1 << 53))) * runs).cast("int"))
    dealt = dealt.select(*each, f"{p}h2", f"{p}h1", "shard", f"{p}run")
    ahead = Window.partitionBy("shard").orderBy(f"{p}run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", f"{p}run").agg(F.count("*").alias(f"{p}n")).select("shard", f"{p}run", F.coalesce(F.sum(f"{p}n").over(ahead), F.lit(0)).alias(f"{p}ahead"))
    within = Window.partitionBy("shard", f"{p}run").orderBy(F.shiftrightunsigned(f"{p}h2", 11), f"{p}h2", f"{p}h1")
    placed = dealt.withColumn(f"{p}place", F.row_number().over(within) - 1).join(offsets, ["shard", f"{p}run"])
    return placed.select(*each, "shard", (F.col(f"{p}place") + F.col(f"{p}ahead")).alias("slot"))


def shard_documents(spark: SparkSession, docs: DataFrame, shards: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.col(text_column)
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(16)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    dealt = shuffle_rows(rows, shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
