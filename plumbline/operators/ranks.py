"""Ranks over a whole table without one task that holds it.

Rows are dealt into buckets by bounds of a sample, numbered in their bucket, and
moved up by what the buckets before hold; bounds and counts (a row a bucket) are
all that the driver sees.  Where rows tie, ranks are those of the different keys,
each with its count, so a key that many rows share fills no bucket.
Keys ascend, nulls first.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_ROWS, MOST_BUCKETS, PER_BUCKET = 1_000_000, 2000, 50


def _bounds(keys: DataFrame, total: int, bucket_rows: int) -> list[tuple]:
    """Keys that part the rows into buckets of about so many."""
    buckets = min(MOST_BUCKETS, -(-total // bucket_rows))
    if buckets < 2:
        return []
    share = min(1.0, buckets * PER_BUCKET / total)
    held = keys.sample(fraction=share, seed=1).orderBy(*keys.columns).collect()  # about PER_BUCKET for each bucket
    cuts = [held[n * len(held) // buckets] for n in range(1, buckets)] if held else []
    return list(dict.fromkeys(map(tuple, cuts)))


def _bucket(keys: list[str], types: list[str], bounds: list[tuple]) -> Column:
    """The number of bounds that a row's key reaches, by halving."""
    own = F.struct(*(F.col(k) for k in keys))
    typed = [F.struct(*(F.lit(x).cast(t).alias(k) for x, t, k in zip(b, types, keys, strict=True))) for b in bounds]

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(own >= typed[middle], part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(bounds))


def _ahead(rows: DataFrame, weight: Column) -> tuple[list[int], int]:
    """What the buckets before each hold, and all."""
    held = {r.bucket: r.n for r in rows.groupBy("bucket").agg(F.sum(weight).alias("n")).collect()}
    sums = list(accumulate((held.get(b, 0) for b in range(max(held, default=-1) + 1)), initial=0))
    return sums, sums[-1]


def _keyed(df: DataFrame, order: list[str]) -> tuple[DataFrame, list[str], list[str]]:
    names = [f"__key{n}" for n in range(len(order))]
    made = df.select("*", *(F.col(c).alias(n) for c, n in zip(order, names, strict=True)))
    return made, names, [dict(made.dtypes)[n] for n in names]


def number_rows(df: DataFrame, order: list[str], name: str, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, int]:
    """``df`` with ``name``: 1, 2, ... in the order of the columns, which should tell all rows apart; and the number of rows."""
    made, names, types = _keyed(df, order)
    total = df.count()
    made = made.withColumn("bucket", _bucket(names, types, _bounds(made.select(*names), total, bucket_rows)))
    ahead, total = _ahead(made, F.lit(1))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(*names)).cast("long")
    before = F.element_at(F.array(*(F.lit(x).cast("long") for x in ahead)), F.col("bucket") + 1)
    return made.withColumn(name, place + before).drop(*names, "bucket"), total


def ntile_rows(df: DataFrame, order: list[str], tiles: int, name: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """NTILE without a partition."""
    made, total = number_rows(df, order, "__place", bucket_rows)
    size, more = divmod(total, tiles)
    long = more * (size + 1)
    n = F.col("__place")
    tile = F.when(n <= long, F.ceil(n / F.lit(size + 1))) if not size else F.when(n <= long, F.ceil(n / F.lit(size + 1))).otherwise(more + F.ceil((n - long) / F.lit(size)))
    return made.withColumn(name, tile.cast("long")).drop("__place")


def rank_rows(df: DataFrame, order: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with rank, dense_rank, percent_rank and cume_dist, without a partition."""
    made, names, types = _keyed(df, order)
    keys = made.groupBy(*names).agg(F.count("*").alias("n"))
    total = keys.count()
    keys = keys.withColumn("bucket", _bucket(names, types, _bounds(keys.select(*names), total, bucket_rows)))
    (rows, total), (different, _) = _ahead(keys, F.col("n")), _ahead(keys, F.lit(1))
    upto = Window.partitionBy("bucket").orderBy(*names)
    moved = lambda x: F.element_at(F.array(*(F.lit(v).cast("long") for v in x)), F.col("bucket") + 1)
    through = F.sum("n").over(upto) + moved(rows)
    told = keys.select(*(F.col(n).alias(f"{n}k") for n in names), (through - F.col("n") + 1).alias("rank"), (F.row_number().over(upto) + moved(different)).cast("long").alias("dense_rank"), (through / F.lit(float(max(1, total)))).alias("cume_dist"))
    told = told.withColumn("percent_rank", (F.col("rank") - 1) / F.lit(float(max(1, total - 1))))
    same = reduce(Column.__and__, (F.col(n).eqNullSafe(F.col(f"{n}k")) for n in names))
    return made.join(told, same).drop(*names, *(f"{n}k" for n in names))
