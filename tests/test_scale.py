"""Footers, fan-out along links, and ranks over whole tables."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import fanout, ranks
from plumbline.sources import footers
from plumbline.sources.catalog import Catalog, ColumnMeta, ForeignKey, TableMeta


def test_profile_reads_footers_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(1000, numPartitions=4).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 0.5).alias("x"), F.col("id").cast("string").alias("s"), F.lit(None).cast("int").alias("none"), F.array("id").alias("a"), (F.col("id") > 5).alias("b.c"), F.expr("date'2024-01-01' + int(id)").alias("d"))
    df.write.parquet(path)
    made = {r.column_name: tuple(r)[2:] for r in footers.profile(spark, {"t": path}).collect()}
    assert made == {"id": (1000, 0, "0", "999"), "x": (1000, 334, "0.5", "499.0"), "s": (1000, 0, None, None), "none": (1000, 1000, None, None), "a": (1000, None, None, None), "b.c": (1000, 0, "false", "true"), "d": (1000, 0, "2024-01-01", "2026-09-26")}
    assert footers.row_counts(spark, {"t": path, "u": path}) == {"t": 1000, "u": 1000} and footers.profile(spark, {}).count() == 0
    with footers.pushed(spark):
        frame = spark.read.parquet(path)
        plans = [x._jdf.queryExecution().executedPlan().toString() for x in (footers.counts_of(frame), footers.bounds_of(frame, [0, 5, 6]))]
    assert "PushedAggregation: [COUNT(*)" in plans[0] and "PushedAggregation: [MIN(id), MAX(id)" in plans[1]
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_fan_out_along_links(spark):
    rng = random.Random(1)
    a = [(n, rng.randrange(3) if n else None) for n in range(20)]
    b = [(n, rng.choice([*range(20), None, 99]), rng.randrange(4)) for n in range(200)]
    frames = {"top": spark.createDataFrame([(n,) for n in range(3)], "id int"), "a": spark.createDataFrame(a, "id int, top int"), "b": spark.createDataFrame(b, "id int, a int, side int"), "side": spark.createDataFrame([(n, n % 3) for n in range(4)], "id int, top int")}
    keys = {"a": [("top", "top")], "b": [("a", "a"), ("side", "side")], "side": [("top", "top")], "top": []}
    tables = [TableMeta(t, columns=[ColumnMeta("id", "int")], primary_keys=["id"], foreign_keys=[ForeignKey(c, o, "id") for c, o in keys[t]]) for t in frames]
    made = {r.path: tuple(r)[3:] for r in fanout.measure(spark, Catalog(spark).add(*tables).analyse(), frames.get).collect()}
    to_top = {x: t for x, t in a}

    def told(values):
        held = [v for v in values if v is not None]
        return len(set(held)), len(held), max(held.count(v) for v in set(held))

    assert made["b>a"] == (1, *told([x for _, x, _ in b])) and made["b>side>top"] == (2, *told([s % 3 for *_, s in b]))
    assert made["b>a>top"] == (2, *told([to_top.get(x) for _, x, _ in b])) and set(made) == {"a>top", "b>a", "b>side", "side>top", "b>a>top", "b>side>top"}
    found = {(r.left, r.right, r.ancestor) for r in fanout.traps(fanout.measure(spark, tables, frames.get)).collect()}
    assert ("a", "side", "top") in found and ("a", "b", "a") not in found


def test_paths_end_on_circles(spark):
    links = spark.createDataFrame([("a", "x", "b", "id"), ("b", "x", "c", "id"), ("c", "x", "a", "id"), ("c", "y", "c", "id")], "table_name string, column_name string, referenced_table string, referenced_column string")
    assert sorted(">".join(r.tables) for r in fanout.paths(links).collect()) == ["a>b", "a>b>c", "b>c", "b>c>a", "c>a", "c>a>b"]


@pytest.mark.parametrize(("rows", "bucket", "tiles"), [(0, 10, 4), (3, 10, 4), (1003, 50, 4), (1003, 50, 7), (500, 10_000, 3)])
def test_ranks_without_one_task(spark, rows, bucket, tiles):
    rng = random.Random(rows)
    df = spark.createDataFrame([(n, rng.choice([None, 1.5, rng.random(), 7.0]), rng.choice("ab")) for n in range(rows)], "id int, v double, w string").repartition(4)
    whole = Window.orderBy("v", "id")
    made = ranks.ntile_rows(df, ["v", "id"], tiles, "tile", bucket)
    assert sorted((r.id, r.tile) for r in made.collect()) == sorted((r.id, r.t) for r in df.select("id", F.ntile(tiles).over(whole).alias("t")).collect())
    assert rows <= bucket or "SinglePartition" not in made._jdf.queryExecution().executedPlan().toString()
    ties = Window.orderBy("w", "v")
    wanted = df.select("id", F.rank().over(ties).cast("long").alias("a"), F.dense_rank().over(ties).cast("long").alias("b"), F.percent_rank().over(ties).alias("c"), F.cume_dist().over(ties).alias("d"))
    found = ranks.rank_rows(df, ["w", "v"], bucket).select("id", F.col("rank").alias("a"), F.col("dense_rank").alias("b"), F.col("percent_rank").alias("c"), F.col("cume_dist").alias("d"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect()))
