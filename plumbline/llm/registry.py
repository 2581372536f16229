"""The thin queries over whole tables that apply each operator, and their SQL.

Only columns that a query needs are selected from its table, so columns of
other names, whatever they are called, change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZERS = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json"}


def tokenizer_path(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZERS[kind])


def op1_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neighbours

    return neighbours.nearest(common.read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(common.read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = common.read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(common.read_table(spark, sf_dir, "documents"), tokenizer_path("words"), capacity=4096, end_id=1)


def op5_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard_documents(spark, common.read_table(spark, sf_dir, "documents"), shards=40)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.digest(secrets.scan(common.read_table(spark, sf_dir, "documents")))


def op7_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    found = simhash.near_duplicates(common.read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    rows = mixing.measured(common.read_table(spark, sf_dir, "documents"))
    taken = mixing.copies(rows, mixing.mix(rows))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dac

    path = common.scratch_path(spark, "token-ids")
    dac.write(spark, common.read_table(spark, sf_dir, "documents"), path, tokenizer_path("bytes"), end_id=0)
    common.release_at_exit(spark, path)
    return dac.digest(dac.read(spark, path))


def op10_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.top_products(common.read_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import codes

    return codes.compress(common.read_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def op12_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import graph

    return graph.near_duplicates(common.read_table(spark, sf_dir, "embeddings"), least=0.95).drop("recall")


def op13_elkan_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import centroids

    return centroids.cluster(common.read_table(spark, sf_dir, "embeddings"), k=16, rounds=3, dimension=64, scale=64, seed=1).drop("counted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_projected_neighbours": op1_projected_neighbours,
        "op2_personal_data": op2_personal_data,
        "op3_language": op3_language,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_hypergeometric_shards": op5_hypergeometric_shards,
        "op6_secret_scan": op6_secret_scan,
        "op7_simhash_near_duplicates": op7_simhash_near_duplicates,
        "op8_token_files": op8_token_files,
        "op9_entropy_mix": op9_entropy_mix,
        "op10_impact_topk": op10_impact_topk,
        "op11_vector_codes": op11_vector_codes,
        "op12_pruned_graph": op12_pruned_graph,
        "op13_elkan_clusters": op13_elkan_clusters,
    }


def oracle_sql() -> dict[str, str]:
    from . import centroids, codes, graph, topk

    return {"op10_impact_topk": topk.ORACLE_SQL, "op11_vector_codes": codes.ORACLE_SQL, "op12_pruned_graph": graph.ORACLE_SQL, "op13_elkan_clusters": centroids.ORACLE_SQL}
