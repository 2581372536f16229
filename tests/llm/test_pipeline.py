"""The pipeline's stages on a small corpus, each against what it should do to its own input."""

import os

import corpus_pipeline
from fixtures import empty_documents, odd_documents

import __spark_entry__
from plumbline.llm import common, registry


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [n.split("_")[0] for n in registry.queries()] and {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)}
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        if name == "packing":
            by = {}
            for r in made.collect():
                by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
            assert max(by.values()) <= 4096
            return
        assert made.columns == columns
        before, after = docs.count(), made.count()
        if name == "language":
            assert after >= 0.98 * before
        if name == "near_duplicates":
            assert after == made.select("doc_id").distinct().count() <= before
        if name == "personal_data":
            assert after == before and made.where("text like '%[EMAIL]%'").count() > 0 and made.where("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
        docs = made


def test_run_leaves_its_result_alone(spark, sf_dir):
    """What stages write on the way is deleted as soon as the next result is there."""
    with common.scratch_made() as made:
        rows = corpus_pipeline.run(spark, sf_dir)
    assert len(made) > 5 and rows.count() > 0
    there = [p for p in made if os.path.exists(p.removeprefix("file://"))]
    assert there == made[-1:]


def test_stages_on_odd_rows(spark, sf_dir):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        made.collect()
        docs = docs if name == "packing" else made


def test_stages_on_an_empty_table(spark, sf_dir):
    docs = empty_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert made.count() == 0 and (name == "packing" or made.columns == docs.columns)
