"""A corpus pipeline of five of the training-data operators.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read back as the next one's ``docs``.

Defined results: a null or letterless text has no language, so its document
goes in the first stage; given to a later one it counts as an empty text and, as
it has no words, is taken by no mix; rows that are equal are one group of near
copies; columns besides doc_id, text, lang, source and n_chars pass through
whatever their names, up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common, language, mixing, packing, pii, simhash
from plumbline.llm.registry import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go."""
    return language.keep_identified(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least doc_id."""
    return simhash.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; no document goes."""
    return pii.redact(docs, pii.learn(common.materialise(pii.votes(docs), "votes")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_path("words"), capacity=4096, end_id=1)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashes, trained classifiers and the packing search have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what a stage has written on the way, and its input, go once its result is there."""
    docs, last = common.read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with common.scratch_made() as made:
            docs = common.materialise(stage(spark, docs, sf_dir), name)
        common.release(spark, [*made[:-1], *last])
        last = made[-1:]
    return docs
