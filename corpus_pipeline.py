"""A corpus from raw documents: toxic ones out, one of each near-copy, no test items, mixed, sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeledger.llm import contamination, mixing, sharding, simhash, toxicity
from lakeledger.llm.queries import WEIGHTS, domain, table, test_items
from lakeledger.runtime import scratch

#: Training and mixing have no short form in SQL; tests compare with a plain version.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels calls toxic go.

    Null and empty texts have no toxic sentence and stay; rows that repeat an id are each judged by their own text.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~toxicity.held_out("id"))
    return toxicity.clean_rows(docs, model)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays.

    Texts without words (null ones too) are one class. Of rows that are alike in all that tells them apart one stays.
    """
    return simhash.one_of_each(docs, shingle=3, radius=3)


def remove_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item's question and answer go; null and empty texts hold none and stay."""
    return contamination.clean_rows(docs, test_items(spark, sf_dir))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, by the weights of domains, languages and sources; epochs repeat rows.

    Null sources and languages are nodes like others. Columns of ``docs`` stay, whatever their names.
    """
    mixed = mixing.mix(docs, domain(), (1, 2), 4, WEIGHTS)
    return mixed.drop(*mixed.columns[len(docs.columns) :])


def to_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Forty shards of near equal bytes: the finished corpus, all columns of ``docs`` and ``size, text_crc32, shard``.

    Equal texts, null as an empty one, share a shard; rows of several epochs stay repeated.
    """
    return sharding.with_shards(docs, 40)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_copies),
    ("decontamination", remove_test_items),
    ("mixing", mix_sources),
    ("sharding", to_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
