"""The corpus pipeline: five stages over ``documents``, each reading what the one before it kept.

Every stage but the last returns the columns of ``documents``; the last returns the shards.  Each stage is written as Parquet
and read again before the next.  The stages that hand texts to Python do so in batches of bounded bytes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from hearken.llm import decontaminate, language, mixing, sharding, simhash
from hearken.llm.common import id_bucket, stored, table
from hearken.llm.queries import MIX
from hearken.session import batches_by_bytes

#: Predictions below this score are rejected, with texts of no language.
LEAST_SCORE = 0.4
#: Near copies share this part of their sets of runs of so many words.
WIDTH, SIMILAR = 5, 0.8
#: The corpus is cut to this share of its tokens, each document once at most, so that the mix can follow its weights.
SHARE = 0.7


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; texts without letters and those of no clear language go."""
    batches_by_bytes(spark)
    model = language.train(docs, id_bucket("doc_id", 5) != 0, "doc_id", "text", "lang")
    return language.labelled(docs, model, least=LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    batches_by_bytes(spark)
    return simhash.one_of_each(docs, width=WIDTH, least=SIMILAR)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    batches_by_bytes(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A seeded prefix of each leaf of the domain-language-source tree; a document on a leaf's boundary stays whole."""
    return mixing.select(docs, replace(MIX, share=SHARE, epochs=1), columns=False)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot in 40 shards of near-equal bytes."""
    return sharding.shard_by_size(docs, shards=40)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate_benchmark),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Fitted machines, bit votes and index search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
