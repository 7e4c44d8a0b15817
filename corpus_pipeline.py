"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Language identification drops rejected documents; near-dedup leaves one document of each group linked by
SimHash fingerprints (three-word shingles, at most three differing bits, as in ``op8_simhash``); decontamination cuts benchmark passages out and drops documents that mostly consist of them;
mixing repeats or drops documents so that the domains meet their target weights; sharding adds shard
and slot. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import lingomark
from lingomark import session
from lingomark.llm import decontaminate, language, mixing, sharding, simhash

# Python tasks get the package's functions with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(lingomark)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session.tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or unlike all learned languages, go.

    A null or empty text has no letters and goes. Repeated rows are judged alike; rows without an id or a
    lang are judged, not learned from. Without any language to learn all documents go.
    """
    session.tune(spark)
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays; links are fingerprints three bits apart or less.

    Texts without words are one component. Of rows that repeat an id the longest text stays; rows without
    an id are passed on.
    """
    session.tune(spark)
    return simhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ten or more words of a benchmark item go, with n_chars counted anew.

    Null and empty texts are passed on; repeated rows are cut alike; without items nothing is cut.
    """
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; rates bring the domains to their target weights.

    A null text has no tokens. Repeated rows have a rate each; without labels every rate is one.
    """
    labelled = mixing.domain_labels(_table(spark, sf_dir, "labels"))
    own = [f"own_{k}" for k in range(len(docs.columns))]
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(o) for c, o in zip(docs.columns, own, strict=True)])
    mixed = mixing.mix(renamed, labelled, keep=own).where(F.col("copies") > 0)
    repeated = mixed.select(*own, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return repeated.select(*[F.col(o).alias(c) for c, o in zip(docs.columns, own, strict=True)])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with shard and slot: contiguous shards of near-equal bytes, in order of doc_id.

    A null text has size 1; rows without an id come first; repeated rows have a slot each.
    """
    session.tune(spark)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return sharding.balanced_shards(docs, size, ["doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("mixing", mix_domains),
    ("sharding", shard),
]

# Language models, suffix automata and components over fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
