"""A corpus from raw documents to sampled token sequences, as stages that Parquet tables join.

Each stage works on every row its predecessor kept and, but for the last, returns the
columns it was given, whatever their names.  Rows that repeat a doc_id share the decision of
``unique``; the other stages decide on each row's text.  NULL and empty texts have no letter
and go with ``language``; a stage that is handed them all the same keeps them.  Empty tables
stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm import langid, minhash, mixing, pieces, toxicity
from pulseweave.llm.common import prepare
from pulseweave.session import materialize, scratch

#: No SQL: three stages are trained models and samples.  tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or of no clear language."""
    prepare(spark)
    return langid.identified(docs, langid.fit(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the toxicity classifiers mark; labels are those of the documents left."""
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.harmless(docs, toxicity.fit(docs, labels))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates (5 words, 0.8)."""
    prepare(spark)
    found = minhash.near_duplicates(docs, words_per_shingle=5)
    return docs.join(found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def scheduled(docs: DataFrame, name: str) -> DataFrame:
    """All documents and, in the new column ``name``, their positions in the mixing schedule, sorted by
    it; it depends on ids and sources alone."""
    placed = mixing.mix(docs).groupBy("doc_id").agg(F.min("position").alias("position"))
    found = docs.alias("d").join(placed.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id"))).select(
        *[F.col(f"d.`{c}`") for c in docs.columns], F.col("p.position").alias(name))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartitionByRange(n, name).sortWithinPartitions(name)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which sources mix to the square roots of their sizes."""
    prepare(spark)
    name = "position"
    while name in docs.columns:
        name = f"_{name}"
    return scheduled(docs, name).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Different segmentations of each document (``pieces.SAMPLES``), with their inclusion scores and the
    document's ``position`` in the mixing schedule, sorted by it.

    Files don't keep an order when they are read, so the position is found again: it is
    the same for the same documents.  A column ``position`` of the documents is not kept.
    """
    prepare(spark)
    placed = scheduled(docs.drop("position"), "position")
    return pieces.encode(placed, carry=("position",)).sortWithinPartitions("position", "sample")


STAGES = [("language", language), ("toxicity", clean), ("minhash", unique), ("mixing", mixed), ("pieces", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):  # a stage's own tables go when its result is written
            docs = materialize(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
