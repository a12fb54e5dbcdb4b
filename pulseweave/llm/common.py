"""Reading tables, batch sizes and the list of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows of an Arrow batch.  Texts are read whole, so this bounds a Python worker's memory.
BATCH_ROWS = 512


def query(name: str, oracle: str | None = None):
    """Register ``f(spark, directory)`` under ``name``."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that the operators count on."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    prepare(spark)
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_fold(doc_id, folds: int):
    """Remainder of the unsigned CRC-32 of the identifier's decimal digits."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
