"""Writers: derived tables, the chunk dataset, static rows, event indexes."""

from __future__ import annotations

import posixpath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.operators.chunks import block_of, by_block
from pulseweave.session import materialize

#: Files that the static rows of a source version are spread over.
RECORD_BUCKETS = 64


def save_derived(derived: dict[str, DataFrame], root: str, version: int) -> None:
    """One Parquet table per derived table, a partition per source version.

    Replaces the given version and no other; an empty table leaves that version empty.
    """
    for name, df in derived.items():
        df.drop("source_version").write.mode("overwrite").parquet(
            posixpath.join(root, name, f"source_version={version}")
        )


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """The rows as the writer takes them: whole blocks of a recording in one task, in order.

    Rows that carry ``block`` are placed already and move no more.
    """
    if "block" not in chunks.columns:
        chunks = by_block(chunks.withColumn("block", block_of("chunk_id")))
    return chunks.sortWithinPartitions("record_id", "stay_id", "chunk_id").drop("block")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunk dataset, partitioned by source version, where known, and recording; zstd-compressed.

    Re-running for some recordings replaces just these, of their own version.  Chunks are spread over tasks
    by (recording, block of chunks), so a very long recording is written by many
    tasks, in sorted files.
    """
    (
        chunk_rows(chunks)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*[c for c in ("source_version", "record_id") if c in chunks.columns])
        .parquet(path)
    )


def write_records(records: DataFrame, path: str, buckets: int = RECORD_BUCKETS) -> None:
    """Static rows, one file per bucket of recordings and source version.

    Re-running for some recordings replaces just these: of the buckets they fall into,
    the rows of other recordings are read, merged with the new ones and written again;
    other buckets and versions stay untouched.  ``buckets`` must stay the same for a path.
    """
    place, one = ["source_version", "bucket"], ["source_version", "record_id"]
    merged = records.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(buckets)).cast("int"))
    stored = _stored(records.sparkSession, path)
    if stored is not None:
        new = materialize(merged)
        others = stored.join(new.select(*place).distinct(), place, "left_semi").join(
            new.select(*one).distinct(), one, "left_anti"
        )
        # Written aside first: a file must not be read while it is replaced.
        merged = materialize(new.unionByName(others, allowMissingColumns=True))
    (
        merged.repartition(*place)
        .sortWithinPartitions(*place, "record_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*place)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """What has been written to ``path``, if anything."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as nothing:
        if nothing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save_indexed(
    df: DataFrame, table: str, keys: list[str], buckets: int = 256, path: str | None = None
) -> None:
    """A table bucketed and sorted by ``keys``: repeated joins on them need no shuffle."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
