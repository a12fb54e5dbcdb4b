"""Contiguous shards of nearly equal byte size from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.ordering import ordered_table, running_totals
from pulseweave.session import materialize

ROW_OVERHEAD = 16


def shard(docs: DataFrame, shards: int, id_column: str = "doc_id", text: str = "text",
          overhead: int = ROW_OVERHEAD) -> DataFrame:
    """Place documents into ``shards`` contiguous shards: (id, size, text_crc32, shard, slot).

    Documents are ordered by (text_crc32, size, id), which puts equal texts side by side
    and mixes everything else.  A document whose prefix of bytes is ``start`` goes to
    shard ``start * shards / total``.  A group of equal texts that a cut falls in stays
    whole, in the shard it starts in, if it is no larger than the largest document;
    larger groups are cut between documents.  So no shard is further from the equal size
    than about the largest document, as when no group were kept.  Slots number the rows
    of a shard in that order.

    Only identifiers, sizes and checksums are shuffled, never texts.  At most
    ``shards - 1`` groups can hold a cut; they and the start of each shard are the only
    broadcast tables.  A NULL text has the size ``overhead`` and a NULL checksum and
    groups with other NULL texts; an empty text has checksum 0.  Rows that repeat, NULL
    identifiers included, get a slot each.  An empty table gives an empty result.
    """
    raw = F.col(text).cast("binary")
    narrow = docs.select(
        F.col(id_column).alias("id"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"), F.lit(1).cast("long").alias("one"),
    )
    order = ["text_crc32", "size", "id"]
    placed = materialize(running_totals(ordered_table(narrow, order), order, {"start": "size", "row": "one"}))
    total, largest = placed.agg(F.sum("size"), F.max("size")).first()
    # A quotient of doubles could round across a cut; whole numbers can't.
    placed = placed.withColumn("shard", F.expr(f"start * {shards} div {max(total or 0, 1)}").cast("int"))
    # A cut lies in a group whose rows fall on two shards: one such group per cut at most.
    same = ["text_crc32", "size"]
    held = (
        placed.groupBy(*same).agg(F.min("shard").alias("first"), F.max("shard").alias("last"),
                                  F.sum("size").alias("bytes"))
        .where((F.col("first") < F.col("last")) & (F.col("bytes") <= (largest or 0))).select(*same, "first")
    )
    placed = placed.alias("p").join(
        F.broadcast(held.alias("h")),
        F.col("p.text_crc32").eqNullSafe(F.col("h.text_crc32")) & (F.col("p.size") == F.col("h.size")), "left",
    ).select("p.id", "p.size", "p.text_crc32", "p.row", F.coalesce("h.first", "p.shard").alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))
    return placed.join(F.broadcast(starts), "shard").select(
        F.col("id").alias(id_column), "size", "text_crc32", "shard", (F.col("row") - F.col("first_row")).alias("slot"),
    )


@query("op8_sharding")
def op8_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = shard(table(spark, directory, "documents", "doc_id", "text"), 40)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})
