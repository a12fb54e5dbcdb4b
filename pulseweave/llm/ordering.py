"""Running totals over a whole table in one global order, without one global task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseweave.session import materialize

PARTITION, PLACE = "__partition", "__place"


def ordered_table(df: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of ``order``, written once with the number of each row's range.

    ``order`` should end in columns that tell rows apart: then one value that many rows
    share is cut into as many ranges as its rows need.  Rows that are equal in all of
    ``order`` should be equal in all columns that matter.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    return materialize(ranged.withColumn(PARTITION, F.spark_partition_id()))


def running_totals(table: DataFrame, order: list[str], sums: dict[str, str], key: str | None = None) -> DataFrame:
    """Add exclusive running sums to what :func:`ordered_table` returned.

    ``sums`` names output columns and the column each adds up.  Every range is summed by
    itself, the totals of the ranges before it are added: that small table has a row per
    range (and value of ``key``), never more.  With ``key`` the sums restart at each of
    its values; ``order`` must then begin with it.
    """
    parts = [PARTITION] + ([key] if key else [])
    totals = table.groupBy(*parts).agg(*[F.sum(c).alias(f"__{out}") for out, c in sums.items()])
    earlier = Window.orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    if key:
        earlier = Window.partitionBy(key).orderBy(PARTITION).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*parts, *[
        F.coalesce(F.sum(f"__{out}").over(earlier), F.lit(0)).alias(f"__{out}") for out in sums
    ])
    within = Window.partitionBy(*parts).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    within = within.rowsBetween(Window.unboundedPreceding, -1)
    local = table.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(out) for out, c in sums.items()])
    same = local[PARTITION] == offsets[PARTITION]
    if key:
        same = same & local[key].eqNullSafe(offsets[key])
    added = [(local[out] + offsets[f"__{out}"]).alias(out) for out in sums]
    kept = [local[c] for c in table.columns if c != PARTITION]
    return local.join(offsets, same).select(*kept, *added)
