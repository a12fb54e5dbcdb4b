"""Diagnosis and procedure code translation through the equivalence tables.

An equivalence table has the columns i9, i10, flag.  The forward table is read from
i9 to i10, the backward table from i10 to i9; both directions are many-to-many.
Diagnosis (cm) and procedure (pcs) codes work alike on their own tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave.operators.codes import N, repeat_rows
from pulseweave.session import materialize, shuffle_count


def _translated(codes: DataFrame, table: DataFrame) -> DataFrame:
    """code, target, flag, n_rows of each distinct code; rows that a table repeats are carried as a count.

    The number of partitions of the codes is given, since few codes can have many targets; by
    a hash of the code, as Spark would drop a repartition that repeats that of ``distinct``.
    """
    spread = codes.select("code").distinct().repartition(shuffle_count(codes.sparkSession), F.xxhash64("code"))
    counted = table.groupBy("code", "target", "flag").agg(F.count(F.lit(1)).alias(N))
    joined = spread.join(counted, "code", "left")
    return joined.withColumn(N, F.coalesce(N, F.lit(1)))


def forward(codes: DataFrame, gem9: DataFrame) -> DataFrame:
    """code, target, flag — the ICD-10 targets of each distinct code.

    A code without any target keeps one row with NULLs.  What the table repeats is joined
    once and written out after that.
    """
    table = gem9.select(F.col("i9").alias("code"), F.col("i10").alias("target"), "flag")
    return repeat_rows(_translated(codes, table))


def backward(codes: DataFrame, gem10: DataFrame) -> DataFrame:
    """code, target, flag — the ICD-9 targets of each distinct code."""
    table = gem10.select(F.col("i10").alias("code"), F.col("i9").alias("target"), "flag")
    return repeat_rows(_translated(codes, table))


def forward_backward(codes: DataFrame, gem9: DataFrame, gem10: DataFrame) -> DataFrame:
    """Union of both directions, without repeats; NULLs only for wholly unmapped codes.

    One pass: both tables are stacked by the code they are read from, so the codes
    are joined once.
    """
    tables = (
        gem9.select(F.col("i9").alias("code"), F.col("i10").alias("target"), "flag")
        .unionByName(
            gem10.select(F.col("i10").alias("code"), F.col("i9").alias("target"), "flag")
        )
        .distinct()
    )
    return codes.select("code").distinct().join(tables, "code", "left")


def secondary_codes(codes: DataFrame, gem9: DataFrame, gem10: DataFrame) -> DataFrame:
    """code — the ICD-9 codes that share a target of ``codes`` in either table.

    Two semi joins on distinct sets; which input led to which code is not kept, so
    no pairs are formed around a popular target.
    """
    targets = (
        forward_backward(codes, gem9, gem10)
        .where(F.col("target").isNotNull())
        .select(F.col("target").alias("i10"))
        .distinct()
    )
    tables = gem9.select("i9", "i10").unionByName(gem10.select("i9", "i10"))
    return (
        tables.join(targets, "i10", "left_semi").select(F.col("i9").alias("code")).distinct()
    )


def secondary(codes: DataFrame, gem9: DataFrame, gem10: DataFrame) -> DataFrame:
    """Both-direction matches of the codes and of their secondary codes."""
    every = codes.select("code").unionByName(secondary_codes(codes, gem9, gem10)).distinct()
    return forward_backward(every, gem9, gem10)


def convert_batch(
    codes: DataFrame, kind: str, tables: dict[str, DataFrame], by: str | None = None
) -> DataFrame:
    """Code lists to rows: [by,] icd9, icd10, flag; unmapped codes keep NULLs.

    ``tables`` maps ``cm`` and ``pcs`` to their forward tables; any other ``kind``
    gives an empty frame.  ``by`` names a list column (such as the file a code came
    from): repeats are dropped within a list.
    """
    lead = [by] if by else []
    distinct = codes.select(*lead, F.col("code").alias("icd9")).distinct()
    if kind not in tables:
        return distinct.select(
            *lead,
            "icd9",
            F.lit(None).cast("string").alias("icd10"),
            F.lit(None).cast("string").alias("flag"),
        ).limit(0)
    table = tables[kind].select(
        F.col("i9").alias("icd9"), F.col("i10").alias("icd10"), "flag"
    )
    return distinct.join(table, "icd9", "left").select(*lead, "icd9", "icd10", "flag")


def merge_maps(base: DataFrame, new: DataFrame) -> DataFrame:
    """Set union of two code maps (code, target, flag).

    The different rows are written once, so that the maps are made once and no task holds
    the steps of both, twice.
    """
    merged = materialize(base.unionByName(new).distinct())
    mapped = merged.where(F.col("target").isNotNull())
    lone = merged.where(F.col("target").isNull()).join(mapped, "code", "left_anti")
    return mapped.unionByName(lone)
