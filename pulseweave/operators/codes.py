"""Diagnosis codes of cohort admissions, all expressed as ICD-10.

A diagnosis row repeats once per cohort row of its admission, per crosswalk target
and per title.  Those repeats are carried as a count (``n_rows``) instead of being
written out, so an admission with very many rows on both sides costs a
multiplication; :func:`repeat_rows` writes them out where a caller wants them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave.session import materialize, shuffle_count

ADMISSION = ["subject_id", "hadm_id"]
N = "n_rows"
_PART = 65_536


def match_codes(diagnoses: DataFrame, cohort: DataFrame) -> DataFrame:
    """Distinct diagnosis rows of cohort admissions; ``n_rows`` counts the matches.

    The cohort is counted per admission first, so the join only filters: each
    diagnosis meets one row, and what is left merges before the shuffle.
    """
    visits = cohort.groupBy(*ADMISSION).agg(F.count(F.lit(1)).alias("_visits"))
    return (
        diagnoses.join(visits, ADMISSION)
        .groupBy(*diagnoses.columns)
        .agg(F.sum("_visits").alias(N))
    )


def repeat_rows(counted: DataFrame) -> DataFrame:
    """Write each row out ``n_rows`` times.

    Counts expand in two steps, so no single generated array exceeds 65,536 entries
    for counts up to 2^32.
    """
    parts = F.sequence(F.lit(0).cast("long"), F.expr(f"({N} - 1) div {_PART}"))
    size = F.least(F.lit(_PART), F.col(N) - F.col("_part") * _PART)
    return (
        counted.where(F.col(N) > 0)
        .withColumn("_part", F.explode(parts))
        .withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), size)))
        .drop("_part", "_i", N)
    )


def by_admission(rows: DataFrame) -> DataFrame:
    """Place rows by admission, ahead of the steps that multiply them.

    The number of partitions is given, so that it is not reduced by the size of the rows as
    they are: a few MB of diagnoses make gigabytes of targets.  Counting and collecting by
    admission then need no other shuffle.  In reverse order of keys, as Spark would drop a
    repartition that repeats that of a join by admission.
    """
    return rows.repartition(shuffle_count(rows.sparkSession), *reversed(ADMISSION))


def map_to_icd10(matched: DataFrame, gem9: DataFrame) -> DataFrame:
    """Add icd10_code: version-9 codes through the crosswalk, version 10 as they are.

    ``icd_code`` is renamed ``vers_code``.  A version-9 code without a target keeps a
    row with NULL.  The different pairs of the crosswalk are written once: with a known size
    Spark broadcasts them, and the rows are multiplied where they lie.
    """
    table = materialize(
        gem9.groupBy(F.col("i9").alias("_code"), F.col("i10").alias("_target"))
        .agg(F.count(F.lit(1)).alias("_targets"))
    )
    old = F.col("icd_version") == 9
    return (
        matched.withColumnRenamed("icd_code", "vers_code")
        .where(F.col("icd_version").isin(9, 10))
        .join(table, old & (F.col("vers_code") == F.col("_code")), "left")
        .withColumn("icd10_code", F.when(old, F.col("_target")).otherwise(F.col("vers_code")))
        .withColumn(N, F.col(N) * F.coalesce("_targets", F.lit(1)))
        .drop("_code", "_target", "_targets")
    )


def add_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Inner join to the titles: codes without a title drop out.

    Where the dictionary has versions, only version-10 titles count.  The counted titles are
    written once, so that a small dictionary is broadcast, whatever it was counted from.
    """
    if "icd_version" in titles.columns:
        titles = titles.where(F.col("icd_version") == 10)
    named = materialize(
        titles.groupBy(F.col("icd_code").alias("icd10_code"), "long_title").agg(F.count(F.lit(1)).alias("_titles"))
    )
    return (
        rows.join(named, "icd10_code")
        .withColumn(N, F.col(N) * F.col("_titles"))
        .drop("_titles")
    )


def drop_external_causes(rows: DataFrame) -> DataFrame:
    """Without chapter Y of ICD-10."""
    return rows.where(~F.startswith("icd10_code", F.lit("Y")))


def code_counts(codes: DataFrame) -> DataFrame:
    """subject_id, hadm_id, icd10_code, n_rows — one row per admission and code."""
    return codes.groupBy(*ADMISSION, "icd10_code").agg(F.sum(N).alias(N))


def codes_per_admission(codes: DataFrame) -> DataFrame:
    """Sorted codes of each admission with the number of rows of each.

    Counting first leaves at most one entry per code of the title dictionary, which
    bounds the collected array whatever the number of diagnosis rows.
    """
    listed = F.array_sort(F.collect_list(F.struct("icd10_code", N)))
    return (
        code_counts(codes)
        .groupBy(*ADMISSION)
        .agg(listed.alias("_codes"))
        .select(
            *ADMISSION,
            F.col("_codes.icd10_code").alias("codes"),
            F.col(f"_codes.{N}").alias("code_rows"),
        )
    )


def attach_codes(cohort: DataFrame, per_admission: DataFrame) -> DataFrame:
    """Codes for every cohort row; an empty list where the admission has none."""
    return (
        cohort.join(per_admission, ADMISSION, "left")
        .withColumn("codes", F.coalesce("codes", F.expr("CAST(array() AS array<string>)")))
        .withColumn(
            "code_rows", F.coalesce("code_rows", F.expr("CAST(array() AS array<bigint>)"))
        )
    )
