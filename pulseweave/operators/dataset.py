"""The final dataset: one row per chunk and one static row per (recording, stay)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseweave import vocab
from pulseweave.operators.chunks import CHUNK, feature_struct, identity, in_entries
from pulseweave.operators.codes import attach_codes
from pulseweave.operators.signals import signal_flags

STATIC_COLUMNS = (
    "source_version", "subject_id", "hadm_id", "stay_id", "record_id", "age", "age_group",
    "ethnicity_group", "gender", "weight_kg", "los", "dbsource",
)


def path_key(subject_id, record_id, base: str = "") -> Column:
    """Where a recording lives: ``[base/]p{first 3 digits}/p{subject}/{record}``."""
    subject = F.col(subject_id).cast("string") if isinstance(subject_id, str) else subject_id
    record = F.col(record_id).cast("string") if isinstance(record_id, str) else record_id
    lead = [F.lit(base.rstrip("/"))] if base else []
    return F.concat_ws(
        "/", *lead,
        F.concat(F.lit("p"), F.substring(subject, 1, 3)),
        F.concat(F.lit("p"), subject),
        record,
    )


def chunk_dataset(entries: DataFrame, signals: DataFrame) -> DataFrame:
    """source_version, subject_id, hadm_id, record_id, stay_id, chunk_id, block, chunk_start, signals, ehr.

    ``entries`` are the event features over the whole grid (``chunks.placed_entries``),
    ``signals`` has a map of samples per recorded chunk.  A chunk past the end of the
    recorded samples keeps its row with no signals and default features; recorded chunks
    past the grid drop out.  Both inputs come placed by (recording, block), so neither
    moves for the join, and the rows leave placed for the writer.  The 214 features are
    made of their entries after the join.
    """
    ehr = (
        F.when(F.col("signals").isNull(), feature_struct(None, "FLOAT", False))
        .when(F.col("entries").isNull(), feature_struct(None, "FLOAT"))
        .otherwise(feature_struct(in_entries, "FLOAT"))
    )
    return entries.join(signals, ["record_id", "block", "chunk_id"], "left").select(
        *identity(entries), *CHUNK, "block", "chunk_start", "signals", ehr.alias("ehr")
    )


def static_records(
    cohort: DataFrame, signals: DataFrame, codes_per_admission: DataFrame
) -> DataFrame:
    """Identity, demographics, signal flags and codes of each cohort row.

    ``signals`` is the signal map; recordings without a known signal have no row.
    """
    flags = signal_flags(signals)
    rows = cohort.select(*[c for c in STATIC_COLUMNS if c in cohort.columns])
    return attach_codes(rows.join(flags, "record_id"), codes_per_admission)


def run_summary(
    cohort: DataFrame, labs: DataFrame, inputs: DataFrame, codes: DataFrame
) -> DataFrame:
    """metric, value — distinct recordings in all, with labs, with infusions; subjects with codes."""
    ids = [
        (cohort, "record_id", "total_records"),
        (labs, "record_id", "records_with_labs"),
        (inputs, "record_id", "records_with_inputs"),
        (codes, "subject_id", "subjects_with_codes"),
    ]
    stacked = None
    for df, column, metric in ids:
        part = df.select(F.lit(metric).alias("metric"), F.col(column).alias("id"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("metric").agg(F.countDistinct("id").alias("value"))
