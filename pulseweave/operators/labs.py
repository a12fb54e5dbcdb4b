"""Laboratory events restricted to, and matched with, the cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave import vocab
from pulseweave.functions.timing import HOUR, plus_micros
from pulseweave.operators.membership import may_be_in
from pulseweave.operators.overlap import point_join

LAB_COLUMNS = (
    "labevent_id", "subject_id", "hadm_id", "itemid", "label", "charttime",
    "valuenum", "valueuom", "flag",
)


def label_labs(labs: DataFrame, items: DataFrame) -> DataFrame:
    """Add the item's label; items the dictionary lacks get NULL."""
    return labs.join(items.select("itemid", "label"), "itemid", "left")


def scan_labs(labs: DataFrame, items: DataFrame, cohort: DataFrame) -> DataFrame:
    """Events of cohort admissions only, labelled; most others are dropped ahead of the join's shuffle."""
    admissions = cohort.select("hadm_id").distinct()
    own = may_be_in(labs, admissions, ["hadm_id"]).join(admissions, "hadm_id", "left_semi")
    return label_labs(own, items)


def filter_labs(labs: DataFrame, labels=vocab.LAB_LABELS) -> DataFrame:
    return labs.where(F.col("label").isin(*labels))


def match_labs(labs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Events charted inside a recording, or up to two hours before it.

    One row per event and matching cohort row.
    """
    spans = cohort.select(
        "subject_id", "hadm_id", "record_id", "start_timestamp", "end_timestamp"
    )
    lookback = F.lit(-vocab.LOOKBACK_HOURS * HOUR)
    return point_join(
        labs.select(*[c for c in LAB_COLUMNS if c in labs.columns]),
        spans,
        ["subject_id", "hadm_id"],
        F.col("charttime"),
        (plus_micros("start_timestamp", lookback), F.col("end_timestamp")),
    )


def complete_records(labs: DataFrame, labels=vocab.LAB_LABELS) -> DataFrame:
    """Alternative rule: keep matched labs of recordings that have every listed lab."""
    wanted = labs.where(F.col("label").isin(*labels))
    full = (
        wanted.where(F.col("valuenum").isNotNull())
        .groupBy("record_id")
        .agg(F.countDistinct("label").alias("n"))
        .where(F.col("n") == len(labels))
    )
    return wanted.join(full, "record_id", "left_semi")
