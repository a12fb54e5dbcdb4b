"""Recordings matched to ICU stays, with demographics and body weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave import vocab
from pulseweave.functions import clinical
from pulseweave.functions.timing import hours_between, micros
from pulseweave.operators.ordered import nearest
from pulseweave.operators.overlap import overlap_join

STAY_COLUMNS = (
    "subject_id", "hadm_id", "stay_id", "first_careunit", "last_careunit",
    "intime", "outtime", "los", "dbsource",
)


def match_stays(meta: DataFrame, stays: DataFrame, version: int = 4) -> DataFrame:
    """Recordings joined to the stays they overlap in time (strictly).

    Version 4 knows the admission of a recording; version 3 only the subject, and
    takes the admission from the stay.  ``hrs_overlap`` counts from the stay's start
    to the recording's end; ``hrs_overlap_true`` is the length of the intersection.
    """
    if version == 4:
        keys = ["subject_id", "hadm_id"]
        stays = stays.withColumn("dbsource", F.lit("metavision"))
    else:
        keys = ["subject_id"]
        meta = meta.drop("hadm_id")
    matched = overlap_join(
        meta,
        stays.select(*STAY_COLUMNS),
        keys,
        (F.col("start_timestamp"), F.col("end_timestamp")),
        (F.col("intime"), F.col("outtime")),
    )
    return matched.withColumns(
        {
            "hrs_overlap": hours_between("intime", "end_timestamp"),
            "hrs_overlap_true": hours_between(
                F.greatest("start_timestamp", "intime"), F.least("end_timestamp", "outtime")
            ),
        }
    )


def add_demographics(
    cohort: DataFrame, patients: DataFrame, admissions: DataFrame, version: int = 4
) -> DataFrame:
    """Age at admission, age group, gender and ethnicity group."""
    if version == 4:
        person = ["anchor_age", "anchor_year"]
        race = F.col("race").alias("ethnicity")
        age = clinical.age_from_anchor(
            F.col("admittime"), F.col("anchor_age"), F.col("anchor_year")
        )
    else:
        person = ["dob"]
        race = F.col("ethnicity")
        age = clinical.age_from_birth(F.col("admittime"), F.col("dob"))
    people = patients.select("subject_id", *person, "gender")
    visits = admissions.select("subject_id", "hadm_id", "admittime", "dischtime", race)
    return (
        cohort.join(people, "subject_id")
        .join(visits, ["subject_id", "hadm_id"])
        .withColumn("age", age)
        .withColumn("age_group", clinical.age_group(F.col("age")))
        .withColumn("ethnicity_group", clinical.ethnicity_group(F.col("ethnicity")))
    )


def scan_weight_events(chart_events: DataFrame, *more: str) -> DataFrame:
    """The six columns and 17 items of the charted events that can carry a weight.

    ``more`` names further columns to keep, such as the ``row_id`` that breaks ties.
    """
    return chart_events.where(F.col("itemid").isin(*vocab.WEIGHT_ITEMIDS)).select(
        "itemid", "stay_id", "charttime", "value", "valuenum", "valueuom", *more
    )


def _nearest_weight(
    cohort: DataFrame, weights: DataFrame, keys: list[str], ranges: int | None
) -> DataFrame:
    """One weight per stay: closest in time to the start of any of its recordings.

    ``weights``: keys, ``at``, ``weight_kg``, ``event_key``.  Equal distances go to
    the earlier measurement, then to the smaller event key.  Measurements are first
    reduced to one per (stay, time), then placed next to the recording starts by one
    ordered pass; no stay has its measurements paired with its recordings.
    """
    points = (
        weights.groupBy(*keys, "at")
        .agg(F.min(F.struct("event_key", "weight_kg")).alias("_m"))
        .select(*keys, "at", F.struct("at", "_m.event_key", "_m.weight_kg").alias("_m"))
    )
    probes = cohort.select(*keys, F.col("start_timestamp").alias("at")).distinct()
    placed = nearest(probes, points, keys, "at", "_m", ranges)

    def candidate(side):
        gap = F.abs(micros("at") - micros(F.col(side)["at"]))
        return F.when(
            F.col(side).isNotNull(),
            F.struct(
                gap.alias("gap"),
                F.col(side)["at"].alias("at"),
                F.col(side)["event_key"].alias("event_key"),
                F.col(side)["weight_kg"].alias("weight_kg"),
            ),
        )

    return (
        placed.withColumn("_best", F.least(candidate("before"), candidate("after")))
        .groupBy("stay_id")
        .agg(F.min("_best").alias("_best"))
        .where(F.col("_best").isNotNull())
        .select("stay_id", F.col("_best.weight_kg").alias("weight_kg"))
    )


def weights_from_charts(
    cohort: DataFrame, weight_events: DataFrame, items: DataFrame, ranges: int | None = None
) -> DataFrame:
    """stay_id, weight_kg from charted weights (version 3); pounds are converted first.

    ``weight_events`` may carry a ``row_id``; equal times then go to the smaller one.
    """
    tie = "row_id" if "row_id" in weight_events.columns else "itemid"
    kg = clinical.weight_in_kg(clinical.not_nan(F.col("valuenum")), F.col("label"))
    labelled = weight_events.join(
        items.select("itemid", "label").where(F.col("label").isin(*vocab.WEIGHT_LABELS)),
        "itemid",
    )
    valid = labelled.select(
        "stay_id",
        F.col("charttime").alias("at"),
        kg.alias("weight_kg"),
        F.col(tie).alias("event_key"),
    ).where(clinical.plausible_weight(F.col("weight_kg")) & F.col("at").isNotNull())
    return _nearest_weight(cohort, valid, ["stay_id"], ranges)


def weights_from_inputs(
    cohort: DataFrame, inputs: DataFrame, ranges: int | None = None
) -> DataFrame:
    """stay_id, weight_kg from the weight noted with an infusion (version 4)."""
    tie = "inputevent_id" if "inputevent_id" in inputs.columns else "itemid"
    keys = ["subject_id", "hadm_id", "stay_id"]
    valid = inputs.select(
        *keys,
        F.col("starttime").alias("at"),
        clinical.not_nan(F.col("patientweight").cast("double")).alias("weight_kg"),
        F.col(tie).alias("event_key"),
    ).where(clinical.plausible_weight(F.col("weight_kg")) & F.col("at").isNotNull())
    return _nearest_weight(cohort, valid, keys, ranges)


def max_weight(cohort: DataFrame, inputs: DataFrame) -> DataFrame:
    """Alternative rule: the largest valid infusion weight of each cohort stay."""
    keys = ["subject_id", "hadm_id", "stay_id"]
    kg = clinical.not_nan(F.col("patientweight").cast("double"))
    return (
        inputs.where(clinical.plausible_weight(kg))
        .groupBy(*keys)
        .agg(F.max(kg).alias("weight_kg"))
        .join(cohort.select(*keys).distinct(), keys, "left_semi")
        .select("stay_id", "weight_kg")
    )


def add_weight(cohort: DataFrame, weights: DataFrame) -> DataFrame:
    """Attach one weight per stay; stays without one get NULL."""
    return cohort.join(weights, "stay_id", "left")
