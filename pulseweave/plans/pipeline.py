"""Preprocessing and dataset pipelines over canonical tables.

``tables`` maps logical names to DataFrames in the canonical schema (see
``pulseweave.sources.tables``).  ``version`` 4 or 3 selects the source generation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave import vocab
from pulseweave.operators import chunks, codes, cohort as co, dataset, infusions, labs, recordings, signals
from pulseweave.operators.membership import may_be_in
from pulseweave.session import materialize

Tables = dict[str, DataFrame]


def build_cohort(
    tables: Tables, version: int = 4, ranges: int | None = None, least_hours: float | None = None
) -> DataFrame:
    """Recordings with their stays, demographics and weight.

    With ``least_hours``, only recordings that have each of the final signals for so long.

    Written to the shared folder twice, without and with the weight: every later step
    reads the cohort, and with a known size Spark broadcasts it where it is small.
    """
    meta = tables["wave_meta"]
    if least_hours is not None:
        meta = recordings.filter_signal(meta, min_hours=least_hours)
    matched = co.match_stays(meta, tables["icustays"], version)
    people = materialize(
        co.add_demographics(matched, tables["patients"], tables["admissions"], version)
    )
    if version == 4:
        weights = co.weights_from_inputs(people, tables["inputevents"], ranges)
    else:
        weights = co.weights_from_charts(
            people, tables["weight_events"], tables["d_items"], ranges
        )
    return materialize(co.add_weight(people, weights))


def cohort_labs(tables: Tables, cohort: DataFrame) -> DataFrame:
    """Labelled, listed lab events inside the cohort's recordings.

    Events of other admissions are dropped where they are read, by a filter of fixed
    size, so that the join shuffles little more than what it returns.
    """
    events = may_be_in(tables["labevents"], cohort, ["subject_id", "hadm_id"])
    return labs.match_labs(labs.filter_labs(labs.label_labs(events, tables["d_labitems"])), cohort)


def load_inputs(tables: Tables, version: int = 4, ranges: int | None = None) -> DataFrame:
    """All infusions as canonical intervals, with the system they come from."""
    metavision = infusions.format_metavision(
        infusions.label_items(tables["inputevents"], tables["d_items"])
    ).withColumn("dbsource", F.lit("metavision"))
    if version == 4:
        return metavision
    points = infusions.label_items(tables["inputevents_cv"], tables["d_items"])
    carevue = infusions.format_carevue(points, ranges).withColumn(
        "dbsource", F.lit("carevue")
    )
    return carevue.unionByName(metavision)


def cohort_inputs(
    tables: Tables, cohort: DataFrame, version: int = 4, ranges: int | None = None
) -> DataFrame:
    """Listed infusions around the cohort's recordings; other stays drop out where they are read."""
    sources = ("inputevents", "inputevents_cv") if version == 3 else ("inputevents",)
    own = {name: may_be_in(tables[name], cohort, ["stay_id"]) for name in sources}
    listed = infusions.filter_inputs(load_inputs(tables | own, version, ranges))
    return infusions.match_inputs(listed, cohort)


def cohort_codes(tables: Tables, cohort: DataFrame) -> DataFrame:
    """Titled ICD-10 codes of cohort admissions, repeats as ``n_rows``.

    Placed by admission before the crosswalk multiplies them.
    """
    own = may_be_in(tables["diagnoses_icd"], cohort, codes.ADMISSION)
    matched = codes.by_admission(codes.match_codes(own, cohort))
    mapped = codes.map_to_icd10(matched, tables["gem9"])
    # The chapter filter needs only the code, so it runs ahead of the title join.
    return codes.add_titles(codes.drop_external_causes(mapped), tables["d_icd_diagnoses"])


def preprocess(
    tables: Tables, version: int = 4, ranges: int | None = None, least_hours: float | None = None
) -> Tables:
    """The four derived tables: cohort, labs, inputs, codes; ``least_hours`` as in :func:`build_cohort`."""
    cohort = build_cohort(tables, version, ranges, least_hours)
    return {
        "cohort": cohort,
        "labs": cohort_labs(tables, cohort),
        "inputs": cohort_inputs(tables, cohort, version, ranges),
        "codes": cohort_codes(tables, cohort),
    }


def of_cohort(rows: DataFrame, cohort: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys a cohort has; Spark moves the semi join to where they are read or multiplied."""
    return rows.join(cohort.select(*keys).distinct(), keys, "left_semi")


def build_dataset(
    derived: Tables,
    segments: DataFrame,
    headers: DataFrame,
    target_fs: float = vocab.TARGET_FS,
    seconds: float = vocab.CHUNK_SECONDS,
) -> Tables:
    """Chunk and static tables from the derived tables and the recorded segments.

    Only recordings with a known signal are built: their cohort rows are written once, and of
    the other tables only rows of their stays and admissions are worked on.
    """
    present = signals.signal_map(segments)
    cohort = materialize(derived["cohort"].join(present.select("record_id"), "record_id", "left_semi"))
    inputs = of_cohort(derived["inputs"], cohort, ["stay_id"])
    lab_rows = of_cohort(derived["labs"], cohort, codes.ADMISSION)
    entries = chunks.placed_entries(cohort, inputs, lab_rows, seconds)
    sampled = signals.placed_signals(segments, headers, target_fs, seconds)
    return {
        "chunks": dataset.chunk_dataset(entries, sampled),
        "records": dataset.static_records(
            cohort, present, codes.codes_per_admission(of_cohort(derived["codes"], cohort, codes.ADMISSION))
        ),
    }
