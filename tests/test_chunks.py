import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseweave import vocab
from pulseweave.operators import chunks

T0 = datetime(2024, 1, 1)


def t(seconds):
    return T0 + timedelta(seconds=seconds)


COHORT = ("subject_id long, hadm_id long, stay_id long, record_id long, start_timestamp timestamp_ntz, "
          "end_timestamp timestamp_ntz, weight_kg double")
INPUTS = ("stay_id long, label string, starttime timestamp_ntz, endtime timestamp_ntz, rate double, "
          "rateuom string, amount double, ordercategorydescription string")
LABS = ("labevent_id long, subject_id long, hadm_id long, label string, charttime timestamp_ntz, valuenum double")


def cohort_of(spark, *spans):
    return spark.createDataFrame(
        [(1, 1, s, r, t(a), t(b), 50.0) for s, r, a, b in spans], COHORT
    )


def test_grid_rounds_up(spark):
    grid = chunks.chunk_grid(cohort_of(spark, (1, 1, 0, 121), (1, 2, 0, 120), (1, 3, 5, 5)), 60.0)
    got = sorted((r.record_id, r.chunk_id, r.chunk_start) for r in grid.collect())
    assert got == [(1, 0, t(0)), (1, 1, t(60)), (1, 2, t(120)), (2, 0, t(0)), (2, 1, t(60))]


def test_infusion_chunks_equal_direct_join(spark):
    rnd = random.Random(3)
    spans = [(1, 1, 100, 1000), (1, 2, 500, 1733), (2, 3, 0, 400)]
    cohort = cohort_of(spark, *spans)
    events = []
    for k in range(200):
        a = rnd.choice([rnd.randint(-100, 2000), 60 * rnd.randint(0, 20) + 100])
        events.append((
            rnd.choice([1, 1, 2, 3]), rnd.choice(["Levophed", "Norepinephrine", "Propofol", "Water"]),
            t(a), t(a + rnd.choice([0, 60, 59, 61, 700])), rnd.choice([None, 1.0, 2.5]),
            "mcg/kg/min", rnd.choice([None, 3.0]), rnd.choice(["Continuous Med", "Bolus", "Other"]),
        ))
    inputs = spark.createDataFrame(events, INPUTS)
    want = {}
    drug = {label: d for label, d, _ in vocab.DRUG_ROWS}
    for stay, rec, a, b in spans:
        for c in range(-(-(b - a) // 60)):
            lo, hi = t(a + 60 * c), t(a + 60 * c + 60)
            for s, label, start, end, rate, _, amount, route in events:
                if s != stay or label not in drug or not (start < hi and end > lo):
                    continue
                if rate is None and amount is None:
                    continue
                w = want.setdefault((rec, stay, c, drug[label]), [None, 0, 1])
                if rate is not None and route == "Continuous Med":
                    w[0] = rate if w[0] is None else max(w[0], rate)
                if amount is not None and route == "Bolus":
                    w[1] = 1
    # rows that matching has multiplied change nothing
    got = chunks.chunk_infusions(cohort, inputs.union(inputs), 60.0).collect()
    assert {(r.record_id, r.stay_id, r.chunk_id, r.drug): [r.ratenorm, r.bolus, r.on] for r in got} == want


def test_long_infusion_becomes_chunks_after_the_shuffle(spark):
    cohort = cohort_of(spark, (1, 1, 0, 90_000))
    inputs = spark.createDataFrame([
        (1, "Levophed", t(60), t(72_000), 1.0, "mcg/kg/min", None, "Continuous Med"),
        (1, "Levophed", t(30_000), t(30_600), 2.0, "mcg/kg/min", None, "Continuous Med"),
    ], INPUTS)
    labs = spark.createDataFrame([], LABS)
    drugs = chunks.chunk_infusions(cohort, inputs, 60.0)
    assert {r.chunk_id: r.ratenorm for r in drugs.collect()} == {c: 2.0 if 500 <= c < 510 else 1.0 for c in range(1, 1200)}
    assert drugs.count() == 1199
    plan = drugs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(sequence(first") < plan.index("Exchange ")
    long = chunks.chunk_features_long(cohort, inputs, labs, 60.0)
    assert {(r.feature, r.value): r["count"] for r in long.groupBy("feature", "value").count().collect()} == {
        ("norepinephrine_ratenorm", 1.0): 1189, ("norepinephrine_ratenorm", 2.0): 10, ("norepinephrine_on", 1.0): 1199,
        ("norepi_eq", 1.0): 1189, ("norepi_eq", 2.0): 10, ("vasopressor_on", 1.0): 1199, ("vasoactive_on", 1.0): 1199,
    }


def test_last_lab_wins(spark):
    cohort = cohort_of(spark, (1, 1, 0, 100))
    events = [
        (1, 1, 1, "Sodium", t(0), 1.0), (2, 1, 1, "Sodium", t(59.9), 2.0), (3, 1, 1, "Sodium", t(30), 3.0),
        (4, 1, 1, "Sodium", t(59.95), None), (5, 1, 1, "Potassium", t(60), 4.0),
        (6, 1, 1, "Potassium", t(60), 5.0), (7, 1, 1, "Sodium", t(119), 6.0), (8, 1, 1, "Sodium", t(120), 7.0),
        (9, 1, 1, "Nothing", t(5), 8.0), (10, 1, 2, "Sodium", t(5), 9.0),
    ]
    got = chunks.chunk_labs(cohort, spark.createDataFrame(events, LABS), 60.0).collect()
    # the last chunk reaches past the end of the recording
    assert {(r.chunk_id, r.feature): r.value for r in got} == {
        (0, "sodium"): 2.0, (1, "potassium"): 5.0, (1, "sodium"): 6.0}


def test_wide_row(spark):
    cohort = cohort_of(spark, (1, 1, 0, 180))
    inputs = spark.createDataFrame(
        [(1, "Levophed", t(0), t(50), 0.5, "mcg/kg/min", None, "Continuous Med"),
         (1, "Vasopressin", t(10), t(20), 120.0, "units/hour", None, "Continuous IV"),
         (1, "Cisatracurium", t(10), t(20), None, None, 5.0, "Drug Push"),
         (1, "Propofol", t(130), t(140), 9.0, "mcg/kg/min", None, "Other")],
        INPUTS,
    )
    labs = spark.createDataFrame([(1, 1, 1, "pH", t(70), 7.4)], LABS)
    wide = chunks.chunk_features(cohort, inputs, labs, 60.0)
    assert wide.columns[4:] == vocab.feature_names()
    a, b, c = sorted(wide.collect(), key=lambda r: r.chunk_id)
    assert a.chunk_start == t(0) and c.chunk_start == t(120)
    assert (a.norepinephrine_ratenorm, a.vasopressin_ratenorm, a.norepi_eq) == (0.5, 2.0, 5.5)
    assert (a.vasopressor_on, a.nm_blocker_on, a.cisatracurium_bolus, a.vasoactive_on) == (1, 1, 1, 1)
    assert (b.ph, b.norepi_eq, b.vasoactive_on, b.norepinephrine_ratenorm) == (7.4, 0.0, 0, None)
    assert (c.propofol_on, c.propofol_ratenorm, c.sedative_analgesic_on, c.ph) == (1, None, 1, None)
    long = chunks.chunk_features_long(cohort, inputs, labs, 60.0)
    got = {(r.chunk_id, r.feature): r.value for r in long.collect()}
    default = {n: 0 if n in vocab.FLAG_FEATURES else (0.0 if n == "norepi_eq" else None)
               for n in vocab.feature_names()}
    for row in (a, b, c):
        for name in vocab.feature_names():
            assert got.get((row.chunk_id, name), default[name]) == row[name], name


def test_features_keep_the_grid(spark):
    cohort = cohort_of(spark, (1, 1, 0, 6000), (2, 1, 0, 6000))
    none_in = spark.createDataFrame([], INPUTS)
    none_lab = spark.createDataFrame([], LABS)
    wide = chunks.chunk_features(cohort, none_in, none_lab, 60.0)
    assert wide.count() == chunks.chunk_grid(cohort, 60.0).count() == 200
    assert wide.where(F.col("norepi_eq") != 0).count() == 0
