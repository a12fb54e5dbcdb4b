import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseweave import vocab
from pulseweave.functions import clinical
from pulseweave.operators import cohort as co, labs, ordered, recordings
from pulseweave.operators.overlap import overlap_join, point_join

T0 = datetime(2024, 1, 1)


def t(hours):
    return T0 + timedelta(hours=hours)


def test_age_groups(spark):
    ages = [-1, 0, 1, 17, 18, 25, 26, 35, 36, 45, 46, 55, 56, 65, 66, 75, 76, 85, 86, 120, None]
    want = [None, None, "<18", "<18", "18-25", "18-25", "26-35", "26-35", "36-45", "36-45", "46-55",
            "46-55", "56-65", "56-65", "66-75", "66-75", "76-85", "76-85", "85>", "85>", None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ages)], "i int, age int")
    got = [r[0] for r in df.orderBy("i").select(clinical.age_group(F.col("age"))).collect()]
    assert got == want


def test_ethnicity(spark):
    cases = {
        "White - Russian": "WHITE", "BLACK/CAPE VERDEAN": "BLACK/AFRICAN AMERICAN",
        "HISPANIC OR LATINO": "HISPANIC/LATINO", "ASIAN - CHINESE": "ASIAN", "CAUCASIAN": "ASIAN",
        "WHITE HISPANIC": "WHITE", "UNABLE TO OBTAIN": "UNKNOWN", "PATIENT DECLINED": "UNKNOWN",
        "Unknown": "UNKNOWN", "PORTUGUESE": "OTHER", None: "OTHER",
    }
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    got = df.select("e", clinical.ethnicity_group(F.col("e"))).collect()
    assert {r[0]: r[1] for r in got} == cases


def test_rate_units(spark):
    cases = [
        (6.0, "mcg/kg/min", 6.0), (6.0, "ng/kg/min", 0.006), (6.0, "mg/kg/hour", 100.0),
        (6000.0, "mcg/hour", 2.0), (6.0, "mg/hour", 2.0), (6.0, "mg/min", 120.0),
        (6.0, "units/hour", 0.1), (6.0, "mL/hour", 6.0), (6.0, None, 6.0),
    ]
    df = spark.createDataFrame([(r, u, 50.0) for r, u, _ in cases], "r double, u string, w double")
    got = [x[0] for x in df.select(clinical.normalized_rate(F.col("r"), F.col("u"), F.col("w"))).collect()]
    assert got == pytest.approx([w for *_, w in cases])
    missing = spark.createDataFrame([(None, "mg/min", 50.0), (1.0, "mg/min", None)], df.schema)
    got = missing.select(clinical.normalized_rate(F.col("r"), F.col("u"), F.col("w"))).collect()
    assert [x[0] for x in got] == [None, None]


def test_overlap_is_strict(spark, rows):
    meta = spark.createDataFrame(
        [(1, 1, 1, t(0), t(10)), (1, 1, 2, t(10), t(20)), (1, 1, 3, t(20), t(30)), (1, 1, 4, t(5), t(500))],
        "subject_id long, hadm_id long, record_id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz",
    )
    stays = spark.createDataFrame(
        [(1, 1, 7, "A", "B", t(10), t(20), 1.0, "x"), (1, 2, 8, "A", "B", t(10), t(20), 1.0, "x")],
        "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, "
        "intime timestamp_ntz, outtime timestamp_ntz, los double, dbsource string",
    )
    four = co.match_stays(meta, stays, 4)
    assert rows(four, "record_id", "stay_id") == [(2, 7), (4, 7)]
    assert {r.record_id: (r.hrs_overlap, r.hrs_overlap_true) for r in four.collect()} == {
        2: (10.0, 10.0), 4: (490.0, 10.0)}
    three = co.match_stays(meta, stays, 3)
    assert rows(three, "record_id", "stay_id", "hadm_id") == [
        (2, 7, 1), (2, 8, 2), (4, 7, 1), (4, 8, 2)]


def test_overlap_join_equals_all_pairs(spark, rows):
    rnd = random.Random(5)

    def side(n, name):
        data = []
        for k in range(n):
            a = rnd.choice([rnd.uniform(0, 300), rnd.uniform(0, 9000)])
            data.append((1 if rnd.random() < 0.7 else 2, k, t(a), t(a + rnd.choice([0, 1, 30, 200, -5, 1600, 9000, -4000]))))
        return spark.createDataFrame(data, f"key int, {name} int, {name}s timestamp_ntz, {name}e timestamp_ntz")

    a, b = side(80, "a"), side(60, "b")
    got = overlap_join(a.unionByName(a.limit(1).withColumn("ae", F.lit(None).cast("timestamp_ntz"))), b, ["key"], (F.col("as"), F.col("ae")), (F.col("bs"), F.col("be")))
    want = a.join(b, "key").where("as < be AND ae > bs")
    assert rows(got, "key", "a", "b") == rows(want, "key", "a", "b")
    got = point_join(a, b, ["key"], F.col("as"), (F.col("bs"), F.col("be")))
    want = a.join(b, "key").where("as >= bs AND as < be")
    assert rows(got, "key", "a", "b") == rows(want, "key", "a", "b")


def test_lab_window_borders(spark, rows):
    cohort = spark.createDataFrame(
        [(1, 1, 5, t(10), t(20))],
        "subject_id long, hadm_id long, record_id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz",
    )
    times = [7.99, 8, 10, 19.99, 20, None]
    events = spark.createDataFrame(
        [(k, 1, 1, 1, "Sodium", t(h) if h is not None else None, 1.0) for k, h in enumerate(times)],
        "labevent_id long, subject_id long, hadm_id long, itemid long, label string, "
        "charttime timestamp_ntz, valuenum double",
    )
    assert rows(labs.match_labs(events, cohort), "labevent_id") == [(1,), (2,), (3,)]


COHORT = "subject_id long, hadm_id long, stay_id long, record_id long, start_timestamp timestamp_ntz"
INPUTS = ("inputevent_id long, subject_id long, hadm_id long, stay_id long, "
          "starttime timestamp_ntz, patientweight double")


@pytest.mark.parametrize("ranges", [1, 5, 60])
def test_nearest_weight_equals_all_pairs(spark, ranges):
    rnd = random.Random(11)
    stays = [1] * 5 + [2, 3, 4]
    cohort = [(1, 1, rnd.choice(stays), k, t(rnd.randint(0, 200))) for k in range(60)]
    inputs = [
        (k, 1, 1, rnd.choice(stays), t(rnd.randint(0, 200)), rnd.choice([None, 10.0, 20.0, 70.0 + k, 500.0, 501.0]))
        for k in range(300)
    ]
    best = {}
    for _, _, stay, _, start in cohort:
        for key, _, _, s, at, kg in inputs:
            if s == stay and kg is not None and 20 <= kg <= 500:
                best[stay] = min(best.get(stay, (timedelta.max,)), (abs(start - at), at, key, kg))
    got = co.weights_from_inputs(
        spark.createDataFrame(cohort, COHORT), spark.createDataFrame(inputs + [(900, 1, 1, None, t(3), 70.0), (901, 1, 1, 1, None, 70.0)], INPUTS), ranges
    ).collect()
    assert {r.stay_id: r.weight_kg for r in got} == {s: b[3] for s, b in best.items()}


def test_chart_weights_convert_before_the_range(spark):
    cohort = spark.createDataFrame([(1, 1, 1, 1, t(0)), (1, 1, 2, 2, t(0)), (1, 1, 3, 3, t(0))], COHORT)
    items = spark.createDataFrame(
        [(1, "Daily Weight"), (2, "Admission Weight (lbs.)"), (3, "Present Weight (kg)")],
        "itemid long, label string",
    )
    events = spark.createDataFrame(
        [(1, 1, 1, t(5), 80.0), (2, 3, 1, t(1), 60.0), (3, 1, 1, t(0), float("nan")),
         (4, 2, 2, t(1), 1000.0), (5, 2, 2, t(0), 44.0), (6, 1, 3, t(0), 20.0), (7, 1, 3, t(0), 500.0)],
        "row_id long, itemid long, stay_id long, charttime timestamp_ntz, valuenum double",
    )
    got = {r.stay_id: round(r.weight_kg, 4) for r in co.weights_from_charts(cohort, events, items).collect()}
    assert got == {1: 80.0, 2: 453.592, 3: 20.0}


@pytest.mark.parametrize("ranges", [1, 7])
def test_previous_time(spark, ranges):
    data = [(1, t(h)) for h in range(0, 60, 3)] + [(2, t(1)), (2, t(4))]
    df = spark.createDataFrame(data, "k int, at timestamp_ntz")
    got = {(r.k, r.at): r.p for r in ordered.previous_time(df, ["k"], "at", "p", ranges).collect()}
    assert got == {(k, at): (at - timedelta(hours=3) if (k, at) not in [(1, t(0)), (2, t(1))] else None)
                   for k, at in data}


def test_running_total_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "_BLOCK", 4)
    data = [(r, i, i * r) for r in (1, 2) for i in range(1, 20)]
    df = spark.createDataFrame(data, "r int, i int, n int")
    got = {(x.r, x.i): x.s for x in ordered.running_total(df, "r", "i", "n", "s").collect()}
    assert got == {(r, i): r * sum(range(1, i)) for r, i, _ in data}


def test_meta_hours_round_half_even_and_filter(spark):
    raw = spark.createDataFrame(
        [(4, "7", "8", "9", 1.0, 900, T0, 900, 900, 2700), (4, "7", "bad", "9", 1.0, 5400, T0, 0, 1800, 1800)],
        "source_version int, subject_id string, hadm_id string, record_id string, fs double, record_len long, "
        "start_timestamp timestamp_ntz, total_samples long, II_samples long, ABP_samples long",
    )
    meta = recordings.format_meta(raw)
    a, b = meta.collect()
    assert (a.II_hrs, a.ABP_hrs, a.PLETH_hrs, a.record_hrs) == (0.2, 0.8, 0.0, 0.2)
    assert b.hadm_id is None and a.end_timestamp == T0 + timedelta(seconds=900)
    assert recordings.filter_signal(meta, ["ABP"], 0.5).count() == 2
    assert recordings.filter_signal(meta).count() == 0
    assert {f"{s}_hrs" for s in vocab.SIGNALS} <= set(meta.columns)


def test_complete_records(spark):
    df = spark.createDataFrame(
        [(1, "A", 1.0), (1, "B", 2.0), (2, "A", 1.0), (2, "B", None), (1, "C", 1.0)],
        "record_id int, label string, valuenum double",
    )
    got = labs.complete_records(df, ("A", "B")).collect()
    assert sorted((r.record_id, r.label) for r in got) == [(1, "A"), (1, "B")]


def test_wrong_end_dates_make_no_rows_of_cells(spark):
    far = datetime(9999, 1, 1)
    rnd = random.Random(2)
    left = [(k, 1, t(10 * k), far if k % 9 == 0 else t(10 * k + rnd.randint(0, 400))) for k in range(40)]
    right = [(k, 1, t(15 * k), far if k % 7 == 0 else t(15 * k + rnd.randint(0, 2000))) for k in range(30)]
    a = spark.createDataFrame(left, "l int, k int, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame(right, "r int, k int, f timestamp_ntz, u timestamp_ntz")
    got = sorted((x.l, x.r) for x in overlap_join(a, b, ["k"], (F.col("s"), F.col("e")), (F.col("f"), F.col("u"))).collect())
    assert got == sorted((i, j) for i, _, s, e in left for j, _, f, u in right if s < u and e > f)
    got = sorted((x.l, x.r) for x in point_join(a.drop("e"), b, ["k"], F.col("s"), (F.col("f"), F.col("u"))).collect())
    assert got == sorted((i, j) for i, _, s, _ in left for j, _, f, u in right if f <= s < u)


def test_temporal_joins_read_and_join_each_side_once(spark, tmp_path):
    """One join and one scan per input, and no row of a long interval per cell of time."""
    a = spark.createDataFrame([(1, 1, t(0), datetime(9999, 1, 1))], "a int, k int, s timestamp_ntz, e timestamp_ntz")
    b = spark.createDataFrame([(1, 1, t(0), t(9)), (2, 1, t(5), datetime(9999, 1, 1))], "b int, k int, f timestamp_ntz, u timestamp_ntz")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    joins = [
        overlap_join(a, b, ["k"], (F.col("s"), F.col("e")), (F.col("f"), F.col("u"))),
        point_join(a, b, ["k"], F.col("s"), (F.col("f"), F.col("u"))),
    ]
    for df in joins:
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Join ") == 1 and plan.count("FileScan") == 2
    everything = a.crossJoin(b).select(F.expr("1"))
    assert everything.count() == 2 and joins[0].count() == 2
