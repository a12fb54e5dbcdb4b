import gzip
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseweave import plans, session, vocab
from pulseweave.operators import recordings
from pulseweave.sources import codes as code_files
from pulseweave.sources import headers, sinks, tables

T0 = datetime(2024, 1, 1)


def test_version_3_table(spark, tmp_path):
    with gzip.open(tmp_path / "ICUSTAYS.csv.gz", "wt") as f:
        f.write("ROW_ID,SUBJECT_ID,HADM_ID,ICUSTAY_ID,DBSOURCE,INTIME,OUTTIME,LOS\n")
        f.write("1,5,6,7,carevue,2101-10-20 19:08:00,,NaN\n2,5,x,8,metavision,bad,2101-10-21 00:00:00,1.5\n")
    with open(tmp_path / "DIAGNOSES_ICD.csv", "w") as f:
        f.write("ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE\n1,5,6,1,0010\n")
    stays = tables.load_table(spark, str(tmp_path), "icustays", 3).orderBy("stay_id").collect()
    assert stays[0].intime == datetime(2101, 10, 20, 19, 8) and stays[0].outtime is None
    assert stays[0].los is None and stays[1].hadm_id is None and stays[1].intime is None
    code = tables.load_table(spark, str(tmp_path), "diagnoses_icd", 3).first()
    assert (code.icd_code, code.icd_version) == ("0010", 9)
    with pytest.raises(FileNotFoundError, match="labevents"):
        tables.load_table(spark, str(tmp_path), "labevents", 3)
    with pytest.raises(FileNotFoundError, match="no such directory"):
        tables.load_table(spark, str(tmp_path), "labevents", 4)


def test_version_4_prefers_parquet(spark, tmp_path):
    (tmp_path / "hosp").mkdir()
    (tmp_path / "hosp" / "d_labitems.csv").write_text("itemid,label,fluid\n1,FromCsv,Blood\n")
    assert tables.load_table(spark, str(tmp_path), "d_labitems").first().label == "FromCsv"
    spark.createDataFrame([(1, 'Calcium, "Total"')], "ITEMID int, LABEL string").write.parquet(
        str(tmp_path / "hosp" / "D_LABITEMS.parquet"))
    got = tables.load_table(spark, str(tmp_path), "d_labitems")
    assert got.first().label == 'Calcium, "Total"' and dict(got.dtypes)["itemid"] == "bigint"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_headers_version_4(spark, tmp_path):
    d = tmp_path / "p100" / "p10014354" / "81739927"
    put(d / "81739927.hea",
        "81739927/4 3 62.4725/999.56 30 09:00:17.566 16/08/2148\n81739927_0000 0\n81739927_0001 10\n~ 5\n"
        "81739927_0002 15\n# subject_id 10014354\n# hadm_id 29600294\n")
    put(d / "81739927_0000.hea", "81739927_0000 2 62.4725 0\n~ 0 200/mV 0 0 0 0 0 II\n~ 0 200/mV 0 0 0 0 0 PLETH L\n")
    put(d / "81739927_0001.hea", "81739927_0001 2 62.4725 10\na.dat 516+0 200(0)/mV 14 0 1 2 0 II\n"
                                 "a.dat 516+1 200(0)/mV 14 0 1 2 0 PLETH L\n")
    records, segments = headers.load_catalogue(spark, str(tmp_path), 4)
    r = records.first()
    assert (r.subject_id, r.hadm_id, r.record_id, r.fs, r.record_len) == (10014354, 29600294, 81739927, 62.4725, 30)
    assert r.start_timestamp == datetime(2148, 8, 16, 9, 0, 17, 566000)
    got = [(s.seg_idx, s.seg_name, s.seg_len, s.signals) for s in segments.orderBy("seg_idx").collect()]
    assert got == [(0, "81739927_0000", 0, ["II", "PLETH L"]), (1, "81739927_0001", 10, ["II", "PLETH L"]),
                   (2, "~", 5, None), (3, "81739927_0002", 15, None)]
    c = recordings.signal_coverage(records, segments).first()
    assert (c.total_samples, c.II_samples, c.PLETH_samples, c.ABP_samples) == (10, 10, 10, 0)
    assert recordings.format_meta(recordings.signal_coverage(records, segments)).first().hadm_id == 29600294


def test_headers_version_3(spark, tmp_path):
    d = tmp_path / "p00" / "p000020"
    put(d / "p000020-2183-04-28-17-47.hea",
        "p000020-2183-04-28-17-47/2 1 125 20 17:47:55.000 28/04/2183\n3544749_layout 0\n3544749_0001 20\n")
    put(d / "p000020-2183-04-28-17-47n.hea", "p000020-2183-04-28-17-47n/1 1 0.0166 4 17:47:55 28/04/2183\nx 4\n")
    put(d / "3544749_layout.hea", "3544749_layout 1 125 0\n~ 0 1/mV 8 0 0 0 0 ABP\n")
    put(d / "3544749_0001.hea", "3544749_0001 1 125 20\na.dat 80 1/mV 8 0 0 0 0 ABP\n")
    records, segments = headers.load_catalogue(spark, str(tmp_path), 3)
    assert [(r.subject_id, r.record_id, r.fs) for r in records.collect()] == [(20, 3544749, 125.0)]
    assert recordings.signal_coverage(records, segments).first().ABP_samples == 20


def test_code_files(spark, tmp_path, rows):
    put(tmp_path / "gem.txt", "0010   A000    00000\n0011 A001 10000\nbad line\n")
    assert rows(code_files.read_crosswalk(spark, str(tmp_path / "gem.txt"))) == [
        ("0010", "A000", "00000"), ("0011", "A001", "10000")]
    put(tmp_path / "gem10.txt", "A000 0010 00000\n")
    assert rows(code_files.read_crosswalk(spark, str(tmp_path / "gem10.txt"), "i10")) == [("0010", "A000", "00000")]
    put(tmp_path / "lists" / "a.txt", " 0010\n0010 \n0011\t\n")
    put(tmp_path / "lists" / "sub" / "b.txt", "0010\n")
    assert rows(code_files.read_code_lists(spark, str(tmp_path / "lists"))) == [
        ("a.txt", "0010"), ("a.txt", "0011"), ("b.txt", "0010")]


def test_catalogue_csv(spark, tmp_path):
    put(tmp_path / "c.csv", "v,subject_id,hadm_id,record_id,fs,record_len,start_timestamp,total_samples,II_samples,AVF_samples\n"
        "4,5,6,7,62.5,225000,2148-08-16 09:00:17.566,112500,225000,112500\n")
    r = tables.load_catalogue_csv(spark, str(tmp_path / "c.csv"), 4).first()
    assert (r.source_version, r.record_id, r.record_hrs, r.total_hrs, r.II_hrs, r.AVF_hrs, r.ICP_hrs) == (
        4, 7, 1.0, 0.5, 1.0, 0.5, 0.0)
    assert r.end_timestamp == datetime(2148, 8, 16, 10, 0, 17, 566000)


def test_indexed_tables_join_without_shuffle(spark, tmp_path):
    for name in ("left_events", "right_events"):
        df = spark.range(100).select((F.col("id") % 7).alias("stay_id"), F.col("id").alias(name))
        sinks.save_indexed(df, name, ["stay_id"], 4, str(tmp_path / name))
    joined = spark.table("left_events").hint("merge").join(spark.table("right_events"), "stay_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == sum(len(range(k, 100, 7)) ** 2 for k in range(7))


def test_derived_tables_by_version(spark, tmp_path):
    for version, n in ((4, 3), (3, 2), (4, 5)):
        df = spark.range(n).withColumn("source_version", F.lit(version))
        sinks.save_derived({"labs": df}, str(tmp_path), version)
    got = spark.read.parquet(str(tmp_path / "labs")).groupBy("source_version").count().collect()
    assert {r.source_version: r["count"] for r in got} == {4: 5, 3: 2}


def test_chunks_are_replaced_by_record(spark, tmp_path):
    path = str(tmp_path / "chunks")
    def frame(rec, n, value):
        return spark.range(n).select(
            F.lit(rec).alias("record_id"), F.lit(1).alias("stay_id"), F.col("id").alias("chunk_id"), F.lit(value).alias("v"))
    sinks.write_chunks(frame(1, 9000, "old").union(frame(2, 3, "old")), path)
    sinks.write_chunks(frame(2, 4, "new"), path)
    got = {(r.record_id, r.v): r["count"] for r in spark.read.parquet(path).groupBy("record_id", "v").count().collect()}
    assert got == {(1, "old"): 9000, (2, "new"): 4}


def test_chunks_of_two_generations_share_a_path(spark, tmp_path):
    path = str(tmp_path / "chunks")
    frame = lambda v, x: spark.range(3).select(
        F.lit(v).alias("source_version"), F.lit(7).alias("record_id"), F.lit(1).alias("stay_id"), F.col("id").alias("chunk_id"), F.lit(x).alias("x"))
    for version, x in ((4, "old"), (3, "kept"), (4, "new")):
        sinks.write_chunks(frame(version, x), path)
    got = spark.read.parquet(path).groupBy("source_version", "x").count().collect()
    assert {(r.source_version, r.x): r["count"] for r in got} == {(4, "new"): 3, (3, "kept"): 3}


def t(h):
    return T0 + timedelta(hours=h)


def tiny_tables(spark):
    make = spark.createDataFrame
    return {
        "wave_meta": make([(4, 1, 2, 9, 125.0, t(10), t(10.05), 0.1, 0.1) + (0.1,) * 13],
            "source_version int, subject_id long, hadm_id long, record_id long, fs double, start_timestamp timestamp_ntz, "
            "end_timestamp timestamp_ntz, record_hrs double, total_hrs double, "
            + ", ".join(f"{s}_hrs double" for s in vocab.SIGNALS)),
        "icustays": make([(1, 2, 3, "M", "M", t(0), t(48), 2.0, "x")],
            "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, "
            "intime timestamp_ntz, outtime timestamp_ntz, los double, dbsource string"),
        "patients": make([(1, "F", 60, 2020)], "subject_id long, gender string, anchor_age int, anchor_year int"),
        "admissions": make([(1, 2, t(0), t(99), "WHITE")],
            "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, race string"),
        "d_items": make([(1, "Levophed")], "itemid long, label string"),
        "d_labitems": make([(1, "Sodium")], "itemid long, label string"),
        "labevents": make([(1, 1, 2, 1, t(10.01), 140.0, "u", None)],
            "labevent_id long, subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, valuenum double, "
            "valueuom string, flag string"),
        "inputevents": make([(1, 2, 3, 1, t(9), t(10.02), 0.4, "mcg/kg/min", 1.0, "mg", "Continuous Med", 70.0)],
            "subject_id long, hadm_id long, stay_id long, itemid long, starttime timestamp_ntz, endtime timestamp_ntz, "
            "rate double, rateuom string, amount double, amountuom string, ordercategorydescription string, patientweight double"),
        "diagnoses_icd": make([(1, 2, "001", 9), (1, 2, "B1", 10)], "subject_id long, hadm_id long, icd_code string, icd_version int"),
        "gem9": make([("001", "A1", "x")], "i9 string, i10 string, flag string"),
        "d_icd_diagnoses": make([("A1", 10, "a"), ("B1", 10, "b")], "icd_code string, icd_version int, long_title string"),
    }


def test_whole_dataset(spark, tmp_path):
    derived = plans.preprocess(tiny_tables(spark), 4)
    segs = spark.createDataFrame(
        [(9, 1, "II", 125.0, [float(i) for i in range(8000)]), (9, 1, "Pleth", 125.0, [1.0] * 8000)],
        "record_id long, seg_idx int, raw_signal string, fs double, samples array<float>")
    heads = spark.createDataFrame([(9, 1, "s", 8000, 125.0, ["II"])],
        "record_id long, seg_idx int, seg_name string, seg_len long, fs double, signals array<string>")
    built = plans.build_dataset(derived, segs, heads, 125.0, 60.0)
    plan = built["chunks"]._jdf.queryExecution().executedPlan().toString()
    join = [n for n, line in enumerate(plan.splitlines()) if "Join" in line][0]
    top = [line for line in plan.splitlines()[join:] if "Exchange hashpartitioning" in line][:1]
    # the join finds its inputs where the grouping has put them
    assert "REPARTITION_BY_NUM" in top[0]
    sinks.write_chunks(built["chunks"], str(tmp_path / "c"))
    sinks.write_records(built["records"], str(tmp_path / "r"))
    chunks = spark.read.parquet(str(tmp_path / "c")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in chunks] == [0, 1, 2]
    a, b, c = chunks
    assert a.signals["II"] == [float(i) for i in range(7500)]
    assert b.signals["II"][:501] == [float(i) for i in range(7500, 8000)] + [None] and len(b.signals["PLETH"]) == 7500
    assert (a.ehr.sodium, round(a.ehr.norepi_eq, 3), a.ehr.norepinephrine_on) == (140.0, 0.4, 1)
    assert c.signals is None and c.ehr.norepi_eq is None and c.ehr.vasoactive_on == 0
    assert len(a.ehr) == 214
    rec = spark.read.parquet(str(tmp_path / "r")).first()
    assert (list(rec.codes), rec.weight_kg, rec.age, rec.age_group, rec.has_PLETH, rec.has_ABP, rec.source_version) == (
        ["A1", "B1"], 70.0, 64, "56-65", 1, 0, 4)


def test_version_3_from_files_to_derived_tables(spark, tmp_path):
    def csv(name, header, *lines):
        put(tmp_path / f"{name}.csv", "\n".join([header, *lines]) + "\n")

    csv("ICUSTAYS", "ROW_ID,SUBJECT_ID,HADM_ID,ICUSTAY_ID,DBSOURCE,FIRST_CAREUNIT,LAST_CAREUNIT,INTIME,OUTTIME,LOS",
        "1,1,2,3,carevue,M,M,2024-01-01 00:00:00,2024-01-03 00:00:00,2")
    csv("PATIENTS", "ROW_ID,SUBJECT_ID,GENDER,DOB", "1,1,F,1964-05-05 00:00:00")
    csv("ADMISSIONS", "ROW_ID,SUBJECT_ID,HADM_ID,ADMITTIME,DISCHTIME,ETHNICITY",
        "1,1,2,2024-01-01 00:00:00,2024-01-09 00:00:00,WHITE")
    csv("D_ITEMS", "ROW_ID,ITEMID,LABEL", "1,30047,Levophed", "2,221906,Norepinephrine", "3,763,Daily Weight")
    csv("D_LABITEMS", "ROW_ID,ITEMID,LABEL", "1,50983,Sodium")
    csv("LABEVENTS", "ROW_ID,SUBJECT_ID,HADM_ID,ITEMID,CHARTTIME,VALUENUM,VALUEUOM,FLAG",
        "1,1,2,50983,2024-01-01 11:00:00,140,u,", "2,1,,50983,2024-01-01 11:00:00,150,u,")
    csv("INPUTEVENTS_MV", "ROW_ID,SUBJECT_ID,HADM_ID,ICUSTAY_ID,ITEMID,STARTTIME,ENDTIME,RATE,RATEUOM,AMOUNT,AMOUNTUOM,"
        "ORDERCATEGORYDESCRIPTION,PATIENTWEIGHT",
        "1,1,2,3,221906,2024-01-01 10:30:00,2024-01-01 11:30:00,0.2,mcg/kg/min,1,mg,Continuous Med,70")
    csv("INPUTEVENTS_CV", "ROW_ID,SUBJECT_ID,HADM_ID,ICUSTAY_ID,CHARTTIME,ITEMID,AMOUNT,AMOUNTUOM,RATE,RATEUOM,STORETIME,"
        "CGID,ORIGINALROUTE,STOPPED",
        "1,1,2,3,2024-01-01 10:00:00,30047,,,0.1,mcgkgmin,2024-01-01 10:00:00,7,IV Drip,",
        "2,1,2,3,2024-01-01 12:00:00,30047,,,0.1,mcgkgmin,2024-01-01 12:00:00,7,IV Drip,Stopped")
    csv("CHARTEVENTS", "ROW_ID,SUBJECT_ID,ICUSTAY_ID,ITEMID,CHARTTIME,VALUE,VALUENUM,VALUEUOM",
        "1,1,3,763,2024-01-01 09:00:00,81,81,kg", "2,1,3,220045,2024-01-01 10:00:00,99,99,bpm")
    csv("DIAGNOSES_ICD", "ROW_ID,SUBJECT_ID,HADM_ID,SEQ_NUM,ICD9_CODE", "1,1,2,1,001", "2,1,2,2,009")
    t3 = tables.load_tables(spark, str(tmp_path), 3)
    tiny = tiny_tables(spark)
    t3.update({n: tiny[n] for n in ("gem9", "d_icd_diagnoses")})
    t3["wave_meta"] = tiny["wave_meta"].withColumn("source_version", F.lit(3)).drop("hadm_id")
    got = plans.preprocess(t3, 3)
    c = got["cohort"].first()
    assert (c.stay_id, c.hadm_id, c.weight_kg, c.age, c.age_group, c.dbsource) == (3, 2, 81.0, 60, "56-65", "carevue")
    assert [r.valuenum for r in got["labs"].collect()] == []  # charted after the recording's end
    inputs = sorted((r.dbsource, r.label, r.rate, r.starttime, r.endtime) for r in got["inputs"].collect())
    # the metavision row starts after the recording's end
    assert inputs == [("carevue", "Levophed", 0.1, t(10), t(12))]
    assert [(r.vers_code, r.icd10_code, r.n_rows) for r in got["codes"].collect()] == [("001", "A1", 1)]


def test_registered_queries_have_sql():
    import __spark_entry__ as entry
    from checks.registry import ORACLES, QUERIES

    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_derived_tables_can_become_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "stay_id long, x double")
    for version in (3, 4):
        sinks.save_derived({"labs": df}, str(tmp_path), version)
    sinks.save_derived({"labs": df.where("false")}, str(tmp_path), 4)
    left = spark.read.parquet(str(tmp_path / "labs"))
    assert {r.source_version for r in left.collect()} == {3} and left.count() == 2


def test_records_are_replaced_one_by_one(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "record_id long, stay_id long, x string, source_version int")
    path = str(tmp_path / "records")
    sinks.write_records(rows((1, 1, "a", 4), (2, 1, "a", 4), (2, 2, "a", 3)), path)
    sinks.write_records(rows((2, 1, "b", 4)), path)
    got = sorted((r.record_id, r.stay_id, r.x, r.source_version) for r in spark.read.parquet(path).collect())
    assert got == [(1, 1, "a", 4), (2, 1, "b", 4), (2, 2, "a", 3)]


def test_records_take_a_file_per_bucket(spark, tmp_path):
    path = str(tmp_path / "records")
    all_of = lambda ids, x: spark.createDataFrame(
        [(r, s, x, 4) for r in ids for s in (1, 2)], "record_id long, stay_id long, x string, source_version int")
    files = lambda: sorted(f"{f.parent.name}/{f.name}" for f in (tmp_path / "records").rglob("*.parquet"))
    sinks.write_records(all_of(range(10_000), "a"), path, 16)
    before = files()
    assert len(before) <= 16
    sinks.write_records(all_of([5, 6, 20_000], "b"), path, 16)
    after = files()
    assert len(after) <= 16 and len(set(before) & set(after)) >= 13  # untouched buckets keep their files
    got = spark.read.parquet(path).groupBy("x").count().collect()
    assert {r.x: r["count"] for r in got} == {"a": 2 * 9_998, "b": 6}
    sinks.write_records(all_of([], "c"), path, 16)
    assert files() == after


def test_arrays_move_once_from_segments_to_files(spark, tmp_path):
    """Placed segments are shuffled once, by (recording, block); grouping, join and writer follow."""
    derived = plans.preprocess(tiny_tables(spark), 4)
    spark.createDataFrame([(9, 1, "II", 125.0, [1.0] * 80, 0)],
        "record_id long, seg_idx int, raw_signal string, fs double, samples array<float>, sample_offset long").write.parquet(f"{tmp_path}/s")
    heads = spark.createDataFrame([(9, 1, "s", 80, 125.0, ["II"])],
        "record_id long, seg_idx int, seg_name string, seg_len long, fs double, signals array<string>")
    built = plans.build_dataset(derived, spark.read.parquet(f"{tmp_path}/s"), heads, 125.0, 60.0)
    text = sinks.chunk_rows(built["chunks"])._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    text = text.split("Subqueries")[0]
    moved = [part.split("\n")[1] for part in text.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip()) and "Input" in part]
    carrying = [m for m in moved if any(f"{name}#" in m for name in ("samples", "part"))]
    assert len(carrying) == 1


def test_scratch_tables_go_with_their_block(spark):
    with session.scratch(spark):
        outer = session.materialize(spark.range(3))
        with session.scratch(spark):
            inner = session.materialize(outer.withColumn("x", F.lit(1)))
            kept = session.materialize(inner.where("id > 0"), keep=True)
        assert outer.count() == 3
    assert kept.count() == 2
    for gone in (inner, outer):
        with pytest.raises(Exception, match="FILE_NOT_EXIST|FAILED_READ_FILE"):
            gone.collect()
