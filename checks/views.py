"""Clinical-shaped views over the supplied test tables.

Each view is one SQL text that Spark and DuckDB both run, so a check compares the
operators and not two ways of making up inputs.  ``{name}`` refers to another view
or to a supplied table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("customer", "orders", "part", "events", "embeddings")

T0 = "TIMESTAMP '2024-01-01 00:00:00'"

VIEWS: dict[str, str] = {}

VIEWS["patients"] = """
SELECT c_custkey AS subject_id,
       CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CAST((7 * c_custkey) % 95 AS INT) AS anchor_age,
       CAST(2020 + c_custkey % 9 AS INT) AS anchor_year,
       TIMESTAMP '2024-06-15 00:00:00' - INTERVAL '1' YEAR * CAST((7 * c_custkey) % 95 AS INT) AS dob
FROM {customer}
"""

VIEWS["admissions"] = f"""
SELECT u.user_id AS subject_id,
       2 * u.user_id + k.k AS hadm_id,
       {T0} + INTERVAL '1' DAY * CAST(15 * k.k AS INT)
            + INTERVAL '1' HOUR * CAST(u.user_id % 24 AS INT) AS admittime,
       {T0} + INTERVAL '1' DAY * CAST(15 * k.k + 14 AS INT) AS dischtime,
       CASE WHEN c.c_custkey % 17 = 0 THEN NULL
            WHEN c.c_mktsegment = 'BUILDING' THEN 'WHITE - RUSSIAN'
            WHEN c.c_mktsegment = 'AUTOMOBILE' THEN 'Black/Cape Verdean'
            WHEN c.c_mktsegment = 'MACHINERY' THEN 'HISPANIC OR LATINO'
            WHEN c.c_mktsegment = 'HOUSEHOLD' AND c.c_custkey % 3 = 0 THEN 'CAUCASIAN'
            WHEN c.c_mktsegment = 'HOUSEHOLD' THEN 'ASIAN - CHINESE'
            WHEN c.c_custkey % 4 = 0 THEN 'PORTUGUESE'
            ELSE 'UNABLE TO OBTAIN' END AS race
FROM (SELECT DISTINCT user_id FROM {{events}}) AS u
JOIN {{customer}} AS c ON c.c_custkey = u.user_id
CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS k(k)
"""

VIEWS["admissions_v3"] = """
SELECT subject_id, hadm_id, admittime, dischtime, race AS ethnicity FROM {admissions}
"""

# Some stays and infusions never ended, as far as their tables know
VIEWS["icustays"] = """
SELECT a.subject_id, a.hadm_id, 10 * a.hadm_id + j.j AS stay_id,
       CASE WHEN a.hadm_id % 3 = 0 THEN 'MICU' ELSE 'SICU' END AS first_careunit,
       CASE WHEN a.hadm_id % 5 = 0 THEN 'MICU' ELSE 'CCU' END AS last_careunit,
       a.admittime + INTERVAL '1' DAY * CAST(6 * j.j AS INT) AS intime,
       CASE WHEN a.hadm_id % 41 = 7 AND j.j = 1 THEN TIMESTAMP '9999-12-31 00:00:00'
            ELSE a.admittime + INTERVAL '1' DAY * CAST(6 * j.j + 2 + a.subject_id % 4 AS INT) END AS outtime,
       CAST(2 + a.subject_id % 4 AS DOUBLE) AS los,
       CASE WHEN a.subject_id % 2 = 0 THEN 'carevue' ELSE 'metavision' END AS dbsource
FROM {admissions} AS a
CROSS JOIN (VALUES (CAST(0 AS BIGINT)), (CAST(1 AS BIGINT))) AS j(j)
"""

# 12 to 36 hours long, plus a few samples so that chunk counts round up
VIEWS["wave_meta_raw"] = """
SELECT 4 AS source_version, subject_id, hadm_id, 80000000 + hadm_id AS record_id,
       fs, CAST(fs * 3600 * hours AS BIGINT) + subject_id % 977 AS record_len,
       start_timestamp,
       CAST(fs * 3600 * hours AS BIGINT) + subject_id % 977 - 1000 * (hadm_id % 5) AS total_samples,
       CAST(fs * 3600 * hours AS BIGINT) - 700 * (hadm_id % 5) AS II_samples,
       CASE WHEN hadm_id % 7 = 0 THEN CAST(0 AS BIGINT)
            ELSE CAST(fs * 3600 * hours / 2 AS BIGINT) END AS PLETH_samples,
       CASE WHEN hadm_id % 4 = 0 THEN CAST(fs * 1600 AS BIGINT)
            ELSE CAST(fs * (1500 + 97 * (hadm_id % 50)) AS BIGINT) END AS ABP_samples
FROM (SELECT subject_id, hadm_id,
             CASE WHEN hadm_id % 2 = 0 THEN CAST(62.5 AS DOUBLE) ELSE CAST(125 AS DOUBLE) END AS fs,
             12 + 4 * (subject_id % 7) AS hours,
             admittime + INTERVAL '1' DAY * CAST(subject_id % 5 AS INT) + INTERVAL '3' HOUR AS start_timestamp
      FROM {admissions}) AS t
"""

VIEWS["d_items"] = """
SELECT CAST(itemid AS BIGINT) AS itemid, label FROM (VALUES
  (221000, 'Norepinephrine'), (221001, 'Epinephrine'), (221002, 'Dopamine'),
  (221003, 'Phenylephrine'), (221004, 'Vasopressin'), (221005, 'Angiotensin II (Giapreza)'),
  (221006, 'Milrinone'), (221007, 'Nitroglycerin'), (221008, 'Amiodarone'),
  (221009, 'Propofol'), (221010, 'Fentanyl (Concentrate)'), (221011, 'Midazolam (Versed)'),
  (221012, 'Cisatracurium'), (221013, 'Levophed'), (221014, 'Heparin Sodium'),
  (221015, 'Insulin - Regular'),
  (30000, 'Levophed-k'), (30001, 'Neosynephrine-k'), (30002, 'D5W'),
  (580, 'Previous WeightF'), (763, 'Daily Weight'), (226512, 'Admission Weight (Kg)'),
  (226531, 'Admission Weight (lbs.)'), (581, 'Previous Weight'), (3580, 'Present Weight (kg)')
) AS t(itemid, label)
"""

VIEWS["d_labitems"] = """
SELECT CAST(itemid AS BIGINT) AS itemid, label FROM (VALUES
  (50800, 'Hematocrit'), (50801, 'Platelet Count'), (50802, 'Creatinine'),
  (50803, 'Potassium'), (50804, 'Sodium'), (50805, 'Lactate'), (50806, 'pH'),
  (50807, 'Glucose'), (50808, 'Calcium, Total'), (50809, 'White Blood Cells'),
  (50810, 'Troponin T')
) AS t(itemid, label)
"""

VIEWS["labevents"] = """
SELECT event_id AS labevent_id, user_id AS subject_id,
       2 * user_id + CASE WHEN ts >= TIMESTAMP '2024-01-16 00:00:00' THEN 1 ELSE 0 END AS hadm_id,
       50800 + event_id % 12 AS itemid, ts AS charttime,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS valuenum,
       CASE WHEN event_id % 2 = 0 THEN 'mg/dL' ELSE 'mEq/L' END AS valueuom,
       CASE WHEN event_id % 9 = 0 THEN 'abnormal' END AS flag
FROM {events} WHERE event_type IN ('view', 'click', 'error')
"""

VIEWS["inputevents"] = """
SELECT e.event_id AS inputevent_id, s.subject_id, s.hadm_id, s.stay_id,
       221000 + e.event_id % 16 AS itemid,
       e.ts AS starttime,
       CASE WHEN e.event_id % 199 = 5 THEN TIMESTAMP '9999-12-31 00:00:00'
            ELSE e.ts + INTERVAL '1' MINUTE * CAST(e.event_id % 240 AS INT) END AS endtime,
       CASE WHEN e.event_id % 5 = 0 THEN NULL ELSE e.value / 10 END AS rate,
       CASE e.event_id % 8 WHEN 0 THEN 'mcg/kg/min' WHEN 1 THEN 'ng/kg/min'
            WHEN 2 THEN 'mg/kg/hour' WHEN 3 THEN 'mcg/hour' WHEN 4 THEN 'mg/hour'
            WHEN 5 THEN 'mg/min' WHEN 6 THEN 'units/hour' ELSE 'mL/hour' END AS rateuom,
       CASE WHEN e.event_id % 3 = 0 THEN NULL ELSE e.value END AS amount,
       'mg' AS amountuom,
       CASE (e.event_id + e.user_id) % 4 WHEN 0 THEN 'Continuous Med' WHEN 1 THEN 'Continuous IV'
            WHEN 2 THEN 'Bolus' ELSE 'Drug Push' END AS ordercategorydescription,
       CASE WHEN e.event_id % 13 = 0 THEN NULL
            ELSE CAST(15 + (37 * e.event_id) % 520 AS DOUBLE) END AS patientweight
FROM {events} AS e
JOIN {icustays} AS s
  ON s.subject_id = e.user_id AND e.ts >= s.intime AND e.ts < s.intime + INTERVAL '6' DAY
WHERE e.event_type IN ('purchase', 'signup')
"""

VIEWS["inputevents_cv"] = """
SELECT event_id AS row_id, 20 * user_id AS stay_id,
       CASE WHEN event_id % 17 = 0 THEN CAST(30002 AS BIGINT) ELSE 30000 + event_id % 2 END AS itemid,
       event_id % 5 AS cgid,
       CAST(date_trunc('minute', ts) AS TIMESTAMP) AS charttime,
       CAST(date_trunc('hour', ts) AS TIMESTAMP) AS storetime,
       CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS amount,
       'mg' AS amountuom,
       CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN CAST(0 AS DOUBLE)
            ELSE CAST(1 + event_id % 2 + CAST(floor(value / 20) AS BIGINT) % 2 AS DOUBLE) END AS rate,
       'mcg/kg/min' AS rateuom,
       CASE WHEN event_id % 3 = 2 THEN 'Intravenous Push' ELSE 'IV Drip' END AS originalroute,
       CASE WHEN event_id % 6 = 0 THEN 'Stopped' END AS stopped
FROM {events}
"""

# Whole duplicates and partial ones (another row id) of the same chartings, and rows
# that lack stay, item or time and so belong nowhere
VIEWS["inputevents_cv_copies"] = """
SELECT * FROM {inputevents_cv}
UNION ALL
SELECT row_id + 1000000000 AS row_id, stay_id, itemid, cgid, charttime, storetime, amount,
       amountuom, rate, rateuom, originalroute, 'Copied' AS stopped
FROM {inputevents_cv} WHERE row_id % 4 = 1
UNION ALL
SELECT row_id + 2000000000 AS row_id, CASE WHEN row_id % 3 <> 0 THEN stay_id END AS stay_id, itemid, cgid,
       CASE WHEN row_id % 3 <> 1 THEN charttime END AS charttime, storetime, amount,
       amountuom, rate, rateuom, originalroute, stopped
FROM {inputevents_cv} WHERE row_id % 5 = 2 AND row_id % 3 < 2
"""

VIEWS["chartevents"] = """
SELECT row_id, itemid, stay_id, charttime, value, valuenum, valueuom FROM {chartevents_placed}
UNION ALL
SELECT row_id + 1000000000 AS row_id, itemid, CASE WHEN row_id % 2 = 0 THEN stay_id END AS stay_id,
       CASE WHEN row_id % 2 = 1 THEN charttime END AS charttime, value, valuenum, valueuom
FROM {chartevents_placed} WHERE row_id % 6 < 2
"""

VIEWS["chartevents_placed"] = """
SELECT e.event_id AS row_id,
       CASE e.event_id % 8 WHEN 0 THEN CAST(580 AS BIGINT) WHEN 1 THEN CAST(763 AS BIGINT)
            WHEN 2 THEN CAST(226512 AS BIGINT) WHEN 3 THEN CAST(226531 AS BIGINT)
            WHEN 4 THEN CAST(581 AS BIGINT) WHEN 5 THEN CAST(3580 AS BIGINT)
            ELSE CAST(220045 AS BIGINT) END AS itemid,
       s.stay_id, e.ts AS charttime,
       CAST(15 + (37 * e.event_id) % 520 AS STRING) AS value,
       CASE WHEN e.event_id % 13 = 0 THEN NULL
            ELSE CAST(15 + (37 * e.event_id) % 520 AS DOUBLE) END AS valuenum,
       'kg' AS valueuom
FROM {events} AS e
JOIN {icustays} AS s
  ON s.subject_id = e.user_id AND e.ts >= s.intime AND e.ts < s.intime + INTERVAL '6' DAY
"""

VIEWS["diagnoses_icd"] = """
SELECT o_custkey AS subject_id, 2 * o_custkey + o_orderkey % 2 AS hadm_id,
       CASE WHEN o_orderkey % 3 = 0
            THEN concat(substring('ABCXY', CAST(o_orderkey % 5 + 1 AS INT), 1),
                        lpad(CAST(o_orderkey % 97 AS STRING), 3, '0'))
            ELSE lpad(CAST(o_orderkey % 200 AS STRING), 4, '0') END AS icd_code,
       CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 9 END AS icd_version
FROM {orders}
"""

VIEWS["gem9"] = """
SELECT lpad(CAST(p_partkey % 180 AS STRING), 4, '0') AS i9,
       concat(substring('ABCXY', CAST(p_size % 5 + 1 AS INT), 1),
              lpad(CAST(p_partkey % 97 AS STRING), 3, '0')) AS i10,
       lpad(CAST(100 * p_size AS STRING), 5, '0') AS flag
FROM {part}
"""

VIEWS["gem10"] = """
SELECT lpad(CAST((p_partkey + 13) % 180 AS STRING), 4, '0') AS i9,
       concat(substring('ABCXY', CAST(p_size % 5 + 1 AS INT), 1),
              lpad(CAST(p_partkey % 97 AS STRING), 3, '0')) AS i10,
       lpad(CAST(100 * p_size AS STRING), 5, '0') AS flag
FROM {part}
"""

VIEWS["d_icd_diagnoses"] = """
SELECT i10 AS icd_code, 10 AS icd_version, concat('Title ', i10) AS long_title
FROM (SELECT DISTINCT i10 FROM {gem9}) AS t WHERE CAST(substring(i10, 2, 3) AS INT) % 10 <> 7
UNION ALL
SELECT i10 AS icd_code, 9 AS icd_version, concat('Old title ', i10) AS long_title
FROM (SELECT DISTINCT i10 FROM {gem9}) AS t WHERE CAST(substring(i10, 2, 3) AS INT) % 10 = 3
"""

# The older generation: all codes of version 9, titles without a version
VIEWS["diagnoses_icd_v3"] = """
SELECT o_custkey AS subject_id, 2 * o_custkey + o_orderkey % 2 AS hadm_id,
       lpad(CAST(o_orderkey % 200 AS STRING), 4, '0') AS icd_code, 9 AS icd_version
FROM {orders}
"""

VIEWS["titles_v3"] = """
SELECT icd_code, long_title FROM {d_icd_diagnoses} WHERE icd_version = 10
"""

# Codes to convert: every recorded diagnosis code, of either version
VIEWS["code_list"] = """
SELECT icd_code AS code, CASE WHEN icd_version = 9 THEN 'old.txt' ELSE 'new.txt' END AS file
FROM {diagnoses_icd}
"""

# A start from which the crosswalk reaches codes that it does not hold: all of version 10,
# one decade of version 9
VIEWS["start_codes"] = """
SELECT DISTINCT code FROM {code_list} WHERE file = 'new.txt' OR substring(code, 1, 3) = '001'
"""

# Four channels per stretch of 64 samples; a gap follows every five stretches, and some
# channels carry a name that is no known signal
_FS = """CASE CAST(floor(vec_id / 100) AS BIGINT) % 3 WHEN 0 THEN CAST(62.5 AS DOUBLE)
            WHEN 1 THEN CAST(125 AS DOUBLE) ELSE CAST(50 AS DOUBLE) END AS fs"""
_STRETCH = "CAST(floor((vec_id % 100) / 4) AS INT)"
_RECORD = "80000000 + CAST(floor(vec_id / 100) AS BIGINT) AS record_id"

VIEWS["segments"] = f"""
SELECT {_RECORD}, {_STRETCH} + CAST(floor({_STRETCH} / 5) AS INT) + 1 AS seg_idx,
       CASE WHEN vec_id % 10 = 9 THEN 'Unknown lead' WHEN vec_id % 4 = 0 THEN 'II'
            WHEN vec_id % 4 = 1 THEN 'PLETH L' WHEN vec_id % 4 = 2 THEN 'ART' ELSE 'aVR' END AS raw_signal,
       {_FS}, embedding AS samples
FROM {{embeddings}}
"""

VIEWS["segment_headers"] = f"""
SELECT DISTINCT {_RECORD}, {_STRETCH} + CAST(floor({_STRETCH} / 5) AS INT) + 1 AS seg_idx,
       'seg' AS seg_name, CAST(64 AS BIGINT) AS seg_len, {_FS},
       CASE WHEN {_STRETCH} % 9 = 8 THEN NULL
            WHEN {_STRETCH} % 7 = 6 THEN ARR('Unknown lead')
            WHEN {_STRETCH} % 4 = 1 THEN ARR('II', 'ABP', 'ART')
            ELSE ARR('II', 'PLETH L', 'ART', 'aVR') END AS signals
FROM {{embeddings}}
UNION ALL
SELECT DISTINCT {_RECORD}, 6 * CAST(floor({_STRETCH} / 5) AS INT) + 6 AS seg_idx,
       '~' AS seg_name, 20 + vec_id % 100 - vec_id % 20 AS seg_len, {_FS}, NULL AS signals
FROM {{embeddings}}
UNION ALL
SELECT DISTINCT {_RECORD}, 0 AS seg_idx, 'layout' AS seg_name, CAST(0 AS BIGINT) AS seg_len, {_FS},
       CASE WHEN CAST(floor(vec_id / 100) AS BIGINT) % 5 = 4 THEN ARR('Unknown lead')
            ELSE ARR('II', 'PLETH L', 'ART', 'aVR') END AS signals
FROM {{embeddings}}
"""

VIEWS["recordings"] = """
SELECT 4 AS source_version, CAST(floor((record_id - 80000000) / 2) AS BIGINT) AS subject_id,
       record_id - 80000000 AS hadm_id, record_id, fs,
       CAST(sum(seg_len) AS BIGINT) AS record_len,
       TIMESTAMP '2024-01-02 03:04:05' AS start_timestamp
FROM {segment_headers} GROUP BY record_id, fs
"""

_REF = re.compile(r"\{(\w+)\}")


def _refs(name: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(VIEWS[name])))


def closure(names) -> list[str]:
    """The views needed for ``names``, each after the ones it reads."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in out:
            for r in _refs(n):
                visit(r)
            out.append(n)

    for n in names:
        visit(n)
    return out


class Inputs:
    """Lazily built Spark DataFrames for views and supplied tables of one directory."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory, self._made = spark, directory, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        text = re.sub(r"\bTIMESTAMP\b", "TIMESTAMP_NTZ", VIEWS[name]).replace("ARR(", "array(")
        return self.spark.sql(text, **{r: self[r] for r in _refs(name)})

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {n: self[n] for n in names}


def duckdb_with(names, body: str) -> str:
    """``body`` preceded by the views it needs, as DuckDB common table expressions."""
    parts = [
        f"{n} AS ({_REF.sub(lambda m: m.group(1), VIEWS[n]).replace('ARR(', 'list_value(').strip()})"
        for n in closure(names)
    ]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body.strip()
