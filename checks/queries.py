"""The registered queries and their SQL counterparts.

The SQL takes another road than the operators wherever there is one: inequality
joins against the chunk grid instead of arithmetic, recursive state machines instead
of windows, all pairs plus ranking instead of ordered passes, one row per sample
instead of arrays.
"""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from checks.registry import CHECK_SECONDS, register
from checks.views import VIEWS, Inputs
from pulseweave import plans, vocab
from pulseweave.sources import codes as code_files, headers, sinks, tables as table_files
from pulseweave.session import shared_directory
from pulseweave.functions import clinical
from pulseweave.operators import chunks, codes, cohort as co, crosswalk, dataset
from pulseweave.operators import infusions, labs, ordered, recordings, signals


def quoted(items) -> str:
    return ", ".join("'" + i + "'" for i in items)


def sql_values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows
    )


def r6(name: str):
    return F.round(F.col(name), 6).alias(name)


# --------------------------------------------------------------------------
# SQL-only views: the oracle side of intermediate results
# --------------------------------------------------------------------------
SQL = {}

SQL["wave_meta"] = """
SELECT source_version, subject_id, hadm_id, record_id, fs, start_timestamp,
       start_timestamp + to_microseconds(CAST(round(record_len / fs * 1000000) AS BIGINT)) AS end_timestamp,
       round_even(record_len / fs / 3600, 1) AS record_hrs,
       round_even(total_samples / fs / 3600, 1) AS total_hrs,
       """ + ", ".join(
    f"round_even({s}_samples / fs / 3600, 1) AS {s}_hrs" if s in ("II", "PLETH", "ABP")
    else f"CAST(0 AS DOUBLE) AS {s}_hrs"
    for s in vocab.SIGNALS
) + """
FROM {wave_meta_raw}
"""


def overlap_sql(version: int) -> str:
    key = "m.subject_id = s.subject_id" + (" AND m.hadm_id = s.hadm_id" if version == 4 else "")
    source = "'metavision'" if version == 4 else "s.dbsource"
    return f"""
SELECT m.* EXCLUDE (hadm_id), s.hadm_id, s.stay_id, s.first_careunit, s.last_careunit,
       s.intime, s.outtime, s.los, {source} AS dbsource,
       (epoch_us(m.end_timestamp) - epoch_us(s.intime)) / 3600000000.0 AS hrs_overlap,
       (epoch_us(least(m.end_timestamp, s.outtime))
        - epoch_us(greatest(m.start_timestamp, s.intime))) / 3600000000.0 AS hrs_overlap_true
FROM {{wave_meta}} AS m JOIN {{icustays}} AS s
  ON {key} AND m.start_timestamp < s.outtime AND m.end_timestamp > s.intime
"""


SQL["overlap4"] = overlap_sql(4)
SQL["overlap3"] = overlap_sql(3)

_BIN = """CASE WHEN age <= 0 THEN NULL WHEN age <= 17 THEN '<18' WHEN age <= 25 THEN '18-25'
     WHEN age <= 35 THEN '26-35' WHEN age <= 45 THEN '36-45' WHEN age <= 55 THEN '46-55'
     WHEN age <= 65 THEN '56-65' WHEN age <= 75 THEN '66-75' WHEN age <= 85 THEN '76-85'
     WHEN age IS NOT NULL THEN '85>' END"""
_ETHNICITY = """CASE WHEN ethnicity ILIKE '%white%' THEN 'WHITE'
     WHEN ethnicity ILIKE '%black%' THEN 'BLACK/AFRICAN AMERICAN'
     WHEN ethnicity ILIKE '%hispanic%' THEN 'HISPANIC/LATINO'
     WHEN ethnicity ILIKE '%asian%' THEN 'ASIAN'
     WHEN ethnicity ILIKE '%unknown%' OR ethnicity ILIKE '%unable%' OR ethnicity ILIKE '%declined%'
     THEN 'UNKNOWN' ELSE 'OTHER' END"""

SQL["people4"] = f"""
SELECT *, {_BIN} AS age_group, {_ETHNICITY} AS ethnicity_group FROM (
  SELECT c.*, p.anchor_age, p.anchor_year, p.gender, a.admittime, a.dischtime, a.race AS ethnicity,
         CAST(p.anchor_age + year(a.admittime) - p.anchor_year AS INT) AS age
  FROM {{overlap4}} AS c JOIN {{patients}} AS p USING (subject_id)
  JOIN {{admissions}} AS a ON a.subject_id = c.subject_id AND a.hadm_id = c.hadm_id) AS t
"""
SQL["people3"] = f"""
SELECT *, {_BIN} AS age_group, {_ETHNICITY} AS ethnicity_group FROM (
  SELECT c.*, p.dob, p.gender, a.admittime, a.dischtime, a.ethnicity,
         CAST(year(a.admittime) - year(p.dob) AS INT) AS age
  FROM {{overlap3}} AS c JOIN {{patients}} AS p USING (subject_id)
  JOIN {{admissions_v3}} AS a ON a.subject_id = c.subject_id AND a.hadm_id = c.hadm_id) AS t
"""

SQL["weights4"] = """
SELECT stay_id, weight_kg FROM (
  SELECT c.stay_id, i.patientweight AS weight_kg,
         row_number() OVER (PARTITION BY c.stay_id ORDER BY
           abs(epoch_us(c.start_timestamp) - epoch_us(i.starttime)), i.starttime, i.inputevent_id) AS n
  FROM {inputevents} AS i JOIN {overlap4} AS c
    ON i.subject_id = c.subject_id AND i.hadm_id = c.hadm_id AND i.stay_id = c.stay_id
  WHERE i.patientweight >= 20 AND i.patientweight <= 500) AS t WHERE n = 1
"""
SQL["weights3"] = f"""
SELECT stay_id, weight_kg FROM (
  SELECT stay_id, weight_kg,
         row_number() OVER (PARTITION BY stay_id ORDER BY gap, charttime, row_id) AS n
  FROM (SELECT c.stay_id, e.charttime, e.row_id,
               abs(epoch_us(c.start_timestamp) - epoch_us(e.charttime)) AS gap,
               CASE WHEN d.label = 'Admission Weight (lbs.)' THEN e.valuenum * CAST(0.453592 AS DOUBLE)
                    ELSE e.valuenum END AS weight_kg
        FROM {{overlap3}} AS c JOIN {{chartevents}} AS e ON e.stay_id = c.stay_id
        JOIN {{d_items}} AS d ON d.itemid = e.itemid
        WHERE e.valuenum IS NOT NULL AND d.label IN ({quoted(vocab.WEIGHT_LABELS)})
          AND e.charttime IS NOT NULL) AS t
  WHERE weight_kg BETWEEN 20 AND 500) AS t WHERE n = 1
"""
SQL["cohort4"] = "SELECT p.*, w.weight_kg FROM {people4} AS p LEFT JOIN {weights4} AS w ON p.stay_id = w.stay_id"
SQL["cohort3"] = "SELECT p.*, w.weight_kg FROM {people3} AS p LEFT JOIN {weights3} AS w ON p.stay_id = w.stay_id"

def labs_sql(cohort: str) -> str:
    return f"""
SELECT l.labevent_id, l.subject_id, l.hadm_id, l.itemid, d.label, l.charttime, l.valuenum,
       l.valueuom, l.flag, c.record_id, c.start_timestamp, c.end_timestamp
FROM {{labevents}} AS l JOIN {{d_labitems}} AS d ON d.itemid = l.itemid
JOIN {{{cohort}}} AS c ON c.subject_id = l.subject_id AND c.hadm_id = l.hadm_id
WHERE d.label IN ({quoted(vocab.LAB_LABELS)})
  AND l.charttime + INTERVAL '2' HOUR >= c.start_timestamp AND l.charttime < c.end_timestamp
"""


SQL["labs4"] = labs_sql("cohort4")
SQL["labs3"] = labs_sql("cohort3")

SQL["drug_map"] = f"SELECT * FROM (VALUES {sql_values(vocab.DRUG_ROWS)}) AS t(label, drug, category)"
SQL["lab_map"] = f"SELECT * FROM (VALUES {sql_values(vocab.LAB_ROWS)}) AS t(label, feature)"
SQL["signal_names"] = (
    f"SELECT * FROM (VALUES {sql_values(vocab.SIGNAL_ROWS)}) AS t(raw_signal, signal, variant_rank)"
)

SQL["metavision"] = """
SELECT i.stay_id, i.itemid, d.label, i.starttime, i.endtime, i.rate, i.rateuom, i.amount,
       i.amountuom, i.ordercategorydescription, 'metavision' AS dbsource
FROM {inputevents} AS i JOIN {d_items} AS d ON d.itemid = i.itemid
"""

SQL["cv"] = """
SELECT e.*, d.label FROM (
  SELECT *, row_number() OVER (PARTITION BY stay_id, itemid, charttime, storetime, cgid, amount, rate
                               ORDER BY row_id) AS copy
  FROM {inputevents_cv_copies}
  WHERE stay_id IS NOT NULL AND itemid IS NOT NULL AND charttime IS NOT NULL) AS e JOIN {d_items} AS d ON d.itemid = e.itemid WHERE copy = 1
"""

# The drip state machine, one charting after the other
SQL["drip_rows"] = """
SELECT stay_id, itemid, label, charttime, rate, rateuom,
       coalesce(rate > 0, false) AS valid, coalesce(stopped = 'Stopped', false) AS stop,
       row_number() OVER (PARTITION BY stay_id, itemid ORDER BY charttime, storetime, cgid, row_id) AS n,
       count(*) OVER (PARTITION BY stay_id, itemid) AS total
FROM {cv} WHERE originalroute = 'IV Drip'
"""
SQL["drip_steps"] = """
SELECT stay_id, itemid, label, n, charttime,
       CASE WHEN valid THEN rate END AS open_rate, CASE WHEN valid THEN rateuom END AS open_uom,
       CASE WHEN valid THEN charttime END AS open_time,
       CAST(NULL AS DOUBLE) AS out_rate, CAST(NULL AS VARCHAR) AS out_uom, CAST(NULL AS TIMESTAMP) AS out_start
FROM {drip_rows} WHERE n = 1
UNION ALL
SELECT r.stay_id, r.itemid, r.label, r.n, r.charttime,
       CASE WHEN NOT r.valid THEN NULL WHEN s.open_rate IS NULL THEN r.rate
            WHEN NOT (r.stop OR r.n = r.total OR r.rate <> s.open_rate) THEN s.open_rate
            WHEN r.stop OR r.n = r.total THEN NULL ELSE r.rate END,
       CASE WHEN NOT r.valid THEN NULL WHEN s.open_rate IS NULL THEN r.rateuom
            WHEN NOT (r.stop OR r.n = r.total OR r.rate <> s.open_rate) THEN s.open_uom
            WHEN r.stop OR r.n = r.total THEN NULL ELSE r.rateuom END,
       CASE WHEN NOT r.valid THEN NULL WHEN s.open_rate IS NULL THEN r.charttime
            WHEN NOT (r.stop OR r.n = r.total OR r.rate <> s.open_rate) THEN s.open_time
            WHEN r.stop OR r.n = r.total THEN NULL ELSE r.charttime END,
       CASE WHEN s.open_rate IS NOT NULL AND (NOT r.valid OR r.stop OR r.n = r.total OR r.rate <> s.open_rate)
            THEN s.open_rate END,
       CASE WHEN s.open_rate IS NOT NULL AND (NOT r.valid OR r.stop OR r.n = r.total OR r.rate <> s.open_rate)
            THEN s.open_uom END,
       CASE WHEN s.open_rate IS NOT NULL AND (NOT r.valid OR r.stop OR r.n = r.total OR r.rate <> s.open_rate)
            THEN s.open_time END
FROM drip_steps AS s JOIN {drip_rows} AS r
  ON r.stay_id = s.stay_id AND r.itemid = s.itemid AND r.n = s.n + 1
"""
SQL["drips"] = """
SELECT stay_id, itemid, label, out_start AS starttime, charttime AS endtime, out_rate AS rate,
       out_uom AS rateuom, CAST(NULL AS DOUBLE) AS amount, CAST(NULL AS VARCHAR) AS amountuom,
       'Continuous Med' AS ordercategorydescription
FROM {drip_steps} WHERE out_start IS NOT NULL
"""

SQL["push_rows"] = f"""
SELECT * FROM (
  SELECT *, count(*) OVER (PARTITION BY stay_id, itemid) AS kept,
         row_number() OVER (PARTITION BY stay_id, itemid ORDER BY charttime, storetime, cgid, row_id) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY stay_id, itemid) AS every
        FROM {{cv}} WHERE originalroute = 'Intravenous Push' AND label IN ({quoted(vocab.DRUG_LABELS)})) AS t
  WHERE every >= 3 AND coalesce(amount, 0) > 0) AS t WHERE kept >= 3
"""
SQL["push_elapsed"] = """
SELECT a.*, CASE WHEN a.n > 1 THEN epoch_us(a.charttime) - epoch_us(p.charttime)
  WHEN epoch_us(b.charttime) - epoch_us(a.charttime) = epoch_us(c.charttime) - epoch_us(b.charttime)
  THEN epoch_us(b.charttime) - epoch_us(a.charttime)
  ELSE coalesce(epoch_us(a.charttime) - (SELECT max(epoch_us(o.charttime)) FROM {cv} AS o
         WHERE o.originalroute = 'Intravenous Push' AND o.stay_id = a.stay_id AND o.charttime < a.charttime),
       3600000000) END AS us
FROM {push_rows} AS a
LEFT JOIN {push_rows} AS p ON p.stay_id = a.stay_id AND p.itemid = a.itemid AND p.n = a.n - 1
LEFT JOIN {push_rows} AS b ON b.stay_id = a.stay_id AND b.itemid = a.itemid AND b.n = a.n + 1
LEFT JOIN {push_rows} AS c ON c.stay_id = a.stay_id AND c.itemid = a.itemid AND c.n = a.n + 2
"""
SQL["pushes"] = """
SELECT stay_id, itemid, label, charttime - to_microseconds(us) AS starttime,
       charttime AS endtime, amount / (us / 60000000.0::DOUBLE) AS rate, amountuom || '/min' AS rateuom,
       amount, amountuom, 'Continuous Med' AS ordercategorydescription
FROM {push_elapsed} WHERE us > 0
"""
SQL["inputs3"] = """
SELECT *, 'carevue' AS dbsource FROM {drips} UNION ALL BY NAME
SELECT *, 'carevue' AS dbsource FROM {pushes} UNION ALL BY NAME SELECT * FROM {metavision}
"""


def matched_inputs_sql(source: str, cohort: str) -> str:
    return f"""
SELECT i.*, c.record_id, c.start_timestamp, c.end_timestamp, c.weight_kg
FROM {{{source}}} AS i JOIN {{{cohort}}} AS c ON c.stay_id = i.stay_id
WHERE c.start_timestamp < i.endtime + INTERVAL '2' HOUR AND c.end_timestamp > i.starttime
  AND i.label IN ({quoted(vocab.DRUG_LABELS)})
"""


SQL["matched4"] = matched_inputs_sql("metavision", "cohort4")
SQL["matched3"] = matched_inputs_sql("inputs3", "cohort3")


def grid_sql(cohort: str, seconds: float) -> str:
    us = int(seconds * 1_000_000)
    return f"""
SELECT record_id, stay_id, subject_id, hadm_id, weight_kg, chunk_id,
       start_timestamp + to_microseconds(chunk_id * {us}) AS chunk_start,
       start_timestamp + to_microseconds((chunk_id + 1) * {us}) AS chunk_end
FROM (SELECT record_id, stay_id, subject_id, hadm_id, weight_kg, start_timestamp,
             unnest(generate_series(CAST(0 AS BIGINT), CAST(ceil(
               (epoch_us(end_timestamp) - epoch_us(start_timestamp)) / {us}.0) AS BIGINT) - 1)) AS chunk_id
      FROM {{{cohort}}}) AS t
"""


SQL["grid"] = grid_sql("cohort4", CHECK_SECONDS)

_NORM = """CASE WHEN rate IS NULL OR weight_kg IS NULL THEN NULL
  WHEN rateuom = 'mcg/kg/min' THEN rate WHEN rateuom = 'ng/kg/min' THEN rate / 1000
  WHEN rateuom = 'mg/kg/hour' THEN rate * 1000 / 60 WHEN rateuom = 'mcg/hour' THEN rate / weight_kg / 60
  WHEN rateuom = 'mg/hour' THEN rate * 1000 / weight_kg / 60 WHEN rateuom = 'mg/min' THEN rate * 1000 / weight_kg
  WHEN rateuom = 'units/hour' THEN rate / 60 ELSE rate END"""


def chunk_drugs_sql(grid: str, inputs: str) -> str:
    return f"""
SELECT record_id, stay_id, chunk_id, drug,
       max(CASE WHEN ordercategorydescription IN ('Continuous Med', 'Continuous IV') THEN norm END) AS ratenorm,
       max(CASE WHEN amount IS NOT NULL AND ordercategorydescription IN ('Bolus', 'Drug Push') THEN 1 ELSE 0 END) AS bolus,
       1 AS "on"
FROM (SELECT g.record_id, g.stay_id, g.chunk_id, d.drug, e.amount, e.ordercategorydescription,
             {_NORM.replace('rateuom', 'e.rateuom').replace('weight_kg', 'g.weight_kg').replace('rate ', 'e.rate ')} AS norm
      FROM {{{grid}}} AS g
      JOIN (SELECT DISTINCT stay_id, label, starttime, endtime, rate, rateuom, amount, ordercategorydescription
            FROM {{{inputs}}}) AS e
        ON e.stay_id = g.stay_id AND e.starttime < g.chunk_end AND e.endtime > g.chunk_start
      JOIN {{drug_map}} AS d ON d.label = e.label
      WHERE e.rate IS NOT NULL OR e.amount IS NOT NULL) AS t
GROUP BY record_id, stay_id, chunk_id, drug
"""


def chunk_labs_sql(grid: str, lab_table: str) -> str:
    return f"""
SELECT record_id, stay_id, chunk_id, feature, valuenum AS value FROM (
  SELECT g.record_id, g.stay_id, g.chunk_id, m.feature, l.valuenum,
         row_number() OVER (PARTITION BY g.record_id, g.stay_id, g.chunk_id, m.feature
                            ORDER BY l.charttime DESC, l.labevent_id DESC) AS n
  FROM {{{grid}}} AS g
  JOIN (SELECT DISTINCT labevent_id, subject_id, hadm_id, label, charttime, valuenum
        FROM {{{lab_table}}} WHERE valuenum IS NOT NULL) AS l
    ON l.subject_id = g.subject_id AND l.hadm_id = g.hadm_id
   AND l.charttime >= g.chunk_start AND l.charttime < g.chunk_end
  JOIN {{lab_map}} AS m ON m.label = l.label) AS t WHERE n = 1
"""


SQL["chunk_drugs"] = chunk_drugs_sql("grid", "matched4")
SQL["chunk_lab_values"] = chunk_labs_sql("grid", "labs4")


def event_features_sql(drugs: str, lab_values: str) -> str:
    nee = " + ".join(
        f"coalesce(max(CASE WHEN d.drug = '{d}' THEN ratenorm END), 0) * CAST({f} AS DOUBLE)"
        for d, f in vocab.NOREPI_FACTORS.items()
    )
    return f"""
SELECT record_id, stay_id, chunk_id, drug || '_ratenorm' AS feature, ratenorm AS value
FROM {{{drugs}}} WHERE ratenorm IS NOT NULL
UNION ALL SELECT record_id, stay_id, chunk_id, drug || '_bolus', 1 FROM {{{drugs}}} WHERE bolus = 1
UNION ALL SELECT record_id, stay_id, chunk_id, drug || '_on', 1 FROM {{{drugs}}}
UNION ALL SELECT DISTINCT d.record_id, d.stay_id, d.chunk_id, m.category || '_on', 1
  FROM {{{drugs}}} AS d JOIN (SELECT DISTINCT drug, category FROM {{drug_map}}) AS m ON m.drug = d.drug
UNION ALL SELECT DISTINCT d.record_id, d.stay_id, d.chunk_id, 'vasoactive_on', 1
  FROM {{{drugs}}} AS d JOIN (SELECT DISTINCT drug, category FROM {{drug_map}}) AS m ON m.drug = d.drug
  WHERE m.category IN ('vasopressor', 'vasodilator')
UNION ALL SELECT * FROM (SELECT record_id, stay_id, chunk_id, 'norepi_eq' AS feature, {nee} AS value
  FROM {{{drugs}}} AS d GROUP BY record_id, stay_id, chunk_id) AS n WHERE value <> 0
UNION ALL SELECT record_id, stay_id, chunk_id, feature, value FROM {{{lab_values}}}
"""


SQL["event_features"] = event_features_sql("chunk_drugs", "chunk_lab_values")
SQL["grid3"] = grid_sql("cohort3", CHECK_SECONDS)
SQL["chunk_drugs3"] = chunk_drugs_sql("grid3", "matched3")
SQL["chunk_lab_values3"] = chunk_labs_sql("grid3", "labs3")
SQL["event_features3"] = event_features_sql("chunk_drugs3", "chunk_lab_values3")


def wide_features_sql(grid: str, events: str) -> str:
    columns = []
    for name in vocab.feature_names():
        pick = f"max(CASE WHEN e.feature = '{name}' THEN e.value END)"
        if name in vocab.FLAG_FEATURES:
            columns.append(f"CAST(coalesce({pick}, 0) AS INT) AS {name}")
        elif name == "norepi_eq":
            columns.append(f"round(coalesce({pick}, 0), 6) AS {name}")
        else:
            columns.append(f"round({pick}, 6) AS {name}")
    return f"""
SELECT g.record_id, g.stay_id, g.chunk_id, g.chunk_start, {', '.join(columns)}
FROM {{{grid}}} AS g LEFT JOIN {{{events}}} AS e
  ON e.record_id = g.record_id AND e.stay_id = g.stay_id AND e.chunk_id = g.chunk_id
GROUP BY g.record_id, g.stay_id, g.chunk_id, g.chunk_start
"""


def code_rows_sql(diagnoses: str, cohort: str, titles: str) -> str:
    version = "AND t.icd_version = 10" if titles == "d_icd_diagnoses" else ""
    return f"""
SELECT subject_id, hadm_id, vers_code, x.icd_version, icd10_code, long_title, count(*) AS n_rows FROM (
  SELECT d.subject_id, d.hadm_id, d.icd_code AS vers_code, d.icd_version,
         CASE WHEN d.icd_version = 9 THEN g.i10 ELSE d.icd_code END AS icd10_code
  FROM {{{diagnoses}}} AS d
  JOIN {{{cohort}}} AS c ON c.subject_id = d.subject_id AND c.hadm_id = d.hadm_id
  LEFT JOIN {{gem9}} AS g ON d.icd_version = 9 AND g.i9 = d.icd_code) AS x
JOIN {{{titles}}} AS t ON t.icd_code = x.icd10_code {version}
WHERE x.icd10_code NOT LIKE 'Y%'
GROUP BY subject_id, hadm_id, vers_code, x.icd_version, icd10_code, long_title
"""


SQL["code_rows"] = code_rows_sql("diagnoses_icd", "cohort4", "d_icd_diagnoses")
SQL["code_rows3"] = code_rows_sql("diagnoses_icd_v3", "cohort3", "titles_v3")

# One row per sample after resampling and placing: stretch, position in the recording
SQL["placed"] = """
SELECT record_id, seg_idx, n_samples,
       CAST(coalesce(sum(n_samples) OVER (PARTITION BY record_id ORDER BY seg_idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sample_offset
FROM (SELECT record_id, seg_idx, CAST(floor(seg_len * 125.0::DOUBLE / fs) AS BIGINT) AS n_samples
      FROM {segment_headers} WHERE seg_idx > 0) AS t
"""
SQL["named"] = "SELECT s.*, m.signal FROM {segments} AS s JOIN {signal_names} AS m ON m.raw_signal = s.raw_signal"
SQL["samples125"] = """
SELECT record_id, seg_idx, signal, raw_signal, j,
       CASE WHEN pos = floor(pos) THEN CAST(samples[CAST(floor(pos) AS BIGINT) + 1] AS DOUBLE)
            ELSE CAST(CAST(samples[CAST(floor(pos) AS BIGINT) + 1] AS DOUBLE)
              + (CAST(samples[least(CAST(floor(pos) AS BIGINT) + 2, len(samples))] AS DOUBLE)
                 - CAST(samples[CAST(floor(pos) AS BIGINT) + 1] AS DOUBLE)) * (pos - floor(pos)) AS FLOAT) END AS value
FROM (SELECT *, j * fs / 125.0::DOUBLE AS pos FROM (
        SELECT *, unnest(generate_series(CAST(0 AS BIGINT),
                  CAST(floor(len(samples) * 125.0::DOUBLE / fs) AS BIGINT) - 1)) AS j
        FROM {named}) AS t) AS t
"""
SQL["record_signals"] = "SELECT DISTINCT record_id, signal FROM {named}"


def chunk_axis_sql(size: int) -> str:
    return f"""
SELECT record_id, signal, chunk_id FROM (
  SELECT record_id, unnest(generate_series(CAST(0 AS BIGINT),
         CAST(ceil(max(sample_offset + n_samples) / {size}.0) AS BIGINT) - 1)) AS chunk_id
  FROM {{placed}} GROUP BY record_id) AS t JOIN {{record_signals}} USING (record_id)
"""


def _register_sql_views() -> None:
    for name, text in SQL.items():
        VIEWS[name] = text


_register_sql_views()


# --------------------------------------------------------------------------
# Spark side helpers
# --------------------------------------------------------------------------
TABLES4 = ("icustays", "patients", "admissions", "d_items", "d_labitems", "labevents",
           "inputevents", "diagnoses_icd", "gem9", "d_icd_diagnoses")


def tables(i: Inputs, version: int = 4) -> dict[str, DataFrame]:
    t = i.tables(*TABLES4)
    t["wave_meta"] = recordings.format_meta(i["wave_meta_raw"])
    if version == 3:
        t["admissions"] = i["admissions_v3"]
        t["weight_events"] = weight_events(i)
        t["inputevents_cv"] = i["inputevents_cv_copies"]
        t["diagnoses_icd"] = i["diagnoses_icd_v3"]
        t["d_icd_diagnoses"] = i["titles_v3"]
    return t


def weight_events(i: Inputs) -> DataFrame:
    return co.scan_weight_events(i["chartevents"], "row_id")


def cohort(i: Inputs, version: int = 4) -> DataFrame:
    return plans.build_cohort(tables(i, version), version)


def overlap(i: Inputs, version: int = 4) -> DataFrame:
    t = tables(i)
    return co.match_stays(t["wave_meta"], t["icustays"], version)


def cv_rows(i: Inputs) -> DataFrame:
    rows = infusions.label_items(i["inputevents_cv_copies"], i["d_items"])
    return infusions.dedupe_first(ordered.placed(rows, infusions.GROUP, "charttime"))


def round_hours(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("hrs_overlap", "hrs_overlap_true")})


def rounded(names) -> str:
    return "* REPLACE (" + ", ".join(f"round({n}, 6) AS {n}" for n in names) + ")"


OVERLAP_HOURS = ("hrs_overlap", "hrs_overlap_true")


def long_samples(df: DataFrame, ids: list[str]) -> DataFrame:
    """One row per sample: position and value rounded to six digits."""
    return df.select(*ids, F.posexplode("samples").alias("pos", "v")).select(
        *ids, F.col("pos").cast("long").alias("pos"),
        F.round(F.col("v").cast("double"), 6).alias("value"),
    )


def long_dataset(df: DataFrame) -> DataFrame:
    """Scalars that stand for the arrays and the struct of a dataset row."""
    real = F.filter(F.flatten(F.map_values("signals")), lambda x: x.isNotNull())
    return df.select(
        "source_version", "subject_id", "hadm_id", "record_id", "stay_id", "chunk_id", "chunk_start",
        F.size(F.coalesce(F.map_keys("signals"), F.array())).alias("n_signals"),
        F.coalesce(F.size(real), F.lit(0)).alias("n_samples"),
        F.round(F.array_max(real).cast("double"), 6).alias("max_sample"),
        F.round(F.col("ehr.norepi_eq").cast("double"), 3).alias("norepi_eq"),
        F.col("ehr.vasoactive_on").alias("vasoactive_on"),
        F.round(F.col("ehr.sodium").cast("double"), 3).alias("sodium"),
    )


# --------------------------------------------------------------------------
# Recordings and cohort
# --------------------------------------------------------------------------
register("wave_meta", lambda i: recordings.format_meta(i["wave_meta_raw"]),
         ["wave_meta"], "SELECT * FROM wave_meta")

register(
    "filter_signal",
    lambda i: round_hours(recordings.filter_signal(overlap(i))),
    ["overlap4"],
    f"SELECT {rounded(OVERLAP_HOURS)} FROM overlap4 WHERE II_hrs >= 0.5 AND PLETH_hrs >= 0.5 AND ABP_hrs >= 0.5",
)
for _v in (4, 3):
    register(
        "cohort_overlap" if _v == 4 else "cohort_overlap_v3",
        lambda i, v=_v: round_hours(overlap(i, v)),
        [f"overlap{_v}"],
        f"SELECT {rounded(OVERLAP_HOURS)} FROM overlap{_v}",
    )
    register(
        "demographics" if _v == 4 else "demographics_v3",
        lambda i, v=_v: round_hours(
            co.add_demographics(
                overlap(i, v), i["patients"], i["admissions" if v == 4 else "admissions_v3"], v
            )
        ),
        [f"people{_v}"],
        f"SELECT {rounded(OVERLAP_HOURS)} FROM people{_v}",
    )
    register(
        "cohort" if _v == 4 else "cohort_v3",
        lambda i, v=_v: round_hours(cohort(i, v)).withColumn("weight_kg", F.round("weight_kg", 6)),
        [f"cohort{_v}"],
        f"SELECT {rounded((*OVERLAP_HOURS, 'weight_kg'))} FROM cohort{_v}",
    )

register(
    "scan_weight_events",
    lambda i: co.scan_weight_events(i["chartevents"]),
    ["chartevents"],
    "SELECT itemid, stay_id, charttime, value, valuenum, valueuom FROM chartevents "
    f"WHERE itemid IN ({', '.join(map(str, vocab.WEIGHT_ITEMIDS))})",
)
register(
    "weight_from_charts",
    lambda i: co.weights_from_charts(overlap(i, 3), weight_events(i), i["d_items"]).select(
        "stay_id", r6("weight_kg")
    ),
    ["weights3"], "SELECT stay_id, round(weight_kg, 6) AS weight_kg FROM weights3",
)
register(
    "weight_from_inputs",
    lambda i: co.weights_from_inputs(overlap(i), i["inputevents"]),
    ["weights4"], "SELECT stay_id, weight_kg FROM weights4",
)
register(
    "max_weight",
    lambda i: co.max_weight(overlap(i), i["inputevents"]),
    ["overlap4", "inputevents"],
    "SELECT i.stay_id, max(patientweight) AS weight_kg FROM inputevents AS i "
    "WHERE patientweight BETWEEN 20 AND 500 AND EXISTS (SELECT 1 FROM overlap4 AS c WHERE c.stay_id = i.stay_id) "
    "GROUP BY i.stay_id",
)

# --------------------------------------------------------------------------
# Labs
# --------------------------------------------------------------------------
register(
    "scan_labs",
    lambda i: labs.scan_labs(i["labevents"], i["d_labitems"], overlap(i)),
    ["labevents", "d_labitems", "overlap4"],
    "SELECT l.*, d.label FROM labevents AS l LEFT JOIN d_labitems AS d ON d.itemid = l.itemid "
    "WHERE l.hadm_id IN (SELECT hadm_id FROM overlap4)",
)
register(
    "cohort_labs",
    lambda i: plans.cohort_labs(tables(i), cohort(i)),
    ["labs4"], "SELECT * FROM labs4",
)
# The whole list never occurs on one recording of the test data; two labs do
COMPLETE = ("Potassium", "Sodium")
register(
    "complete_labs",
    lambda i: labs.complete_records(plans.cohort_labs(tables(i), cohort(i)), COMPLETE),
    ["labs4"],
    f"SELECT * FROM labs4 WHERE label IN ({quoted(COMPLETE)}) AND record_id IN ("
    "SELECT record_id FROM labs4 WHERE label = 'Potassium' AND valuenum IS NOT NULL INTERSECT "
    "SELECT record_id FROM labs4 WHERE label = 'Sodium' AND valuenum IS NOT NULL)",
)

# --------------------------------------------------------------------------
# Infusions
# --------------------------------------------------------------------------
register(
    "dedupe_first", cv_rows, ["cv"], "SELECT * EXCLUDE (copy) FROM cv",
)
register(
    "drip_intervals", lambda i: infusions.drip_intervals(cv_rows(i)), ["drips"],
    "SELECT * FROM drips",
)
register(
    "push_intervals",
    lambda i: infusions.push_intervals(cv_rows(i)).withColumn("rate", F.round("rate", 6)),
    ["pushes"], f"SELECT {rounded(['rate'])} FROM pushes",
)
register(
    "inputs_v4", lambda i: plans.load_inputs(tables(i), 4), ["metavision"],
    "SELECT * FROM metavision",
)
register(
    "inputs_v3",
    lambda i: plans.load_inputs(tables(i, 3), 3).withColumn("rate", F.round("rate", 6)),
    ["inputs3"], f"SELECT {rounded(['rate'])} FROM inputs3",
)
register(
    "cohort_inputs", lambda i: plans.cohort_inputs(tables(i), cohort(i)), ["matched4"],
    "SELECT * FROM matched4",
)
register(
    "cohort_inputs_v3",
    lambda i: plans.cohort_inputs(tables(i, 3), cohort(i, 3), 3).withColumns(
        {c: F.round(c, 6) for c in ("rate", "weight_kg")}
    ),
    ["matched3"], f"SELECT {rounded(['rate', 'weight_kg'])} FROM matched3",
)
register(
    "normalize_rate",
    lambda i: plans.cohort_inputs(tables(i), cohort(i))
    .join(vocab.drug_frame(i.spark), "label")
    .select(
        "stay_id", "record_id", "label", "drug", "category", "starttime", "rate", "rateuom",
        F.round(
            clinical.normalized_rate(F.col("rate"), F.col("rateuom"), F.col("weight_kg")), 6
        ).alias("rate_norm"),
    ),
    ["matched4", "drug_map"],
    f"SELECT stay_id, record_id, label, drug, category, starttime, rate, rateuom, round({_NORM}, 6) AS rate_norm "
    "FROM matched4 JOIN drug_map USING (label)",
)

# --------------------------------------------------------------------------
# Chunk features
# --------------------------------------------------------------------------


def feature_inputs(i: Inputs, version: int = 4):
    t = tables(i, version)
    c = cohort(i, version)
    return c, plans.cohort_inputs(t, c, version), plans.cohort_labs(t, c)


def latest_labs(i: Inputs) -> DataFrame:
    c = cohort(i)
    return chunks.chunk_labs(c, plans.cohort_labs(tables(i), c), CHECK_SECONDS)


register(
    "chunk_grid", lambda i: chunks.chunk_grid(cohort(i), CHECK_SECONDS), ["grid"],
    "SELECT record_id, stay_id, chunk_id, chunk_start FROM grid",
)
register(
    "chunk_meds",
    lambda i: chunks.chunk_infusions(*feature_inputs(i)[:2], CHECK_SECONDS).withColumn(
        "ratenorm", F.round("ratenorm", 6)
    ),
    ["chunk_drugs"], f"SELECT {rounded(['ratenorm'])} FROM chunk_drugs",
)
register(
    "chunk_labs",
    lambda i: latest_labs(i),
    ["chunk_lab_values"], "SELECT * FROM chunk_lab_values",
)
register(
    "norepi_eq",
    lambda i: chunks.chunk_features_long(*feature_inputs(i), CHECK_SECONDS)
    .where(F.col("feature").isin("norepi_eq", "vasoactive_on"))
    .withColumn("value", F.round("value", 6)),
    ["event_features"],
    f"SELECT {rounded(['value'])} FROM event_features WHERE feature IN ('norepi_eq', 'vasoactive_on')",
)
register(
    "chunk_features",
    lambda i: chunks.chunk_features_long(*feature_inputs(i), CHECK_SECONDS).withColumn(
        "value", F.round("value", 6)
    ),
    ["event_features"], f"SELECT {rounded(['value'])} FROM event_features",
)
register(
    "chunk_features_v3",
    lambda i: chunks.chunk_features_long(*feature_inputs(i, 3), CHECK_SECONDS).withColumn(
        "value", F.round("value", 6)
    ),
    ["event_features3"], f"SELECT {rounded(['value'])} FROM event_features3",
)
_DOUBLES = [n for n in vocab.feature_names() if n not in vocab.FLAG_FEATURES]
register(
    "chunk_features_wide",
    lambda i: chunks.chunk_features(*feature_inputs(i), CHECK_SECONDS).withColumns(
        {n: F.round(n, 6) for n in _DOUBLES}
    ),
    ["grid", "event_features"], wide_features_sql("grid", "event_features").replace("{", "").replace("}", ""),
)

# --------------------------------------------------------------------------
# Codes
# --------------------------------------------------------------------------
FORWARD = "SELECT DISTINCT c.code, g.i10 AS target, g.flag FROM code_list AS c LEFT JOIN gem9 AS g ON g.i9 = c.code"
FORWARD_ROWS = (
    "SELECT c.code, g.i10 AS target, g.flag FROM (SELECT DISTINCT code FROM code_list) AS c "
    "LEFT JOIN gem9 AS g ON g.i9 = c.code"
)
BACKWARD_ROWS = (
    "SELECT c.code, g.i9 AS target, g.flag FROM (SELECT DISTINCT code FROM code_list) AS c "
    "LEFT JOIN gem10 AS g ON g.i10 = c.code"
)
VIEWS["both_maps"] = (
    "SELECT i9 AS code, i10 AS target, flag FROM {gem9} "
    "UNION SELECT i10 AS code, i9 AS target, flag FROM {gem10}"
)
VIEWS["first_map"] = "SELECT m.* FROM {both_maps} AS m WHERE m.code IN (SELECT code FROM {start_codes})"
VIEWS["all_codes"] = """
SELECT code FROM {start_codes}
UNION SELECT i9 FROM {gem9} WHERE i10 IN (SELECT target FROM {first_map})
UNION SELECT i9 FROM {gem10} WHERE i10 IN (SELECT target FROM {first_map})
"""
register("icd_forward", lambda i: crosswalk.forward(i["code_list"], i["gem9"]),
         ["code_list", "gem9"], FORWARD_ROWS)
register("icd_backward", lambda i: crosswalk.backward(i["code_list"], i["gem10"]),
         ["code_list", "gem10"], BACKWARD_ROWS)
register(
    "icd_fwb", lambda i: crosswalk.forward_backward(i["code_list"], i["gem9"], i["gem10"]),
    ["code_list", "both_maps"],
    "SELECT c.code, m.target, m.flag FROM (SELECT DISTINCT code FROM code_list) AS c "
    "LEFT JOIN both_maps AS m ON m.code = c.code",
)
register(
    "icd_secondary", lambda i: crosswalk.secondary(i["start_codes"], i["gem9"], i["gem10"]),
    ["all_codes", "both_maps"],
    "SELECT c.code, m.target, m.flag FROM all_codes AS c LEFT JOIN both_maps AS m ON m.code = c.code",
)
register(
    "icd_secondary_codes",  # only what the closure adds, so that an empty closure is an empty result
    lambda i: crosswalk.secondary_codes(i["start_codes"], i["gem9"], i["gem10"])
    .join(i["start_codes"], "code", "left_anti"),
    ["all_codes", "start_codes"],
    "SELECT code FROM all_codes WHERE code NOT IN (SELECT code FROM start_codes)",
)
register(
    "icd_batch",
    lambda i: crosswalk.convert_batch(i["code_list"], "cm", {"cm": i["gem9"]}, by="file"),
    ["code_list", "gem9"],
    "SELECT c.file, c.code AS icd9, g.i10 AS icd10, g.flag FROM (SELECT DISTINCT file, code FROM code_list) AS c "
    "LEFT JOIN gem9 AS g ON g.i9 = c.code",
)
def batch_of_procedures(i: Inputs) -> DataFrame:
    """The procedure table, and a kind that is none, which adds no row."""
    known = {"cm": i["gem9"].where("false"), "pcs": i["gem10"]}
    convert = lambda kind: crosswalk.convert_batch(i["code_list"], kind, known, by="file")
    return convert("pcs").withColumn("kind", F.lit("pcs")).unionByName(convert("drg").withColumn("kind", F.lit("drg")))


register(
    "icd_batch_pcs", batch_of_procedures, ["code_list", "gem10"],
    "SELECT 'pcs' AS kind, c.file, c.code AS icd9, g.i10 AS icd10, g.flag FROM (SELECT DISTINCT file, code FROM code_list) AS c "
    "LEFT JOIN gem10 AS g ON g.i9 = c.code",
)
register(
    "icd_merge_maps",
    lambda i: crosswalk.merge_maps(
        crosswalk.forward(i["code_list"], i["gem9"]), crosswalk.backward(i["code_list"], i["gem10"])
    ),
    ["code_list", "both_maps"],
    "SELECT c.code, m.target, m.flag FROM (SELECT DISTINCT code FROM code_list) AS c "
    "LEFT JOIN both_maps AS m ON m.code = c.code",
)
register(
    "match_icd",
    lambda i: codes.repeat_rows(codes.match_codes(i["diagnoses_icd"], overlap(i))),
    ["diagnoses_icd", "overlap4"],
    "SELECT d.* FROM diagnoses_icd AS d JOIN overlap4 AS c ON c.subject_id = d.subject_id AND c.hadm_id = d.hadm_id",
)
register("cohort_codes", lambda i: plans.cohort_codes(tables(i), cohort(i)),
         ["code_rows"], "SELECT * FROM code_rows")
register("cohort_codes_v3", lambda i: plans.cohort_codes(tables(i, 3), cohort(i, 3)),
         ["code_rows3"], "SELECT * FROM code_rows3")
register(
    "codes_per_admission",
    lambda i: codes.codes_per_admission(plans.cohort_codes(tables(i), cohort(i))).select(
        "subject_id", "hadm_id", F.concat_ws("|", "codes").alias("codes"),
        F.aggregate("code_rows", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_rows"),
    ),
    ["code_rows"],
    "SELECT subject_id, hadm_id, string_agg(icd10_code, '|' ORDER BY icd10_code) AS codes, "
    "CAST(sum(n) AS BIGINT) AS n_rows FROM (SELECT subject_id, hadm_id, icd10_code, sum(n_rows) AS n "
    "FROM code_rows GROUP BY ALL) AS t GROUP BY subject_id, hadm_id",
)

# --------------------------------------------------------------------------
# Signals
# --------------------------------------------------------------------------


def _coverage_sql() -> str:
    per_signal = ", ".join(
        f"CAST(coalesce(sum(CASE WHEN signal = '{s}' THEN seg_len END), 0) AS BIGINT) AS {s}_samples"
        for s in vocab.SIGNALS
    )
    return f"""
SELECT r.*, r.record_len - coalesce(l.lost, 0) AS total_samples, c.* EXCLUDE (record_id)
FROM recordings AS r
JOIN (SELECT DISTINCT h.record_id FROM (SELECT record_id, unnest(signals) AS raw_signal FROM segment_headers
        WHERE seg_idx = 0) AS h JOIN signal_names USING (raw_signal)) AS u ON u.record_id = r.record_id
LEFT JOIN (SELECT record_id, CAST(sum(seg_len) AS BIGINT) AS lost FROM segment_headers
      WHERE seg_idx > 0 AND signals IS NULL GROUP BY record_id) AS l ON l.record_id = r.record_id
JOIN (SELECT record_id, {per_signal} FROM (
        SELECT record_id, seg_len, unnest(signals) AS raw_signal FROM segment_headers WHERE seg_idx > 0) AS t
      JOIN signal_names USING (raw_signal) GROUP BY record_id) AS c ON c.record_id = r.record_id
"""


register(
    "signal_coverage",
    lambda i: recordings.signal_coverage(i["recordings"], i["segment_headers"]),
    ["recordings", "segment_headers", "signal_names"], _coverage_sql(),
)
register(
    "signal_map",
    lambda i: signals.signal_map(i["segments"]).select(
        "record_id", F.concat_ws("|", "signals").alias("signals")
    ),
    ["record_signals"],
    "SELECT record_id, string_agg(signal, '|' ORDER BY signal) AS signals FROM record_signals GROUP BY record_id",
)
register(
    "signal_flags", lambda i: signals.signal_flags(signals.signal_map(i["segments"])),
    ["record_signals"],
    "SELECT record_id, " + ", ".join(
        f"max(CASE WHEN signal = '{s}' THEN 1 ELSE 0 END) AS has_{s}" for s in vocab.SIGNALS
    ) + " FROM record_signals GROUP BY record_id",
)
register(
    "path_keys",
    lambda i: i["wave_meta_raw"].select(
        "record_id", dataset.path_key("subject_id", "record_id", "waves").alias("path")
    ),
    ["wave_meta_raw"],
    "SELECT record_id, concat('waves/p', substring(CAST(subject_id AS VARCHAR), 1, 3), '/p', subject_id, '/', record_id) AS path "
    "FROM wave_meta_raw",
)
register(
    "align",
    lambda i: long_samples(signals.align(i["segments"]), ["record_id", "seg_idx", "signal"]),
    ["segments", "named", "record_signals"],
    "SELECT s.record_id, s.seg_idx, r.signal, p.pos, round(CAST(n.samples[p.pos + 1] AS DOUBLE), 6) AS value "
    "FROM (SELECT record_id, seg_idx, max(len(samples)) AS n FROM segments GROUP BY record_id, seg_idx) AS s "
    "JOIN record_signals AS r ON r.record_id = s.record_id "
    "LEFT JOIN named AS n ON n.record_id = s.record_id AND n.seg_idx = s.seg_idx AND n.signal = r.signal "
    "JOIN (SELECT unnest(generate_series(CAST(0 AS BIGINT), CAST(1000 AS BIGINT))) AS pos) AS p ON p.pos < s.n",
)
register(
    "resample",
    lambda i: long_samples(
        signals.resample(signals.name_signals(i["segments"])), ["record_id", "seg_idx", "signal"]
    ),
    ["samples125"],
    "SELECT record_id, seg_idx, signal, j AS pos, round(value, 6) AS value FROM samples125",
)
register(
    "segment_offsets",
    lambda i: signals.segment_offsets(i["segment_headers"], 125.0),
    ["placed"], "SELECT * FROM placed",
)
SIZE = 250  # two seconds at 125 Hz
VIEWS["axis250"] = chunk_axis_sql(SIZE)
RECHUNK_SQL = (
    "SELECT a.record_id, a.signal, a.chunk_id, p.pos, round(v.value, 6) AS value FROM axis250 AS a "
    f"JOIN (SELECT unnest(generate_series(CAST(0 AS BIGINT), CAST({SIZE - 1} AS BIGINT))) AS pos) AS p ON true "
    "LEFT JOIN (SELECT s.record_id, s.signal, s.value, o.sample_offset + s.j AS at FROM samples125 AS s "
    "JOIN placed AS o ON o.record_id = s.record_id AND o.seg_idx = s.seg_idx) AS v "
    f"ON v.record_id = a.record_id AND v.signal = a.signal AND v.at = a.chunk_id * {SIZE} + p.pos"
)
register(
    "rechunk",
    lambda i: long_samples(
        signals.by_signal(signals.chunk_signals(i["segments"], i["segment_headers"], 125.0, 2.0)),
        ["record_id", "signal", "chunk_id"],
    ),
    ["axis250", "samples125", "placed"], RECHUNK_SQL,
)
register(
    "pad",
    lambda i: long_samples(
        signals.pad(i["segments"].select("record_id", "seg_idx", "raw_signal", "samples"), 100),
        ["record_id", "seg_idx", "raw_signal"],
    ),
    ["segments"],
    "SELECT record_id, seg_idx, raw_signal, pos, round(CAST(samples[pos + 1] AS DOUBLE), 6) AS value FROM segments "
    "JOIN (SELECT unnest(generate_series(CAST(0 AS BIGINT), CAST(99 AS BIGINT))) AS pos) AS p ON true",
)
register(
    "nanmax",
    lambda i: signals.nan_max(i["segments"]).select(
        "record_id", "seg_idx", "raw_signal", F.round(F.col("value").cast("double"), 6).alias("value")
    ),
    ["segments"],
    "SELECT record_id, seg_idx, raw_signal, round(CAST(list_max(samples) AS DOUBLE), 6) AS value FROM segments",
)

# --------------------------------------------------------------------------
# Dataset
# --------------------------------------------------------------------------
DATASET_SECONDS = 10.0
VIEWS["cohort_sampled"] = "SELECT * FROM {cohort4} WHERE record_id IN (SELECT record_id FROM {record_signals})"
VIEWS["grid10"] = grid_sql("cohort_sampled", DATASET_SECONDS)
VIEWS["drugs10"] = chunk_drugs_sql("grid10", "matched4")
VIEWS["labs10"] = chunk_labs_sql("grid10", "labs4")
VIEWS["events10"] = event_features_sql("drugs10", "labs10")
VIEWS["axis1250"] = chunk_axis_sql(1250)
VIEWS["signal_chunks10"] = """
SELECT a.record_id, a.chunk_id, count(DISTINCT a.signal) AS n_signals, count(v.value) AS n_samples,
       max(v.value) AS max_sample
FROM {axis1250} AS a LEFT JOIN (
  SELECT s.record_id, s.signal, s.value, CAST(floor((o.sample_offset + s.j) / 1250) AS BIGINT) AS chunk_id
  FROM {samples125} AS s JOIN {placed} AS o ON o.record_id = s.record_id AND o.seg_idx = s.seg_idx) AS v
  ON v.record_id = a.record_id AND v.signal = a.signal AND v.chunk_id = a.chunk_id
GROUP BY a.record_id, a.chunk_id
"""


def whole_dataset(i: Inputs, seconds: float = DATASET_SECONDS) -> dict[str, DataFrame]:
    return plans.build_dataset(
        plans.preprocess(tables(i)), i["segments"], i["segment_headers"], 125.0, seconds
    )


DATASET_SQL = """
SELECT 4 AS source_version, g.subject_id, g.hadm_id, g.record_id, g.stay_id, g.chunk_id, g.chunk_start,
       CAST(coalesce(s.n_signals, 0) AS INT) AS n_signals, CAST(coalesce(s.n_samples, 0) AS INT) AS n_samples,
       round(s.max_sample, 6) AS max_sample,
       CASE WHEN s.record_id IS NOT NULL THEN round(CAST(CAST(coalesce(e.norepi_eq, 0) AS FLOAT) AS DOUBLE), 3) END AS norepi_eq,
       CASE WHEN s.record_id IS NOT NULL THEN CAST(coalesce(e.vasoactive_on, 0) AS INT) ELSE 0 END AS vasoactive_on,
       CASE WHEN s.record_id IS NOT NULL THEN round(CAST(CAST(e.sodium AS FLOAT) AS DOUBLE), 3) END AS sodium
FROM grid10 AS g
LEFT JOIN signal_chunks10 AS s ON s.record_id = g.record_id AND s.chunk_id = g.chunk_id
LEFT JOIN (SELECT record_id, stay_id, chunk_id,
                  max(CASE WHEN feature = 'norepi_eq' THEN value END) AS norepi_eq,
                  max(CASE WHEN feature = 'vasoactive_on' THEN value END) AS vasoactive_on,
                  max(CASE WHEN feature = 'sodium' THEN value END) AS sodium
           FROM events10 GROUP BY record_id, stay_id, chunk_id) AS e
  ON e.record_id = g.record_id AND e.stay_id = g.stay_id AND e.chunk_id = g.chunk_id
"""
register("chunk_dataset", lambda i: long_dataset(whole_dataset(i)["chunks"]),
         ["grid10", "events10", "signal_chunks10"], DATASET_SQL)


def dataset_features(i: Inputs) -> DataFrame:
    """All 214 features of the dataset's struct, where they are not what a chunk without events has."""
    def held(name: str) -> str:
        plain = f"AND ehr.{name} != 0" if name == "norepi_eq" or name in vocab.FLAG_FEATURES else ""
        value = f"round(CAST(ehr.{name} AS DOUBLE), 3)"
        return f"CASE WHEN ehr.{name} IS NOT NULL {plain} THEN struct('{name}' AS feature, {value} AS value) END"

    # One row per feature that is held; an unpivot makes 214 rows of every chunk first.
    entries = F.expr(f"array_compact(array({', '.join(map(held, vocab.feature_names()))}))")
    return whole_dataset(i)["chunks"].select("record_id", "stay_id", "chunk_id", F.inline(entries))


register(
    "dataset_features", dataset_features, ["events10", "signal_chunks10"],
    "SELECT e.record_id, e.stay_id, e.chunk_id, e.feature, round(CAST(CAST(e.value AS FLOAT) AS DOUBLE), 3) AS value "
    "FROM events10 AS e JOIN signal_chunks10 AS s ON s.record_id = e.record_id AND s.chunk_id = e.chunk_id",
)


def written_dataset(i: Inputs) -> DataFrame:
    """The whole dataset from its files, after some recordings were written twice."""
    path, chunks_ = fresh_path(i), whole_dataset(i)["chunks"]
    sinks.write_chunks(chunks_.withColumn("signals", F.lit(None).cast(chunks_.schema["signals"].dataType)), path)
    sinks.write_chunks(chunks_.where("record_id % 2 = 0"), path)
    sinks.write_chunks(chunks_.where("record_id % 2 = 1"), path)
    return long_dataset(i.spark.read.parquet(path).withColumn("record_id", F.col("record_id").cast("long")))


register("write_dataset", written_dataset, ["grid10", "events10", "signal_chunks10"], DATASET_SQL)


def flat_records(df: DataFrame) -> DataFrame:
    total = F.aggregate("code_rows", F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns({"codes": F.concat_ws("|", "codes"), "code_rows": total})


def records_sql(weight: str) -> str:
    flags = ", ".join(f"max(CASE WHEN signal = '{s}' THEN 1 ELSE 0 END) AS has_{s}" for s in vocab.SIGNALS)
    return f"""
SELECT c.source_version, c.subject_id, c.hadm_id, c.stay_id, c.record_id, c.age, c.age_group,
       c.ethnicity_group, c.gender, {weight} AS weight_kg, c.los, c.dbsource, f.* EXCLUDE (record_id),
       coalesce(k.codes, '') AS codes, coalesce(k.code_rows, 0) AS code_rows
FROM cohort_sampled AS c
JOIN (SELECT record_id, {flags} FROM record_signals GROUP BY record_id) AS f ON f.record_id = c.record_id
LEFT JOIN (SELECT subject_id, hadm_id, string_agg(DISTINCT icd10_code, '|' ORDER BY icd10_code) AS codes,
                  CAST(sum(n_rows) AS BIGINT) AS code_rows
           FROM code_rows GROUP BY subject_id, hadm_id) AS k
  ON k.subject_id = c.subject_id AND k.hadm_id = c.hadm_id
"""


register("static_records", lambda i: flat_records(whole_dataset(i)["records"]),
         ["cohort_sampled", "record_signals", "code_rows"], records_sql("c.weight_kg"))


def written_records(i: Inputs) -> DataFrame:
    """Static rows from their files, after the even recordings were written again."""
    path, records = fresh_path(i), whole_dataset(i)["records"]
    sinks.write_records(records.withColumn("weight_kg", F.lit(-1.0)), path)
    sinks.write_records(records.where("record_id % 2 = 0"), path)
    return flat_records(i.spark.read.parquet(path).drop("bucket"))


register("write_records", written_records, ["cohort_sampled", "record_signals", "code_rows"],
         records_sql("CASE WHEN c.record_id % 2 = 0 THEN c.weight_kg ELSE CAST(-1 AS DOUBLE) END"))


def summary(i: Inputs) -> DataFrame:
    d = plans.preprocess(tables(i))
    return dataset.run_summary(d["cohort"], d["labs"], d["inputs"], d["codes"])


register(
    "run_summary", summary, ["cohort4", "labs4", "matched4", "code_rows"],
    "SELECT 'total_records' AS metric, count(DISTINCT record_id) AS value FROM cohort4 "
    "UNION ALL SELECT 'records_with_labs', count(DISTINCT record_id) FROM labs4 "
    "UNION ALL SELECT 'records_with_inputs', count(DISTINCT record_id) FROM matched4 "
    "UNION ALL SELECT 'subjects_with_codes', count(DISTINCT subject_id) FROM code_rows",
)


# --------------------------------------------------------------------------
# Sources and sinks: written to the shared folder and read back
# --------------------------------------------------------------------------


def fresh_path(i: Inputs) -> str:
    return f"{shared_directory(i.spark)}/check-{uuid.uuid4().hex}"


def csv_labs(i: Inputs) -> DataFrame:
    root = fresh_path(i)
    lab = i["labevents"]
    upper = lab.toDF(*[c.upper() for c in lab.columns])
    upper.write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(
        f"{root}/hosp/LABEVENTS.csv.gz", header=True, compression="gzip"
    )
    return table_files.load_table(i.spark, root, "labevents", 4)


register("load_table", csv_labs, ["labevents"], "SELECT * FROM labevents")


def header_texts(i: Inputs, version: int = 4) -> DataFrame:
    """Header files of the recordings as path and text: master, layout, segments.

    In version 3 a directory holds all recordings of a subject, masters are named after the
    subject and the time, and each has a numerics recording beside it that is none.
    """
    layout = F.format_string("%d_%04d" if version == 4 else "%d_layout", *(
        ["record_id", "seg_idx"] if version == 4 else ["record_id"]))
    name = F.when(F.col("seg_name") == "~", "~").when(F.col("seg_idx") == 0, layout).otherwise(
        F.format_string("%d_%04d", "record_id", "seg_idx")
    )
    heads = i["segment_headers"].withColumn("seg_name", name)
    if version == 4:
        where = F.concat(dataset.path_key("subject_id", "record_id"), F.lit("/"))
        master_name = F.col("record_id").cast("string")
    else:
        padded = F.format_string("p%06d", "subject_id")
        where = F.concat(F.substring(padded, 1, 3), F.lit("/"), padded, F.lit("/"))
        master_name = F.concat(padded, F.lit("-2024-01-02-03-"), F.format_string("%02d", F.col("hadm_id") % 60))
    line = F.concat_ws(" ", "seg_name", F.col("seg_len").cast("string"))
    listed = heads.groupBy("record_id").agg(
        F.sort_array(F.collect_list(F.struct("seg_idx", line.alias("line")))).alias("l")
    )
    first = F.concat_ws(
        " ", F.concat(master_name, F.lit("/"), F.size("l").cast("string")), F.lit("4"),
        F.concat(F.col("fs").cast("string"), F.lit("/999.5")), F.col("record_len").cast("string"),
        F.date_format("start_timestamp", "HH:mm:ss.SSS dd/MM/yyyy"),
    )
    admission = [F.format_string("# hadm_id %d", "hadm_id")] if version == 4 else []
    joined = i["recordings"].join(listed, "record_id")
    master = joined.select(
        F.concat(where, master_name, F.lit(".hea")).alias("path"),
        F.concat_ws("\n", first, F.col("l.line"), *admission).alias("value"),
    )
    if version == 3:
        master = master.unionByName(joined.select(
            F.concat(where, master_name, F.lit("n.hea")).alias("path"),
            F.concat(master_name, F.lit("n/1 1 0.0166 4 03:04:05 02/01/2024\nx 4")).alias("value"),
        ))
    channel = F.transform("signals", lambda s: F.concat(F.lit("a.dat 516 200(0)/mV 14 0 1 2 0 "), s))
    parts = heads.where(F.col("signals").isNotNull()).join(
        i["recordings"].select("record_id", "subject_id"), "record_id"
    ).select(
        F.concat(where, F.col("seg_name"), F.lit(".hea")).alias("path"),
        F.concat_ws(
            "\n",
            F.format_string("%s %d %s %d", "seg_name", F.size("signals"),
                            F.col("fs").cast("string"), "seg_len"),
            channel,
        ).alias("value"),
    )
    return master.unionByName(parts)


def coverage_from_text(i: Inputs) -> DataFrame:
    texts = header_texts(i).withColumn("path", F.concat(F.lit("file:///waves/"), "path"))
    return recordings.signal_coverage(*headers.parse_catalogue(texts, 4))


register("header_coverage", coverage_from_text,
         ["recordings", "segment_headers", "signal_names"], _coverage_sql())


def put_files(i: Inputs, files: DataFrame) -> str:
    """Write each value under its own path; returns the folder, whose name and ``-list`` name the table of paths."""
    root = fresh_path(i)
    if "://" not in root and not root.startswith("file:"):
        root = f"file://{root}"

    def run(batches):
        fs, place = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs.create_dir(posixpath.dirname(f"{place}/{path}"), recursive=True)
                with fs.open_output_stream(f"{place}/{path}") as out:
                    out.write(value.encode())
            yield batch.select(["path"])

    files.select("path", "value").mapInArrow(run, "path string").write.parquet(f"{root}-list")
    return root


def catalogue_from_files(i: Inputs, version: int) -> DataFrame:
    """Version 4 by listing the folder, version 3 by the table of paths, with one that is missing."""
    root = put_files(i, header_texts(i, version))
    if version == 4:
        records, segments = headers.load_catalogue(i.spark, root, version)
    else:
        paths = i.spark.read.parquet(f"{root}-list").select(F.concat(F.lit(f"{root}/"), "path").alias("path"))
        missing = i.spark.createDataFrame([(f"{root}/p00/p000000/nowhere.hea",), (None,)], "path string")
        records, segments = headers.parse_catalogue(headers.read_listed(paths.unionByName(missing)), version)
    return recordings.signal_coverage(records, segments)


for _v in (4, 3):
    register(
        f"catalogue_v{_v}", lambda i, v=_v: catalogue_from_files(i, v),
        ["recordings", "segment_headers", "signal_names"],
        _coverage_sql() if _v == 4 else f"SELECT * EXCLUDE (hadm_id) REPLACE (3 AS source_version) FROM ({_coverage_sql()})",
    )


def crosswalk_file(i: Inputs) -> DataFrame:
    path = fresh_path(i)
    i["gem9"].select(F.concat_ws("   ", "i9", "i10", "flag")).write.text(path)
    return code_files.read_crosswalk(i.spark, path)


register("read_crosswalk", crosswalk_file, ["gem9"], "SELECT * FROM gem9")


def code_list_file(i: Inputs) -> DataFrame:
    """A file per list, each code on a line of its own with blanks around it, many twice."""
    line = F.concat(F.lit("  "), "code", F.lit(" \t"))
    files = i["code_list"].groupBy(F.col("file").alias("path")).agg(F.array_join(F.collect_list(line), "\n").alias("value"))
    return code_files.read_code_lists(i.spark, put_files(i, files))


register("read_code_lists", code_list_file, ["code_list"], "SELECT DISTINCT file, code FROM code_list")


def saved_inputs(i: Inputs) -> DataFrame:
    path = fresh_path(i)
    for version in (4, 3, 4):
        sinks.save_derived({"stays": overlap(i, version)}, path, version)
    return round_hours(i.spark.read.parquet(f"{path}/stays")).select(
        "source_version", "record_id", "stay_id", "dbsource", *OVERLAP_HOURS
    )


register(
    "save_derived", saved_inputs, ["overlap4", "overlap3"],
    " UNION ALL ".join(
        f"SELECT {v} AS source_version, record_id, stay_id, dbsource, round(hrs_overlap, 6) AS hrs_overlap, "
        f"round(hrs_overlap_true, 6) AS hrs_overlap_true FROM overlap{v}"
        for v in (4, 3)
    ),
)


def written_chunks(i: Inputs) -> DataFrame:
    path = fresh_path(i)
    sampled = signals.chunk_signals(i["segments"], i["segment_headers"], 125.0, 2.0)
    sinks.write_chunks(sampled.withColumn("stay_id", F.lit(0)), path)
    return long_samples(
        signals.by_signal(i.spark.read.parquet(path)), ["record_id", "signal", "chunk_id"]
    ).withColumn("record_id", F.col("record_id").cast("long"))


register("write_chunks", written_chunks, ["axis250", "samples125", "placed"],
         RECHUNK_SQL)


def indexed_inputs(i: Inputs) -> DataFrame:
    name = f"events_{uuid.uuid4().hex}"
    sinks.save_indexed(i["inputevents"], name, ["stay_id"], 8, fresh_path(i))
    return i.spark.table(name)


register("save_indexed", indexed_inputs, ["inputevents"], "SELECT * FROM inputevents")
