"""Clinical tables of both source generations in one canonical schema.

Version 3 files have upper-case columns, ``icustay_id`` and ``icd9_code``; version 4
has ``stay_id`` and versioned codes.  Reading lower-cases names, casts the columns
the library uses to declared types (identifiers long, codes always text, unreadable
values NULL, NaN to NULL) and renames the version-3 keys.
"""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.functions.clinical import not_nan
from pulseweave.operators.cohort import scan_weight_events
from pulseweave.operators.recordings import format_meta

# Canonical columns and types of each table
SCHEMAS = {
    "icustays": "subject_id long, hadm_id long, stay_id long, first_careunit string, "
    "last_careunit string, intime timestamp_ntz, outtime timestamp_ntz, los double, "
    "dbsource string",
    "patients": "subject_id long, gender string, dob timestamp_ntz, anchor_age int, "
    "anchor_year int",
    "admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, "
    "dischtime timestamp_ntz, ethnicity string, race string",
    "d_items": "itemid long, label string",
    "d_labitems": "itemid long, label string",
    "labevents": "labevent_id long, subject_id long, hadm_id long, itemid long, "
    "charttime timestamp_ntz, valuenum double, valueuom string, flag string",
    "inputevents": "subject_id long, hadm_id long, stay_id long, itemid long, "
    "starttime timestamp_ntz, endtime timestamp_ntz, rate double, rateuom string, "
    "amount double, amountuom string, ordercategorydescription string, "
    "patientweight double",
    "inputevents_cv": "row_id long, stay_id long, itemid long, cgid long, "
    "charttime timestamp_ntz, storetime timestamp_ntz, amount double, amountuom string, "
    "rate double, rateuom string, originalroute string, stopped string",
    "chartevents": "row_id long, itemid long, stay_id long, charttime timestamp_ntz, "
    "value string, valuenum double, valueuom string",
    "diagnoses_icd": "subject_id long, hadm_id long, icd_code string, icd_version int",
    "d_icd_diagnoses": "icd_code string, icd_version int, long_title string",
}

# Table name where it differs, and column renames, by version
_FILE_STEM = {(3, "inputevents"): "inputevents_mv"}
_RENAMES = {
    3: {"icustay_id": "stay_id", "icd9_code": "icd_code"},
    4: {},
}
_LAB_ID_V3 = {"row_id": "labevent_id"}
# Sub-directory of each table in version 4 (version 3 is flat)
_ICU_TABLES = ("icustays", "inputevents", "chartevents", "d_items")

_SUFFIXES = (".parquet", ".csv.gz", ".csv")


def _listing(spark: SparkSession, directory: str) -> list[str]:
    """Names in a directory of any file system Spark can read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        raise FileNotFoundError(f"no such directory: {directory}")
    return [status.getPath().getName() for status in fs.listStatus(path)]


def table_path(spark: SparkSession, root: str, name: str, version: int = 4) -> str:
    """Path of a table below ``root``, matching the file name in any case.

    Parquet is preferred to CSV: a compressed CSV file cannot be split.
    """
    sub = "" if version == 3 else ("icu" if name in _ICU_TABLES else "hosp")
    directory = posixpath.join(root, sub) if sub else root
    stem = _FILE_STEM.get((version, name), name)
    found = {n.lower(): n for n in _listing(spark, directory)}
    for suffix in _SUFFIXES:
        if stem + suffix in found:
            return posixpath.join(directory, found[stem + suffix])
    raise FileNotFoundError(f"table {name} (version {version}) not found in {directory}")


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or Parquet table with lower-case names; CSV columns stay text."""
    if path.endswith(".parquet"):
        return lower_columns(spark.read.parquet(path))
    return lower_columns(spark.read.csv(path, header=True, escape='"'))


def canonical(df: DataFrame, name: str, version: int = 4) -> DataFrame:
    """Project a raw table to the canonical columns it can provide."""
    renames = dict(_RENAMES[version])
    if name == "labevents" and version == 3:
        renames.update(_LAB_ID_V3)
    df = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    columns = []
    for part in SCHEMAS[name].split(", "):
        column, kind = part.split(" ")
        if column in df.columns:
            value = F.col(column).try_cast(kind)
            columns.append((not_nan(value) if kind == "double" else value).alias(column))
        elif column == "icd_version" and version == 3:
            columns.append(F.lit(9).alias(column))
    return df.select(*columns)


def load_table(spark: SparkSession, root: str, name: str, version: int = 4) -> DataFrame:
    """Resolve, read and canonicalise one table."""
    return canonical(read_raw(spark, table_path(spark, root, name, version)), name, version)


def load_catalogue_csv(spark: SparkSession, path: str, version: int = 4) -> DataFrame:
    """A saved recording catalogue (sample counts per signal) as formatted metadata.

    Column names keep their case: signal names have upper-case letters.
    """
    raw = spark.read.csv(path, header=True, escape='"')
    return format_meta(raw.withColumn("source_version", F.lit(version)))


def load_tables(spark: SparkSession, root: str, version: int = 4) -> dict[str, DataFrame]:
    """Every clinical table the pipelines of a version read.

    The recording catalogue and the crosswalk come from elsewhere, and so do the titles
    for version 3: they are those of a version-4 ``d_icd_diagnoses``.
    """
    names = ["icustays", "patients", "admissions", "d_items", "d_labitems", "labevents",
             "inputevents", "diagnoses_icd"]
    if version == 3:
        names += ["inputevents_cv", "chartevents"]
    else:
        names += ["d_icd_diagnoses"]
    tables = {n: load_table(spark, root, n, version) for n in names}
    if version == 3:
        tables["weight_events"] = scan_weight_events(tables.pop("chartevents"), "row_id")
    return tables
