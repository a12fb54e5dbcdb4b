"""Recording headers (text) to the tables the catalogue is built from.

A multi-segment recording has a master header naming its segments and their lengths
(``~`` for a gap), a layout header, and one header per segment naming its channels.
Files are read whole — each is a few hundred lines of text — and parsed with column
expressions; subject and directory come from the path.  What is parsed is written once and
serves both tables of the catalogue.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulseweave.session import materialize

# Patterns of the header format
_DIRECTORY = r"^(.*)/[^/]*$"
_FILE = r"([^/]+)\.hea$"
_SUBJECT = r"^.*/p(\d+)/"  # the innermost directory of that form
_HADM = r"(?m)^#.*hadm_id\D*(\d+)"


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, value — one row per header file below ``path``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True,
                            pathGlobFilter="*.hea")
    return files.select(F.col("_metadata.file_path").alias("path"), "value")


def read_listed(paths: DataFrame, column: str = "path") -> DataFrame:
    """path, value — the header files that a table names, such as the lists of recordings that
    archives publish.

    No directory is listed: the paths are spread over all tasks and each opens its own, so
    millions of small files need no listing on the driver.  A file that can't be read has
    a NULL value, which is a segment without a header.  Paths are URIs or local paths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, values = batch.column(0).to_pylist(), []
            for name in names:
                try:
                    fs, place = pafs.FileSystem.from_uri(name) if ":" in name else (pafs.LocalFileSystem(), name)
                    with fs.open_input_stream(place) as f:
                        values.append(f.read().decode("utf-8", "replace"))
                except (OSError, pa.ArrowInvalid):
                    values.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.string())], names=["path", "value"])

    listed = paths.select(F.col(column).cast("string").alias("path")).where("path is not null").distinct()
    return listed.mapInArrow(run, "path string, value string")


def split_headers(files: DataFrame) -> DataFrame:
    """directory, name, subject_id, hadm, lines of each header file that could be read."""
    where = F.col("path")
    lines = F.filter(
        F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)),
        lambda s: (s != "") & ~s.startswith("#"),
    )
    return files.where("value is not null").select(
        F.regexp_extract(where, _DIRECTORY, 1).alias("directory"),
        F.regexp_extract(where, _FILE, 1).alias("name"),
        F.regexp_extract(where, _SUBJECT, 1).try_cast("long").alias("subject_id"),
        F.regexp_extract("value", _HADM, 1).alias("hadm"),
        lines.alias("lines"),
    )


def _words(line: Column) -> Column:
    return F.split(line, r"\s+")


def _number(word: Column) -> Column:
    """Leading number of a field such as ``62.4725/999`` or ``125``."""
    return F.regexp_extract(word, r"^([0-9.]+)", 1).try_cast("double")


def master_headers(headers: DataFrame, version: int = 4) -> DataFrame:
    """One row per recording with its segment list.

    Master headers are those whose first word has a segment count (``name/count``).
    In version 3 a directory also holds numerics recordings: masters start with
    ``p`` and do not end in ``n``.
    """
    first = _words(F.get("lines", F.lit(0)))
    masters = headers.where(F.contains(F.get(first, F.lit(0)), F.lit("/")))
    if version == 3:
        masters = masters.where(F.col("name").rlike("^p.*[^n]$"))
    segments = F.transform(
        F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda s, i: F.struct(
            i.alias("seg_idx"),
            F.get(_words(s), F.lit(0)).alias("seg_name"),
            F.get(_words(s), F.lit(1)).try_cast("long").alias("seg_len"),
        ),
    )
    date = F.split(F.get(first, F.lit(5)), "/")
    iso = F.concat(
        F.get(date, F.lit(2)), F.lit("-"), F.get(date, F.lit(1)), F.lit("-"),
        F.get(date, F.lit(0)), F.lit(" "), F.get(first, F.lit(4)),
    )
    out = masters.select(
        "directory", "subject_id",
        F.col("hadm").try_cast("long").alias("hadm_id"),
        F.split(F.get(first, F.lit(0)), "/")[0].alias("record_name"),
        _number(F.get(first, F.lit(2))).alias("fs"),
        F.get(first, F.lit(3)).try_cast("long").alias("record_len"),
        iso.try_cast("timestamp_ntz").alias("start_timestamp"),
        segments.alias("segments"),
    )
    if version == 4:
        return out.withColumn("record_id", F.col("record_name").try_cast("long"))
    layout = F.get("segments", F.lit(0))["seg_name"]
    return out.drop("hadm_id").withColumn(
        "record_id", F.split(layout, "_")[0].try_cast("long")
    )


def segment_headers(headers: DataFrame, masters: DataFrame) -> DataFrame:
    """record_id, seg_idx, seg_name, seg_len, fs, signals for every listed segment.

    The channel is what follows the eighth field of a signal line.  Segments without
    a readable header keep NULL signals.
    """
    channels = F.transform(
        F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0))),
        lambda s: F.regexp_extract(s, r"^(?:\S+\s+){8}(.*)$", 1),
    )
    singles = headers.where(~F.contains(F.get(_words(F.get("lines", F.lit(0))), F.lit(0)), F.lit("/")))
    named = singles.select("directory", F.col("name").alias("seg_name"), channels.alias("signals"))
    listed = masters.select("directory", "record_id", "fs", F.explode("segments").alias("_s")).select(
        "directory", "record_id", "fs", "_s.*"
    )
    return listed.join(named, ["directory", "seg_name"], "left").select(
        "record_id", "seg_idx", "seg_name", "seg_len", "fs", "signals"
    )


def load_catalogue(spark: SparkSession, path: str, version: int = 4) -> tuple[DataFrame, DataFrame]:
    """(records, segment headers) of all recordings below ``path``."""
    return parse_catalogue(read_headers(spark, path), version)


def parse_catalogue(files: DataFrame, version: int = 4) -> tuple[DataFrame, DataFrame]:
    """(records, segment headers) from the texts of header files (path, value).

    The parsed lines are written once to the shared folder, then the masters.
    """
    headers = materialize(split_headers(files))
    masters = materialize(master_headers(headers, version))
    records = masters.select(
        F.lit(version).alias("source_version"),
        "subject_id",
        *(["hadm_id"] if version == 4 else []),
        "record_id", "fs", "record_len", "start_timestamp",
    )
    return records, segment_headers(headers, masters)
