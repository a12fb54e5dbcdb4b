"""Recording catalogue: coverage counts, formatted metadata, usable-signal filter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulseweave import vocab
from pulseweave.functions.timing import SECOND, plus_micros

GAP = "~"

ID_COLUMNS = ("subject_id", "hadm_id", "record_id")


def format_meta(raw: DataFrame, signals=vocab.SIGNALS) -> DataFrame:
    """Sample counts to hours (one decimal, half-even), typed ids, end of recording.

    Signals the catalogue has no ``{signal}_samples`` column for count as 0 hours; other
    ``_samples`` columns it has are converted too.
    """
    counted = [c.removesuffix("_samples") for c in raw.columns if c.endswith("_samples")]
    more = [s for s in counted if s not in signals and s != "total"]

    def hours(samples):
        return F.bround(samples / F.col("fs").cast("double") / 3600, 1)

    def signal_hours(s):
        name = f"{s}_samples"
        value = hours(F.col(name).cast("double")) if name in raw.columns else F.lit(0.0)
        return value.alias(f"{s}_hrs")

    ids = [F.col(c).try_cast("long").alias(c) for c in ID_COLUMNS if c in raw.columns]
    seconds = F.col("record_len").cast("double") / F.col("fs").cast("double")
    length = F.round(seconds * SECOND).cast("long")
    return raw.select(
        F.col("source_version").try_cast("int").alias("source_version"),
        *ids,
        F.col("fs").cast("double").alias("fs"),
        F.col("start_timestamp").try_cast("timestamp_ntz").alias("start_timestamp"),
        plus_micros(F.col("start_timestamp").try_cast("timestamp_ntz"), length).alias(
            "end_timestamp"
        ),
        hours(F.col("record_len").cast("double")).alias("record_hrs"),
        hours(F.col("total_samples").cast("double")).alias("total_hrs"),
        *[signal_hours(s) for s in (*signals, *more)],
    )


def filter_signal(
    cohort: DataFrame, signals=vocab.FINAL_SIGNALS, min_hours: float = vocab.MIN_SIGNAL_HOURS
) -> DataFrame:
    """Keep recordings that hold every listed signal for at least ``min_hours``."""
    enough = [F.col(f"{s}_hrs") >= min_hours for s in signals]
    return cohort.where(reduce(lambda a, b: a & b, enough, F.lit(True)))


def signal_coverage(records: DataFrame, headers: DataFrame) -> DataFrame:
    """Raw catalogue row per recording from its segment headers.

    ``records``: one row per recording (ids, fs, record_len, start_timestamp).
    ``headers``: record_id, seg_idx (0 is the layout), seg_name (``~`` is a gap),
    seg_len, signals (NULL or empty when the header is missing or names none).
    Recordings whose layout names no known signal are left out.

    Everything a recording needs is a sum over its segments, so one aggregation with
    map-side partial sums does it.  Known channels are counted in place, through a
    lookup map of fixed size; segments are not multiplied by their channels.
    """
    # Fixed-size literal map: raw channel name -> canonical signal
    lookup = F.create_map(
        *[F.lit(x) for raw, canon, _ in vocab.SIGNAL_ROWS for x in (raw, canon)]
    )
    known = F.filter(
        F.transform(F.coalesce("signals", F.array()), lambda s: F.try_element_at(lookup, s)),
        lambda s: s.isNotNull(),
    )
    body = F.col("seg_idx") > 0
    silent = F.size(F.coalesce("signals", F.array())) == 0
    lost = body & ((F.col("seg_name") == GAP) | silent)

    def samples(signal):
        channels = F.size(F.filter("_known", lambda s: s == signal))
        return F.coalesce(
            F.sum(F.when(body & (F.col("seg_name") != GAP), channels * F.col("seg_len"))),
            F.lit(0),
        ).alias(f"{signal}_samples")

    counts = (
        headers.withColumn("_known", known)
        .groupBy("record_id")
        .agg(
            F.max((~body & (F.size("_known") > 0)).cast("int")).alias("_usable"),
            F.coalesce(F.sum(F.when(lost, F.col("seg_len"))), F.lit(0)).alias("_lost"),
            *[samples(s) for s in vocab.SIGNALS],
        )
        .where(F.col("_usable") == 1)
    )
    return records.join(counts, "record_id").select(
        *records.columns,
        (F.col("record_len") - F.col("_lost")).alias("total_samples"),
        *[f"{s}_samples" for s in vocab.SIGNALS],
    )
