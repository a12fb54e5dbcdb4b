"""Recorded sample arrays: align, resample, re-chunk, pad.

``segments`` has one row per recorded stretch and channel: record_id, seg_idx,
raw_signal, fs, samples.  A NULL element is a missing sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave import vocab
from pulseweave.functions import arrays
from pulseweave.operators.chunks import block_of, by_block
from pulseweave.operators.ordered import running_total


def clean(segments: DataFrame) -> DataFrame:
    """NaN samples, as decoders give them, to missing samples; once, at ingest."""
    return segments.withColumn("samples", arrays.nan_to_null(F.col("samples")))


def name_signals(segments: DataFrame) -> DataFrame:
    """Add the canonical signal and the rank of the channel name; others drop out."""
    return segments.join(F.broadcast(vocab.signal_frame(segments.sparkSession)), "raw_signal")


def signal_map(channels: DataFrame) -> DataFrame:
    """record_id, signals — sorted canonical signals of each recording (at most 13).

    ``channels`` has record_id and raw_signal; sample arrays are not read.
    """
    return (
        name_signals(channels.select("record_id", "raw_signal"))
        .groupBy("record_id")
        .agg(F.sort_array(F.collect_set("signal")).alias("signals"))
    )


def signal_flags(signals: DataFrame) -> DataFrame:
    """record_id and has_{signal} (0/1) for each known signal."""
    return signals.select(
        "record_id",
        *[
            F.array_contains("signals", s).cast("int").alias(f"has_{s}")
            for s in vocab.SIGNALS
        ],
    )


def _blank():
    """True for an array without any real sample."""
    return ~F.exists("samples", lambda x: x.isNotNull())


#: More than any rank of a channel name.
_RANKS = 1000


def align(segments: DataFrame) -> DataFrame:
    """record_id, seg_idx, signal, fs, samples on the recording's own signal axis.

    Every stretch gets a row for every signal of its recording; what it did not
    record is missing samples.  Of several channel names of one signal, the first
    listed one with a real sample is taken.  A channel name is recorded once per stretch.

    The winners are chosen on keys alone, so no aggregate carries an array; the arrays
    move once, to meet the names that won.
    """
    lengths = segments.groupBy("record_id", "seg_idx").agg(
        F.max(F.size("samples")).alias("_n"), F.max("fs").alias("fs")
    )
    # Blankness and rank as one number, which a hash aggregate can hold.
    order = F.col("blank").cast("int") * _RANKS + F.col("variant_rank")
    names = F.broadcast(vocab.signal_frame(segments.sparkSession)).withColumnRenamed("variant_rank", "_rank")
    winners = (
        name_signals(segments.select("record_id", "seg_idx", "raw_signal", _blank().alias("blank")))
        .groupBy("record_id", "seg_idx", "signal")
        .agg((F.min(order) % _RANKS).alias("_rank"))
        .join(names, ["signal", "_rank"])
        .select("record_id", "seg_idx", "signal", "raw_signal")
    )
    axis = lengths.join(signal_map(segments), "record_id").select(
        "record_id", "seg_idx", "fs", "_n", F.explode("signals").alias("signal")
    )
    cells = axis.join(winners, ["record_id", "seg_idx", "signal"], "left")
    columns = ["record_id", "seg_idx", "signal", "fs", "samples"]
    found = cells.where(F.col("raw_signal").isNotNull()).join(
        segments.select("record_id", "seg_idx", "raw_signal", "samples"), ["record_id", "seg_idx", "raw_signal"]
    )
    missing = cells.where(F.col("raw_signal").isNull()).withColumn("samples", arrays.nulls(F.col("_n")))
    return found.select(*columns).unionByName(missing.select(*columns))


def resample(segments: DataFrame, target_fs: float = vocab.TARGET_FS) -> DataFrame:
    """Bring every array to ``target_fs`` by linear interpolation."""
    moved = arrays.resample(F.col("samples"), F.col("fs"), target_fs)
    # Two steps: inside a lambda, a new ``fs`` in the same projection would win.
    return segments.withColumn("samples", moved).withColumn("fs", F.lit(float(target_fs)))


def _stretch_lengths(headers: DataFrame, target_fs: float | None) -> DataFrame:
    n = F.col("seg_len").cast("long")
    if target_fs is not None:
        n = arrays.resampled_size(n, F.col("fs"), target_fs)
    return headers.where(F.col("seg_idx") > 0).select(
        "record_id", "seg_idx", n.alias("n_samples")
    )


def segment_offsets(headers: DataFrame, target_fs: float | None = None) -> DataFrame:
    """record_id, seg_idx, n_samples, sample_offset of each stretch in its recording.

    ``headers``: record_id, seg_idx, seg_len, fs; gaps count like any stretch.  With
    ``target_fs`` lengths are those after resampling.
    """
    lengths = _stretch_lengths(headers, target_fs)
    return running_total(lengths, "record_id", "seg_idx", "n_samples", "sample_offset")


def _pieces(segments: DataFrame, size: int) -> DataFrame:
    """record_id, chunk_id, part — each array cut at the chunk borders.

    Only the slices leave the row.
    """
    off, n, width = F.col("sample_offset"), F.size("samples"), F.lit(size).cast("long")
    first = F.call_function("div", off, width)
    last = F.call_function("div", off + n - 1, width)

    def cut(c):
        start = F.greatest(c * width, off)
        stop = F.least((c + 1) * width, off + n)
        piece = F.slice("samples", (start - off + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(
            c.alias("chunk_id"),
            F.struct(
                F.col("signal").alias("signal"),
                (start - c * width).cast("int").alias("start"),
                F.col("_blank").alias("blank"),
                F.col("variant_rank").alias("rank"),
                piece.alias("piece"),
            ).alias("part"),
        )

    # Guarded in place: a filter on the size would compute the samples twice.
    cuts = F.when(n > 0, F.transform(F.sequence(first, last), cut))
    return (
        segments.withColumn("_blank", _blank())
        .select("record_id", F.explode(cuts).alias("_c"))
        .select("record_id", "_c.chunk_id", "_c.part")
    )


def rechunk(segments: DataFrame, size: int, axis: DataFrame | None = None) -> DataFrame:
    """record_id, block, chunk_id, signals — a map of arrays of exactly ``size`` samples.

    ``segments``: record_id, signal, variant_rank, sample_offset, samples, at the
    final sampling rate.  Stretches are cut at chunk borders and only the pieces
    travel, once, by (record, block of chunks), which is also how they are joined and
    written: ``block`` is kept for that.  They are grouped by chunk, which holds at most 13
    signals of ``size`` samples, so no group grows with its recording.  What no piece
    covers, between pieces and at the end, is missing samples; what several cover is taken
    from the one that starts first.  ``axis`` (record_id, chunk_id, axis) names chunks, and
    the signals they have, although nothing may cover them.
    """
    parts = _pieces(segments, size)
    if axis is None:
        parts = parts.withColumn("axis", F.lit(None).cast("array<string>"))
    else:
        parts = parts.unionByName(axis, allowMissingColumns=True)
    # Sorted by signal, start, blankness, rank: of copies the better one comes first.
    def padded(p, i):
        # Where the earlier parts of the signal end: only what lies beyond is new.
        earlier = F.filter("_p", lambda q, j: (j < i) & (q["signal"] == p["signal"]))
        end = F.coalesce(F.array_max(F.transform(earlier, lambda q: q["start"] + F.size(q["piece"]))), F.lit(0))
        seen = F.greatest(end - p["start"], F.lit(0))
        new = F.slice(p["piece"], seen + 1, F.greatest(F.size(p["piece"]) - seen, F.lit(0)))
        return F.struct(
            p["signal"].alias("signal"),
            F.concat(arrays.nulls(F.greatest(p["start"] - end, F.lit(0))), new).alias("run"),
        )

    def whole(s):
        runs = F.filter("_q", lambda q: q["signal"] == s)
        joined = F.flatten(F.transform(runs, lambda q: q["run"]))
        return F.struct(s.alias("signal"), arrays.pad(joined, size).alias("samples"))

    names = F.array_union(
        F.coalesce("axis", F.expr("CAST(array() AS array<string>)")),
        F.transform("_p", lambda p: p["signal"]),
    )
    return (
        by_block(parts.withColumn("block", block_of("chunk_id")))
        .groupBy("record_id", "block", "chunk_id")
        .agg(F.sort_array(F.collect_set("part")).alias("_p"), F.max("axis").alias("axis"))
        .withColumn("_q", F.transform("_p", padded))
        .select(
            "record_id",
            "block",
            "chunk_id",
            F.map_from_entries(F.transform(names, whole)).alias("signals"),
        )
    )


def placed_signals(
    segments: DataFrame,
    headers: DataFrame,
    target_fs: float = vocab.TARGET_FS,
    seconds: float = vocab.CHUNK_SECONDS,
) -> DataFrame:
    """record_id, block, chunk_id, signals for every chunk of a recording, placed by (recording, block).

    The map has every signal of the recording.  Segments that carry ``sample_offset``
    (in samples at ``target_fs``) are taken as placed and their arrays are shuffled
    once; otherwise the offsets are computed from ``headers`` (record_id, seg_idx,
    seg_len, fs) and joined to them first.
    """
    size = int(seconds * target_fs)
    placed = segments
    if "sample_offset" not in segments.columns:
        offsets = segment_offsets(headers, target_fs).drop("n_samples")
        placed = segments.join(offsets, ["record_id", "seg_idx"])
    chunks = F.expr(f"(sum(n_samples) + {size - 1}) div {size}")
    lengths = _stretch_lengths(headers, target_fs)
    extent = lengths.groupBy("record_id").agg(chunks.alias("_n")).where(F.col("_n") > 0)
    axis = extent.join(signal_map(segments), "record_id").select(
        "record_id",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("chunk_id"),
        F.col("signals").alias("axis"),
    )
    named = name_signals(resample(placed, target_fs))
    return rechunk(named, size, axis)


def chunk_signals(
    segments: DataFrame,
    headers: DataFrame,
    target_fs: float = vocab.TARGET_FS,
    seconds: float = vocab.CHUNK_SECONDS,
) -> DataFrame:
    """record_id, chunk_id, signals, as :func:`placed_signals`."""
    return placed_signals(segments, headers, target_fs, seconds).drop("block")


def by_signal(chunks: DataFrame) -> DataFrame:
    """record_id, chunk_id, signal, samples — one row per signal of a chunk."""
    return chunks.select("record_id", "chunk_id", F.explode("signals").alias("signal", "samples"))


def nan_max(segments: DataFrame) -> DataFrame:
    """Replace each array by its largest real value (NULL when there is none)."""
    return segments.withColumn("value", arrays.nan_max(F.col("samples"))).drop("samples")


def pad(segments: DataFrame, size: int) -> DataFrame:
    """Right-pad each array with missing samples to ``size``."""
    return segments.withColumn("samples", arrays.pad(F.col("samples"), size))
