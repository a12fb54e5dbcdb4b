import random

import pytest
from pyspark.sql import functions as F

from pulseweave import vocab
from pulseweave.functions import arrays
from pulseweave.operators import dataset, recordings, signals

SEG = "record_id long, seg_idx int, raw_signal string, fs double, samples array<float>"
HEAD = "record_id long, seg_idx int, seg_name string, seg_len long, fs double, signals array<string>"


def test_align(spark):
    segs = spark.createDataFrame(
        [(1, 1, "ART", 1.0, [1.0, 2.0]), (1, 1, "ABP", 1.0, [None, None]), (1, 2, "II", 1.0, [3.0]),
         (1, 3, "Other", 1.0, [9.0, 9.0, 9.0]), (2, 1, "II", 1.0, [4.0])], SEG)
    got = {(r.record_id, r.seg_idx, r.signal): r.samples for r in signals.align(segs).collect()}
    assert got == {
        (1, 1, "ABP"): [1.0, 2.0], (1, 1, "II"): [None, None], (1, 2, "ABP"): [None], (1, 2, "II"): [3.0],
        (1, 3, "ABP"): [None] * 3, (1, 3, "II"): [None] * 3, (2, 1, "II"): [4.0]}


def test_align_aggregates_no_arrays(spark, tmp_path):
    spark.createDataFrame([(1, 1, "ART", 1.0, [1.0, 2.0])], SEG).write.parquet(f"{tmp_path}/s")
    plan = signals.align(spark.read.parquet(f"{tmp_path}/s"))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan


def resampled(spark, samples, fs, target):
    df = spark.createDataFrame([(1, 1, "II", fs, samples)], SEG)
    return signals.resample(df, target).first()


def test_resample(spark):
    up = resampled(spark, [0.0, 10.0, None, 30.0], 62.5, 125.0)
    assert up.fs == 125.0
    assert up.samples == [0.0, 5.0, 10.0, None, None, None, 30.0, 30.0]
    assert resampled(spark, [0.0, 1.0, 2.0, 3.0], 250.0, 125.0).samples == [0.0, 2.0]
    assert resampled(spark, [1.0, None], 125.0, 125.0).samples == [1.0, None]
    assert resampled(spark, [], 62.5, 125.0).samples == []
    assert resampled(spark, [None, None], 62.5, 125.0).samples == [None] * 4
    assert len(resampled(spark, [1.0] * 64, 62.4725, 125.0).samples) == int(64 * 125.0 / 62.4725)


@pytest.mark.parametrize("seed", [1, 2])
def test_rechunk_equals_slicing(spark, seed):
    rnd = random.Random(seed)
    size, segs, heads, want = 10, [], [], {}
    for rec in range(6):
        axis = {"II": [], "ABP": []}
        for idx in range(1, rnd.randint(2, 9)):
            n = rnd.choice([1, 3, 10, 20, 37])
            gap = rnd.random() < 0.2
            heads.append((rec, idx, "~" if gap else "s", n, 125.0, None))
            for raw, signal in (("II", "II"), ("ART", "ABP")):
                here = not gap and rnd.random() < 0.8
                values = [float(rnd.randint(0, 99)) for _ in range(n)] if here else [None] * n
                if here:
                    segs.append((rec, idx, raw, 125.0, values))
                axis[signal] += values
        present = {"ABP" if raw == "ART" else raw for r, _, raw, _, _ in segs if r == rec}
        for signal in present:
            data = axis[signal]
            for c in range(-(-len(data) // size)):
                part = data[c * size:(c + 1) * size]
                want[(rec, signal, c)] = part + [None] * (size - len(part))
    df = spark.createDataFrame(segs + segs[:5], SEG)  # some copies, which must merge
    got = signals.chunk_signals(df, spark.createDataFrame(heads, HEAD), 125.0, size / 125.0)
    got = {(r.record_id, r.signal, r.chunk_id): r.samples for r in signals.by_signal(got).collect()}
    assert got == want


def test_samples_are_computed_once(spark):
    segs = spark.createDataFrame([(1, 1, "II", 62.5, [5.0, 6.0])], SEG)
    heads = spark.createDataFrame([(1, 1, "s", 2, 62.5, ["II"])], HEAD)
    got = signals.chunk_signals(segs, heads, 125.0, 4 / 125.0)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert got.first().signals == {"II": [5.0, 5.5, 6.0, 6.0]}


def test_placed_segments_need_no_offsets(spark):
    segs = spark.createDataFrame([(1, 2, "II", 125.0, [5.0, 6.0], 3)], SEG + ", sample_offset long")
    heads = spark.createDataFrame([(1, 1, "~", 3, 125.0, None), (1, 2, "s", 2, 125.0, ["II"])], HEAD)
    got = signals.chunk_signals(segs, heads, 125.0, 4 / 125.0).orderBy("chunk_id").collect()
    assert [r.signals for r in got] == [{"II": [None, None, None, 5.0]}, {"II": [6.0, None, None, None]}]


def test_two_names_of_one_signal(spark):
    segs = spark.createDataFrame(
        [(1, 1, "ART", 125.0, [1.0, 2.0, 3.0]), (1, 1, "ABP", 125.0, [None, None, 9.0]), (1, 2, "II", 125.0, [4.0])], SEG)
    heads = spark.createDataFrame([(1, 1, "s", 3, 125.0, None), (1, 2, "s", 1, 125.0, None)], HEAD)
    got = signals.chunk_signals(segs, heads, 125.0, 2 / 125.0).orderBy("chunk_id").collect()
    # per stretch: the first listed name with a real sample
    assert [r.signals for r in got] == [{"ABP": [None, None], "II": [None, None]}, {"ABP": [9.0, None], "II": [None, 4.0]}]


def test_small_array_functions(spark):
    df = spark.createDataFrame([([1.0, float("nan"), None, 3.0],), ([float("nan")],), ([],)], "s array<float>")
    assert [r[0] for r in df.select(arrays.nan_max(F.col("s"))).collect()] == [3.0, None, None]
    assert [r[0] for r in df.select(F.size(arrays.pad(F.col("s"), 2))).collect()] == [4, 2, 2]
    more = df.unionByName(spark.createDataFrame([(None,)], df.schema)).withColumnRenamed("s", "samples")
    assert [r[0] for r in signals.clean(more).collect()] == [[1.0, None, None, 3.0], [None], [], None]


def test_coverage(spark):
    heads = spark.createDataFrame(
        [(1, 0, "layout", 0, 1.0, ["II", "ART"]), (1, 1, "a", 10, 1.0, ["II", "ART", "ABP"]),
         (1, 2, "~", 5, 1.0, None), (1, 3, "b", 7, 1.0, None), (1, 4, "c", 3, 1.0, ["Pleth", "Other"]),
         (2, 0, "layout", 0, 1.0, ["Other"]), (2, 1, "a", 9, 1.0, ["II"]), (3, 1, "a", 9, 1.0, ["II"])], HEAD)
    records = spark.createDataFrame([(r, 25) for r in (1, 2, 3)], "record_id long, record_len long")
    got = recordings.signal_coverage(records, heads).collect()
    assert [r.record_id for r in got] == [1]
    r = got[0]
    assert (r.total_samples, r.II_samples, r.ABP_samples, r.PLETH_samples, r.CVP_samples) == (13, 10, 20, 3, 0)


def test_flags_and_paths(spark):
    segs = spark.createDataFrame([(1, 1, "aVR", 1.0, [1.0]), (1, 1, "Resp", 1.0, [1.0])], SEG)
    row = signals.signal_flags(signals.signal_map(segs)).first().asDict()
    assert {k for k, v in row.items() if v == 1} == {"record_id", "has_AVR", "has_RESP"}
    assert len(row) == 1 + len(vocab.SIGNALS)
    df = spark.createDataFrame([(10014354, 81739927)], "s long, r long")
    assert df.select(dataset.path_key("s", "r", "root/")).first()[0] == "root/p100/p10014354/81739927"


def test_overlapping_pieces_keep_their_places(spark):
    rnd = random.Random(4)
    for trial in range(6):
        rows = []
        for k in range(rnd.randint(1, 6)):
            start, n = rnd.randint(0, 40), rnd.randint(1, 25)
            rows.append((1, "II", k, start, [float(100 * k + j) for j in range(n)]))
        df = spark.createDataFrame(rows, "record_id long, signal string, variant_rank int, sample_offset long, samples array<float>")
        got = {r.chunk_id: r.signals["II"] for r in signals.rechunk(df, 10).collect()}
        assert all(len(x) == 10 for x in got.values())
        for chunk, samples in got.items():
            # At each place a sample of some piece that covers it, or nothing where none does.
            for at, value in enumerate(samples, 10 * chunk):
                covering = {r[4][at - r[3]] for r in rows if r[3] <= at < r[3] + len(r[4])}
                assert (value in covering) if covering else value is None


def test_rates_without_a_place_in_time(spark):
    rates = [None, 0.0, -1.0, float("nan"), float("inf"), 50.0, 125.0]
    df = spark.createDataFrame([(k, r, [1.0, 2.0, 3.0, 4.0]) for k, r in enumerate(rates)] + [(9, 50.0, None)],
                               "k int, fs double, samples array<float>")
    got = {r.k: (r.x, r.n) for r in df.select(
        "k", arrays.resample(F.col("samples"), F.col("fs"), 125.0).alias("x"),
        arrays.resampled_size(F.size("samples"), F.col("fs"), 125.0).alias("n")).collect()}
    assert [got[k] for k in range(5)] == [(None, None)] * 5
    assert len(got[5][0]) == 10 == got[5][1] and got[6] == ([1.0, 2.0, 3.0, 4.0], 4) and got[9][0] is None
