"""Interval reconstruction against row-by-row restatements of the rules."""

import random
from datetime import datetime, timedelta

import pytest

from pulseweave.operators import infusions, ordered

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "row_id long, stay_id long, itemid long, label string, charttime timestamp_ntz, "
    "storetime timestamp_ntz, cgid long, amount double, amountuom string, rate double, "
    "rateuom string, originalroute string, stopped string"
)


def chart(row_id, minute, rate=None, stopped=None, stay=1, item=1, route="IV Drip", amount=None,
          label="Levophed"):
    t = T0 + timedelta(minutes=minute)
    return (row_id, stay, item, label, t, t, 0, amount, "mg", rate, "mcg/kg/min", route, stopped)


def drips_by_hand(charted):
    """(stay, item, start, end, rate) by walking each group once."""
    groups = {}
    for r in charted:
        if r[11] == "IV Drip":
            groups.setdefault((r[1], r[2]), []).append(r)
    out = []
    for key, group in groups.items():
        group.sort(key=lambda r: (r[4], r[5], r[6], r[0]))
        running = None
        for n, r in enumerate(group):
            rate, at, stop, last = r[9], r[4], r[12] == "Stopped", n == len(group) - 1
            if rate is None or not rate > 0:
                if running:
                    out.append((*key, running[1], at, running[0]))
                running = None
            elif running is None:
                running = (rate, at)
            elif stop or last or rate != running[0]:
                out.append((*key, running[1], at, running[0]))
                running = None if stop or last else (rate, at)
    return sorted(out)


def pushes_by_hand(charted):
    times = {}
    groups = {}
    for r in charted:
        if r[11] == "Intravenous Push":
            times.setdefault(r[1], set()).add(r[4])
            if r[3] == "Levophed":
                groups.setdefault((r[1], r[2]), []).append(r)
    out = []
    for (stay, item), group in groups.items():
        if len(group) < 3:
            continue
        kept = sorted((r for r in group if (r[7] or 0) > 0), key=lambda r: (r[4], r[5], r[6], r[0]))
        if len(kept) < 3:
            continue
        gaps = [None] + [b[4] - a[4] for a, b in zip(kept, kept[1:])]
        if gaps[1] == gaps[2]:
            gaps[0] = gaps[1]
        else:
            prior = [t for t in times[stay] if t < kept[0][4]]
            gaps[0] = kept[0][4] - max(prior) if prior else timedelta(hours=1)
        for r, gap in zip(kept, gaps):
            if gap > timedelta(0):
                out.append((stay, item, r[4] - gap, r[4], round(r[7] / (gap.total_seconds() / 60), 9)))
    return sorted(out)


def interval_tuples(df):
    return sorted(
        (r.stay_id, r.itemid, r.starttime, r.endtime, r.rate)
        for r in df.select("stay_id", "itemid", "starttime", "endtime", "rate").collect()
    )


CASES = {
    "single row never closes": [chart(1, 0, 5.0)],
    "stopped first opens": [chart(1, 0, 5.0, "Stopped"), chart(2, 10, 5.0), chart(3, 20, 5.0)],
    "stopped twice": [chart(1, 0, 5.0), chart(2, 10, 5.0, "Stopped"), chart(3, 20, 5.0, "Stopped"),
                      chart(4, 30, 5.0)],
    "zero rate closes": [chart(1, 0, 5.0), chart(2, 10, 0.0), chart(3, 20, 4.0), chart(4, 30, 4.0)],
    "missing rate closes": [chart(1, 0, 5.0), chart(2, 10, None), chart(3, 20, None)],
    "change on last closes only": [chart(1, 0, 5.0), chart(2, 10, 7.0)],
    "change mid reopens": [chart(1, 0, 5.0), chart(2, 10, 7.0), chart(3, 20, 7.0)],
    "nothing valid": [chart(1, 0, None), chart(2, 10, 0.0)],
}


@pytest.mark.parametrize("name", CASES)
def test_drip_cases(spark, name):
    charted = CASES[name]
    got = interval_tuples(infusions.drip_intervals(spark.createDataFrame(charted, SCHEMA)))
    assert got == drips_by_hand(charted)


def random_charts(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        stay = 1 if rnd.random() < 0.5 else rnd.randint(2, 8)
        out.append(
            chart(
                k, rnd.randint(0, 400), rnd.choice([None, 0.0, 1.0, 1.0, 2.0]),
                rnd.choice([None, None, "Stopped"]), stay, rnd.randint(1, 2),
                rnd.choice(["IV Drip", "Intravenous Push"]), rnd.choice([None, 0.0, 3.0, 4.5]),
                rnd.choice(["Levophed", "Levophed", "D5W"]),
            )
        )
    # the label is a property of the item
    return [(*r[:3], "Levophed" if r[2] == 1 else "D5W", *r[4:]) for r in out]


def without_place(charted):
    """Copies of some rows that lack stay, item or time; they must change nothing."""
    lost = []
    for r in charted[::7]:
        for column in (1, 2, 4):
            row = list(r)
            row[0], row[column] = row[0] + 100_000 * column, None
            lost.append(tuple(row))
    return charted + lost


RANGES = [1, 3, 40, 300]


@pytest.mark.parametrize("ranges", RANGES)
@pytest.mark.parametrize("seed", [1, 2])
def test_drips_same_in_any_ranges(spark, seed, ranges):
    charted = random_charts(seed)
    df = spark.createDataFrame(without_place(charted), SCHEMA)
    assert interval_tuples(infusions.drip_intervals(df, ranges)) == drips_by_hand(charted)


@pytest.mark.parametrize("ranges", RANGES)
@pytest.mark.parametrize("seed", [3, 4])
def test_pushes_same_in_any_ranges(spark, seed, ranges):
    charted = random_charts(seed)
    df = spark.createDataFrame(without_place(charted), SCHEMA)
    got = [(*r[:4], round(r[4], 9)) for r in interval_tuples(infusions.push_intervals(df, ranges=ranges))]
    assert got == pushes_by_hand(charted)


def test_burst_at_one_time(spark):
    rnd = random.Random(6)
    charted = [chart(0, 0, 1.0)] + [
        chart(k, 500_000 + k // 300, rnd.choice([None, 1.0, 2.0]), rnd.choice([None, "Stopped"]))
        for k in range(1, 400)
    ]
    df = spark.createDataFrame(charted, SCHEMA)
    for ranges in (1, 16, 200):
        assert interval_tuples(infusions.drip_intervals(df, ranges)) == drips_by_hand(charted)


def test_ranges_are_bounded_whatever_shares_a_key_or_a_time(spark):
    """A third of all rows at one time of one drip, another third on it: no range takes more than a few shares."""
    charted = [chart(k, 10, 1.0) for k in range(2000)] + [chart(5000 + k, k, 1.0) for k in range(2000)]
    charted += [chart(9000 + k, k % 50, 2.0, None, 100 + k % 300) for k in range(2000)]
    df = spark.createDataFrame(charted, SCHEMA)
    for n in (6, 24):
        sizes = [r["count"] for r in ordered.ranged(df, infusions.GROUP, infusions.CHARTING_ORDER, n).groupBy(ordered.RANGE).count().collect()]
        assert len(sizes) > n * 0.8 and max(sizes) < 2.5 * 6000 / n
    groups = ordered.ranged(df, infusions.GROUP, infusions.CHARTING_ORDER, 24).groupBy(*infusions.GROUP, ordered.RANGE).count()
    assert groups.agg({"count": "max"}).first()[0] < 2.5 * 6000 / 24


def push(row_id, minute, amount=2.0, item=1, stay=1, label="Levophed"):
    return chart(row_id, minute, None, None, stay, item, "Intravenous Push", amount, label)


@pytest.mark.parametrize(
    "charted, first_gap",
    [
        ([push(1, 100), push(2, 110), push(3, 120), push(4, 150)], 10),  # equal spacing
        ([push(0, 70, item=2, label="D5W"), push(1, 100), push(2, 110), push(3, 130)], 30),
        ([push(1, 100), push(2, 110), push(3, 130)], 60),  # nothing to go by
    ],
)
def test_first_push(spark, charted, first_gap):
    got = interval_tuples(infusions.push_intervals(spark.createDataFrame(charted, SCHEMA)))
    assert got[0][3] - got[0][2] == timedelta(minutes=first_gap)


def test_too_few_pushes_and_zero_gaps(spark):
    few = [push(1, 0), push(2, 10), push(3, 20, None)]
    assert interval_tuples(infusions.push_intervals(spark.createDataFrame(few, SCHEMA))) == []
    same = [push(1, 10), push(2, 10), push(3, 10)]
    assert interval_tuples(infusions.push_intervals(spark.createDataFrame(same, SCHEMA))) == []


def test_dedupe_keeps_smallest_row_id(spark):
    charted = [chart(7, 0, 5.0, "Stopped"), chart(3, 0, 5.0), chart(9, 0, 6.0)]
    got = infusions.dedupe_first(spark.createDataFrame(charted, SCHEMA)).collect()
    assert sorted(r.row_id for r in got) == [3, 9]


def test_drips_of_a_group_do_not_overlap(spark):
    got = interval_tuples(infusions.drip_intervals(spark.createDataFrame(random_charts(9), SCHEMA)))
    for a, b in zip(got, got[1:]):
        if a[:2] == b[:2]:
            assert a[3] <= b[2]


def test_match_inputs_borders(spark, rows):
    t = lambda h: T0 + timedelta(hours=h)
    cohort = spark.createDataFrame(
        [(1, 9, t(10), t(20), 70.0)],
        "stay_id long, record_id long, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, weight_kg double",
    )
    inputs = spark.createDataFrame(
        [(1, 1, t(5), t(8)), (1, 2, t(5), t(8.01)), (1, 3, t(20), t(21)), (1, 4, t(19.9), t(30)),
         (1, 5, t(0), t(40)), (2, 6, t(11), t(12)), (1, 7, t(12), t(12)), (1, 8, t(15), t(13.5)),
         (1, 9, None, t(12))],
        "stay_id long, itemid long, starttime timestamp_ntz, endtime timestamp_ntz",
    )
    got = rows(infusions.match_inputs(inputs, cohort), "itemid")
    # 8 ends before it starts and still meets both conditions
    assert got == [(2,), (4,), (5,), (7,), (8,)]
