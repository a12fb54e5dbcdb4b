"""Infusions as constant-rate intervals.

Metavision rows are intervals already.  Carevue rows are single chartings, from
which intervals are rebuilt: continuous drips by following the charted rate, and
repeated pushes as if each dose ran since the previous one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseweave import vocab
from pulseweave.functions.clinical import not_nan
from pulseweave.functions.timing import HOUR, micros, minutes, plus_micros
from pulseweave.operators import ordered
from pulseweave.operators.ordered import RANGE
from pulseweave.operators.overlap import overlap_join

INTERVAL_COLUMNS = (
    "stay_id", "itemid", "label", "starttime", "endtime", "rate", "rateuom",
    "amount", "amountuom", "ordercategorydescription",
)
GROUP = ["stay_id", "itemid"]
_DUPLICATE_KEY = ("stay_id", "itemid", "charttime", "storetime", "cgid", "amount", "rate")


def label_items(events: DataFrame, items: DataFrame) -> DataFrame:
    """Attach item labels; events of unlisted items drop out."""
    return events.join(items.select("itemid", "label"), "itemid")


def filter_inputs(inputs: DataFrame, labels=vocab.DRUG_LABELS) -> DataFrame:
    return inputs.where(F.col("label").isin(*labels))


def format_metavision(events: DataFrame) -> DataFrame:
    """Project labelled interval rows to the canonical ten columns."""
    return events.select(
        "stay_id", "itemid", "label", "starttime", "endtime",
        not_nan(F.col("rate")).alias("rate"), "rateuom",
        not_nan(F.col("amount")).alias("amount"), "amountuom",
        "ordercategorydescription",
    )


def dedupe_first(events: DataFrame, keys=_DUPLICATE_KEY, order: str = "row_id") -> DataFrame:
    """One row per key, the one with the smallest ``order``.

    A minimum, not a ranking window: copies already merge before the shuffle.
    """
    rest = [c for c in events.columns if c not in keys and c != order]
    first = F.min(F.struct(order, *rest)).alias("_first")
    return events.groupBy(*keys).agg(first).select(*keys, "_first.*")


CHARTING_ORDER = ["charttime", "storetime", "cgid", "row_id"]


def _charting_order() -> list[Column]:
    return [F.col(c) for c in CHARTING_ORDER]


def drip_intervals(rows: DataFrame, ranges: int | None = None) -> DataFrame:
    """Constant-rate intervals from point-charted drips, per (stay, item).

    A positive rate opens an interval; a changed rate closes it and opens the next;
    no rate, a stop, or the last row closes it.  A stop charted with a positive rate
    while nothing runs opens instead, so such rows flip the state and every other
    row sets it.  The state after a row therefore is the last setting row's, flipped
    once per flip since then.  Rows without stay, item or time take no part.  Per range of
    the charting order that is a constant or a flip, which is what crosses the borders of
    ranges, along with the last rate and the last opening.
    """
    drips = rows.where(F.col("originalroute") == vocab.DRIP_ROUTE).withColumn(
        "rate", not_nan(F.col("rate"))
    )
    w = ordered.per_range(GROUP, _charting_order())
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    valid = F.coalesce(F.col("rate") > 0, F.lit(False))
    stopped = F.coalesce(F.col("stopped") == "Stopped", F.lit(False))

    rows = ordered.ranged(drips, GROUP, CHARTING_ORDER, ranges)
    b = (
        rows.withColumns({"_valid": valid, "_stop": stopped, "_flip": valid & stopped})
        .withColumn("_flips", F.sum(F.col("_flip").cast("long")).over(upto))
        .withColumn("_set", F.last(F.when(~F.col("_flip"), F.col("_valid")), True).over(upto))
        .withColumn("_base", F.last(F.when(~F.col("_flip"), F.col("_flips")), True).over(upto))
        .withColumn("_odd", (F.col("_flips") - F.coalesce("_base", F.lit(0))) % 2 == 1)
        .withColumn("_lag_rate", F.lag("rate").over(w))
        .withColumn("_tail", F.lead(F.lit(1)).over(w).isNull())
    )

    earlier = ordered.across_ranges(GROUP).rowsBetween(Window.unboundedPreceding, -1)
    entry = _entry_state(ordered.crossing(b.where(F.col("_tail")), rows, GROUP), earlier)
    entered = F.coalesce("_open_in", F.lit(False))
    s = ordered.attach(b, GROUP, entry, ["_open_in", "_in_rate", "_more"])
    s = s.withColumn("_after", F.coalesce(F.col("_set"), entered) != F.col("_odd"))
    s = s.withColumn("_before", F.coalesce(F.lag("_after").over(w), entered))
    last = F.col("_tail") & F.col("_more").isNull()
    changed = F.coalesce(F.col("rate") != F.coalesce("_lag_rate", "_in_rate"), F.lit(False))
    s = s.withColumn(
        "_closes", F.col("_before") & (~F.col("_valid") | F.col("_stop") | last | changed)
    ).withColumn(
        "_opening",
        F.when(
            F.col("_valid") & (~F.col("_before") | (changed & ~F.col("_stop") & ~last)),
            F.struct("charttime", "rate", "rateuom"),
        ),
    )
    opened = F.last("_opening", True)
    ends = s.withColumn("_latest", opened.over(upto)).where(F.col("_tail"))
    last_open = ordered.crossing(ends, rows, GROUP).withColumn("_in_open", F.last("_latest", True).over(earlier))
    s = ordered.attach(s.withColumn("_run", opened.over(before)), GROUP, last_open, ["_in_open"])
    return (
        s.where(F.col("_closes"))
        .withColumn("_run", F.coalesce("_run", "_in_open"))
        .select(
            *GROUP, "label",
            F.col("_run.charttime").alias("starttime"),
            F.col("charttime").alias("endtime"),
            F.col("_run.rate").alias("rate"),
            F.col("_run.rateuom").alias("rateuom"),
            F.lit(None).cast("double").alias("amount"),
            F.lit(None).cast("string").alias("amountuom"),
            F.lit(vocab.REBUILT_ROUTE).alias("ordercategorydescription"),
        )
    )


def _entry_state(ends: DataFrame, earlier: Window) -> DataFrame:
    """What a range of a drip inherits, from the last row of each earlier range."""
    wb = ordered.across_ranges(GROUP)
    alone = F.when(F.col("_set").isNull() & F.col("_odd"), 1).otherwise(0)
    ends = ends.withColumn(
        "_p", F.sum(alone).over(wb.rowsBetween(Window.unboundedPreceding, 0))
    )
    known = F.col("_set").isNotNull()
    fixed = F.last(F.when(known, F.col("_set") != F.col("_odd")), True).over(earlier)
    base = F.last(F.when(known, F.col("_p")), True).over(earlier)
    flips = F.lag("_p", 1, 0).over(wb) - F.coalesce(base, F.lit(0))
    return ends.select(
        *GROUP,
        RANGE,
        F.nullif(F.coalesce(fixed, F.lit(False)) != (flips % 2 == 1), F.lit(False)).alias("_open_in"),
        F.lag("rate").over(wb).alias("_in_rate"),
        F.lead(F.lit(True)).over(wb).alias("_more"),
    )


def push_intervals(
    rows: DataFrame, labels=vocab.DRUG_LABELS, ranges: int | None = None
) -> DataFrame:
    """Intervals from repeated pushes, per (stay, item).

    Needs three rows, and three with a positive amount.  Each kept dose is spread
    over the time since the previous kept one.  The first dose takes the second's
    elapsed time if the third's is the same; else the time since the stay's latest
    push of any item; else an hour.
    """
    pushes = ordered.placed(
        rows.where(F.col("originalroute") == vocab.PUSH_ROUTE), GROUP, "charttime"
    ).withColumn("amount", not_nan(F.col("amount")))
    keys = [*GROUP, RANGE]
    b = ordered.ranged(pushes.where(F.col("label").isin(*labels)), GROUP, CHARTING_ORDER, ranges)
    whole = Window.partitionBy(*keys)
    w = ordered.per_range(GROUP, _charting_order())
    counted = b.withColumn("_is", F.coalesce(F.col("amount") > 0, F.lit(False))).withColumns(
        {
            "_all": F.count(F.lit(1)).over(whole),
            "_kept": F.count_if("_is").over(whole),
            "_no": F.count_if("_is").over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    kept = counted.where("_is").withColumns(
        {
            "_prev": F.lag("charttime").over(w),
            "_next": F.lead("charttime").over(w),
            "_next2": F.lead("charttime", 2).over(w),
        }
    )
    around = _push_surroundings(ordered.crossing(counted, b, GROUP))
    r = ordered.attach(
        kept, GROUP, around, ["_g_all", "_g_kept", "_g_prev", "_g_next", "_g_next2"]
    ).where(
        (F.coalesce("_g_all", "_all") >= 3) & (F.coalesce("_g_kept", "_kept") >= 3)
    )
    r = r.withColumns(
        {
            "_prev": F.coalesce("_prev", "_g_prev"),
            "_n1": F.coalesce("_next", "_g_next"),
            "_n2": F.coalesce(
                "_next2",
                F.when(F.col("_next").isNotNull(), F.col("_g_next")).otherwise(
                    F.col("_g_next2")
                ),
            ),
        }
    )
    second = micros("_n1") - micros("charttime")
    third = micros("_n2") - micros("_n1")
    columns = [*GROUP, "label", "charttime", "amount", "amountuom"]
    # Only a first dose without a rhythm asks for the stay's other pushes.
    r = r.select(
        *columns, F.col("_prev").isNull().alias("_first"),
        F.coalesce(micros("charttime") - micros("_prev"), F.when(second == third, second)).alias("_us"),
    )
    alone = F.col("_first") & F.col("_us").isNull()
    times = pushes.select("stay_id", "charttime").distinct()
    prior = ordered.previous_time(times, ["stay_id"], "charttime", "_prior", ranges)
    lone = r.where(alone).join(prior, ["stay_id", "charttime"], "left").withColumn(
        "_us", F.coalesce(micros("charttime") - micros("_prior"), F.lit(HOUR))
    )
    return (
        lone.select(*columns, "_us").unionByName(r.where(~alone).select(*columns, "_us"))
        .where(F.col("_us") > 0)
        .select(
            *GROUP, "label",
            plus_micros("charttime", -F.col("_us")).alias("starttime"),
            F.col("charttime").alias("endtime"),
            (F.col("amount") / minutes(F.col("_us"))).alias("rate"),
            F.concat("amountuom", F.lit("/min")).alias("rateuom"),
            "amount", "amountuom",
            F.lit(vocab.REBUILT_ROUTE).alias("ordercategorydescription"),
        )
    )


def _push_surroundings(counted: DataFrame) -> DataFrame:
    """What a range of pushes has to know of the others, for groups that span ranges.

    Group sizes, the kept time before it and the two kept times after it.  Ranges
    without a kept row only add to the size.
    """
    group, wr = Window.partitionBy(*GROUP), ordered.across_ranges(GROUP)
    at = lambda n: F.min(F.when(F.col("_is") & (F.col("_no") == n), F.col("charttime")))
    ends = (
        counted.groupBy(*GROUP, RANGE)
        .agg(
            F.max("_all").alias("_all"),
            F.max("_kept").alias("_kept"),
            at(1).alias("_t1"),
            at(2).alias("_t2"),
            F.max(F.when(F.col("_is"), F.col("charttime"))).alias("_tn"),
        )
        .withColumns({"_g_all": F.sum("_all").over(group), "_g_kept": F.sum("_kept").over(group)})
        .where((F.col("_kept") > 0) & (F.col("_g_all") > F.col("_all")))
    )
    return ends.select(
        *GROUP,
        RANGE,
        "_g_all",
        "_g_kept",
        F.lag("_tn").over(wr).alias("_g_prev"),
        F.lead("_t1").over(wr).alias("_g_next"),
        F.coalesce(F.lead("_t2").over(wr), F.lead("_t1", 2).over(wr)).alias("_g_next2"),
    )


def format_carevue(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """Labelled point chartings to canonical intervals of both kinds.

    The deduplicated rows are written once, in ranges of the order that both kinds follow.
    """
    rows = ordered.ranged(
        dedupe_first(ordered.placed(events, GROUP, "charttime")), GROUP, CHARTING_ORDER, ranges
    )
    return drip_intervals(rows, ranges).unionByName(push_intervals(rows, ranges=ranges))


def match_inputs(inputs: DataFrame, cohort: DataFrame) -> DataFrame:
    """Infusions of the stay that run during a recording or ended up to 2 h before it."""
    windows = cohort.select(
        "stay_id", "record_id", "start_timestamp", "end_timestamp", "weight_kg"
    )
    padded = plus_micros("endtime", F.lit(vocab.LOOKBACK_HOURS * HOUR))
    return overlap_join(
        inputs,
        windows,
        ["stay_id"],
        (F.col("starttime"), padded),
        (F.col("start_timestamp"), F.col("end_timestamp")),
    )
