"""Ordered computations per key that stay distributed when one key, or one moment, is huge.

A window over (key ORDER BY time) puts a key into one task.  Here the rows are cut into
ranges of the full order, which is key, time and whatever breaks ties: a burst of rows at
one time is cut like anything else, and no range is much larger than its share of all rows.
Windows run per (key, range).  What has to cross the border of a range is an associative
state, computed from one summary row per range of those keys that do span ranges, which are
no more than there are borders, and joined back.

The ranges are written to the shared folder once, so that every step sees the same ones.
Rows without a key or a time take no part: they belong to no group, or have no place in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseweave.session import materialize

RANGE = "_range"


def placed(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """The rows that have all keys and a time."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, ts]]))


def ranged(df: DataFrame, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """:func:`placed` rows with :data:`RANGE`, the number of their range of (keys, order), written once.

    ``order`` begins with the time and should end in columns that tell rows apart.  There
    are as many ranges as shuffle partitions unless ``ranges`` says otherwise.  Rows that
    have their ranges already, by the same keys and order, come back as they are.
    """
    if RANGE in df.columns:
        return df
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    cut = placed(df, keys, order[0]).repartitionByRange(n, *by)
    return materialize(cut.withColumn(RANGE, F.spark_partition_id()))


def per_range(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys, RANGE).orderBy(*order)


def across_ranges(keys: list[str]) -> Window:
    """Order of the summary rows of a key."""
    return Window.partitionBy(*keys).orderBy(RANGE)


def crossing(df: DataFrame, ranged_rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df`` whose key spans several ranges of ``ranged_rows``.

    Ranges follow the order of the keys, so each border lies within one key at most: the
    keys looked for are fewer than the ranges, and are broadcast.
    """
    spans = ranged_rows.groupBy(*keys).agg(F.min(RANGE).alias("_from"), F.max(RANGE).alias("_to"))
    return df.join(F.broadcast(spans.where("_from < _to").select(*keys)), keys, "left_semi")


def attach(df: DataFrame, keys: list[str], state: DataFrame, names: list[str]) -> DataFrame:
    """Bring the state at the border of a range to its rows; keys within one range have none.

    ``state`` has the rows of :func:`crossing` keys, two per border at most, so it is broadcast
    and the rows stay where they are.
    """
    some = state.where(reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names]))
    return df.join(F.broadcast(some.select(*keys, RANGE, *names)), [*keys, RANGE], "left")


def previous_time(df: DataFrame, keys: list[str], ts: str, name: str, ranges: int | None = None) -> DataFrame:
    """``lag(ts)`` per key over rows with distinct times."""
    b = ranged(df, keys, [ts], ranges)
    rows = b.withColumn(name, F.lag(ts).over(per_range(keys, [F.col(ts)])))
    last = crossing(b, b, keys).groupBy(*keys, RANGE).agg(F.max(ts).alias("_last"))
    border = last.withColumn("_border", F.lag("_last").over(across_ranges(keys)))
    return attach(rows, keys, border, ["_border"]).withColumn(name, F.coalesce(name, "_border")).drop("_border", RANGE)


def nearest(
    probes: DataFrame,
    points: DataFrame,
    keys: list[str],
    ts: str,
    payload: str,
    ranges: int | None = None,
) -> DataFrame:
    """For each probe the payloads of the points next before-or-at and next after it.

    Both inputs have ``keys`` and ``ts``; points also have the struct ``payload``
    and at most one row per (key, time).  Sorts the union once per direction instead
    of pairing each probe with each point.  Adds ``before`` and ``after``.
    """
    kind = points.schema[payload].dataType
    both = points.select(*keys, ts, payload, F.lit(0).alias("_probe")).unionByName(
        probes.select(
            *keys, ts, F.lit(None).cast(kind).alias(payload), F.lit(1).alias("_probe")
        )
    )
    b = ranged(both, keys, [ts, "_probe"], ranges)
    preceding = (Window.unboundedPreceding, 0)
    up = per_range(keys, [F.col(ts), F.col("_probe")]).rowsBetween(*preceding)
    down = per_range(keys, [F.col(ts).desc(), F.col("_probe").desc()]).rowsBetween(*preceding)
    rows = b.withColumns(
        {
            "before": F.last(payload, ignorenulls=True).over(up),
            "after": F.last(payload, ignorenulls=True).over(down),
        }
    )
    point = F.when(F.col("_probe") == 0, F.struct(ts, payload))
    ends = crossing(b, b, keys).groupBy(*keys, RANGE).agg(F.max(point).alias("_latest"), F.min(point).alias("_earliest"))
    back = Window.partitionBy(*keys).orderBy(F.col(RANGE).desc())
    earlier = across_ranges(keys).rowsBetween(Window.unboundedPreceding, -1)
    later = back.rowsBetween(Window.unboundedPreceding, -1)
    border = ends.withColumns(
        {
            "_b": F.last(f"_latest.{payload}", True).over(earlier),
            "_a": F.last(f"_earliest.{payload}", True).over(later),
        }
    )
    return attach(rows.where(F.col("_probe") == 1), keys, border, ["_b", "_a"]).select(
        *keys,
        ts,
        F.coalesce("before", "_b").alias("before"),
        F.coalesce("after", "_a").alias("after"),
    )


_BLOCK = 65_536


def running_total(df: DataFrame, key: str, index: str, amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over strictly smaller ``index`` values of a key.

    ``index`` numbers the rows of a key, so blocks of it have bounded size.  The sum has
    two levels: inside the block, plus the blocks before.
    """
    preceding = (Window.unboundedPreceding, -1)
    block = F.call_function("div", F.col(index), F.lit(_BLOCK))
    b = df.withColumn("_block", block)
    inside = Window.partitionBy(key, "_block").orderBy(index).rowsBetween(*preceding)
    total = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(*preceding)
    carried = (
        b.groupBy(key, "_block")
        .agg(F.sum(amount).alias("_sum"))
        .select(key, "_block", F.sum("_sum").over(earlier).alias("_carried"))
        .where(F.col("_block") > 0)
    )
    return (
        b.withColumn(name, total)
        .join(carried, [key, "_block"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_carried", F.lit(0)))
        .drop("_block", "_carried")
    )
