"""Temporal joins on a key plus a time condition.

A plain key join with the time condition as a residual compares every pair of a
key, which is quadratic for a key that holds much of the data.  Both joins below
place intervals on two levels and join once on (key, cell).  An interval of ordinary
length takes the cells of fixed width that it touches: candidates are limited to rows
that are close in time, and one key spreads over as many shuffle keys as it has cells.
A longer one, such as with a wrong end date, takes no cells of time at all; it meets
the rows of its key in cells of the upper level, over which those rows spread evenly.
So each side is read once, joined once, and no row makes more than a fixed number of
rows.  Neither side is broadcast by hint; Spark does so by measured size, and adaptive
execution splits what is still skewed inside one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseweave.functions.timing import DAY, floor_div, micros

CELL = "_cell"
#: Cells of time that an interval may touch; a longer one goes to the upper level.
LONGEST = 64
#: Cells of the upper level that the rows of a key spread over.
SPREAD = 16
# Numbers of the cells of the upper level lie far above those of time: where rows of
# the left meet long intervals of the right, and where long ones of the left meet the right.
_LONG_RIGHT, _LONG_LEFT = 1 << 40, 1 << 41


def _cells(lo: Column, hi: Column, width: int) -> tuple[Column, Column, Column]:
    """(first cell, last cell, whether the interval is of ordinary length).

    An interval whose end precedes its start covers the stretch between the two,
    so it can still meet what contains it.
    """
    first = floor_div(F.least(micros(lo), micros(hi)), width)
    last = floor_div(F.greatest(micros(lo), micros(hi)), width)
    return first, last, last - first < LONGEST


def _one(level: int, cell: Column) -> Column:
    """The cell of the upper level that a row takes, by its time."""
    return F.array(F.lit(level) + F.pmod(cell, F.lit(SPREAD)))


def _all(level: int) -> Column:
    """All cells of the upper level, for the rare rows that have to meet a whole key."""
    return F.sequence(F.lit(level), F.lit(level + SPREAD - 1))


def _on_cells(df: DataFrame, first: Column, cells: Column, name: str) -> DataFrame:
    """One row per cell; ``name`` keeps the first one.  Rows without a bound have none."""
    return df.where(first.isNotNull()).withColumns({name: first, CELL: F.explode(cells)})


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_bounds: tuple[Column, Column],
    right_bounds: tuple[Column, Column],
    cell: int = DAY,
) -> DataFrame:
    """Inner join on ``keys`` where ``left.start < right.end AND left.end > right.start``.

    Two ordinary intervals that overlap share every cell from the later of their first
    cells on; the pair is kept in that one cell only.  A long interval of the right takes
    all cells of the upper level and meets each ordinary row of the left in one of them;
    a long one of the left likewise meets each row of the right.  So a pair comes out once.
    """
    a = left.withColumns({"_ls": left_bounds[0], "_le": left_bounds[1]})
    b = right.withColumns({"_rs": right_bounds[0], "_re": right_bounds[1]})
    first_a, last_a, short_a = _cells(F.col("_ls"), F.col("_le"), cell)
    first_b, last_b, short_b = _cells(F.col("_rs"), F.col("_re"), cell)
    of_a = F.when(short_a, F.concat(F.sequence(first_a, last_a), _one(_LONG_RIGHT, first_a))).otherwise(_all(_LONG_LEFT))
    of_b = F.concat(
        F.when(short_b, F.sequence(first_b, last_b)).otherwise(_all(_LONG_RIGHT)), _one(_LONG_LEFT, first_b)
    )
    a = _on_cells(a.where("_ls is not null and _le is not null"), first_a, of_a, "_lfirst")
    b = _on_cells(b.where("_rs is not null and _re is not null"), first_b, of_b, "_rfirst")
    overlap = (F.col("_ls") < F.col("_re")) & (F.col("_le") > F.col("_rs"))
    once = (F.col(CELL) == F.greatest("_lfirst", "_rfirst")) | (F.col(CELL) >= _LONG_RIGHT)
    return a.join(b, [*keys, CELL]).where(overlap & once).drop("_ls", "_le", "_rs", "_re", "_lfirst", "_rfirst", CELL)


def point_join(
    points: DataFrame,
    spans: DataFrame,
    keys: list[str],
    at: Column,
    bounds: tuple[Column, Column],
    cell: int = DAY,
) -> DataFrame:
    """Inner join on ``keys`` where ``span.start <= at < span.end``.

    Only the spans are multiplied over cells of time; a point has one of each level.
    """
    place = floor_div(micros("_at"), cell)
    p = points.withColumn("_at", at).where("_at is not null")
    p = p.withColumn(CELL, F.explode(F.concat(F.array(place), _one(_LONG_RIGHT, place))))
    s = spans.withColumns({"_rs": bounds[0], "_re": bounds[1]}).where("_rs < _re")
    first, last, short = _cells(F.col("_rs"), F.col("_re"), cell)
    s = _on_cells(s, first, F.when(short, F.sequence(first, last)).otherwise(_all(_LONG_RIGHT)), "_rfirst")
    inside = (F.col("_at") >= F.col("_rs")) & (F.col("_at") < F.col("_re"))
    return p.join(s, [*keys, CELL]).where(inside).drop("_at", "_rs", "_re", "_rfirst", CELL)
