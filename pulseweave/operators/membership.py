"""Filters of fixed size: which rows of a large table can belong to a set of keys.

A semi join with a set too large to broadcast shuffles the whole table first.  The filter
is a bit per hash value, gathered by one aggregation of the set, so it is as large for any
set and is broadcast as a small table.  What it lets pass by chance, the join that follows
drops; it only has to drop most of the rest where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of 64 bits.  With 16 million bits, a set of a million keys lets 6 % of others pass.
FILTER_ROWS = 1 << 18
_SLOT, _BITS, _PLACE = "_slot", "_bits", "_place"


def _hashed(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    h = F.xxhash64(F.lit("membership"), *[F.col(k).cast("string") for k in keys])
    return df.withColumns({
        _SLOT: F.pmod(F.shiftright(h, 6), F.lit(rows).cast("long")), _PLACE: F.pmod(h, F.lit(64)).cast("int"),
    })


def may_be_in(df: DataFrame, members: DataFrame, keys: list[str], rows: int = FILTER_ROWS) -> DataFrame:
    """The rows of ``df`` whose keys are in ``members``, and by chance some others.

    At most ``rows`` rows of two numbers are broadcast, whatever the number of members.
    Rows that lack a key belong to nothing and drop out; keys compare as their text, so
    the two sides may have integers of different width.
    """
    known = lambda t: t.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(_PLACE))
    bits = _hashed(known(members.select(*keys)), keys, rows).groupBy(_SLOT).agg(F.bit_or(one).alias(_BITS))
    passed = _hashed(known(df), keys, rows).join(F.broadcast(bits), _SLOT)
    return passed.where(F.getbit(_BITS, F.col(_PLACE)) == 1).select(*df.columns)
