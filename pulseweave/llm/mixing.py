"""Mixing sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.ordering import ordered_table, running_totals
from pulseweave.session import materialize

#: Rows of a block.
BLOCK = 16
#: Slots of a pattern of whole shares.
PERIOD = 2520
#: Blocks of a batch of the schedule.
BATCH = 1 << 16


def shares(weights: list[float], period: int) -> list[int]:
    """Whole shares of ``period``, at least 1 each, by largest remainder."""
    total = sum(weights)
    exact = [Fraction(w) / Fraction(total) * period for w in weights]
    whole = [max(1, int(x)) for x in exact]
    order = sorted(range(len(whole)), key=lambda k: (int(exact[k]) - exact[k], k))
    k = 0
    while sum(whole) < period:
        whole[order[k % len(order)]] += 1
        k += 1
    while sum(whole) > period:
        whole[max(range(len(whole)), key=lambda j: (whole[j], -j))] -= 1
    return whole


def pattern(whole: list[int], period: int) -> list[list[int]]:
    """The slots of each source in one period; at its end all are exactly at their share."""
    slots: list[list[int]] = [[] for _ in whole]
    for _, at, s, *_ in islice(schedule([period + 1] * len(whole), whole), period):
        slots[s].append(at)
    return slots


def schedule(blocks: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """(phase, slot, source, release, deadline) of all blocks, in slot order.

    Block k of a source with weight w is released at floor(k / w) and due at
    ceil((k + 1) / w) (Baruah et al., "Proportionate Progress"), counted from the start of
    the phase, in exact arithmetic.  In each slot the released block with the earliest
    deadline goes, ties to the larger weight, then to the first source.  As the weights of
    a phase add up to 1 every deadline is met, so at any time a source is less than one
    block away from its share.  A source that has run out ends the phase and leaves the
    others to share.

    Time is in proportion to the blocks, memory to the sources: a source that a phase has
    not served yet stays where it is in ``fresh``, whose order holds in every phase.
    """
    exact = [Fraction(w) for w in weights]
    unit = lcm(*[w.denominator for w in exact])
    part = [int(w * unit) for w in exact]
    left = list(blocks)
    fresh = [(-part[s], s) for s, n in enumerate(left) if n]
    heapq.heapify(fresh)
    total = -sum(w for w, _ in fresh)
    phase, start, t = 0, 0, 0
    waiting: list[tuple[int, int]] = []
    ready: list[tuple[int, int, int]] = []
    served: dict[int, int] = {}
    while total:
        while waiting and waiting[0][0] <= t:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(served[s] + 1) * total // part[s]), -part[s], s))
        first = (-(-total // -fresh[0][0]), *fresh[0]) if fresh else None
        if first and (not ready or first < ready[0]):
            heapq.heappop(fresh)
            due, _, s = first
        else:
            due, _, s = heapq.heappop(ready)
        k = served.get(s, 0)
        yield phase, start + t, s, start + k * total // part[s], start + due
        served[s] = k + 1
        left[s] -= 1
        t += 1
        if left[s]:
            heapq.heappush(waiting, ((k + 1) * total // part[s], s))
            continue
        total -= part[s]
        for other in served:
            if other != s:
                heapq.heappush(fresh, (-part[other], other))
        phase, start, t = phase + 1, start + t, 0
        waiting, ready, served = [], [], {}


def mix(docs: DataFrame, weights: dict | None = None, exponent: float = 0.5, source: str = "source",
        id_column: str = "doc_id", block: int = BLOCK, period: int = PERIOD, seed: int = 0) -> DataFrame:
    """(id, source, block, phase, release, deadline, slot, position) for every row.

    Rows of a source are shuffled by a seeded hash and cut into blocks of ``block``; blocks
    go to slots by :func:`schedule`, to ``weights``, or to the sources' row counts to the
    power ``exponent``.  A source that ``weights`` doesn't name, or gives none or less, gets
    the smallest positive weight.  ``position`` numbers all rows from 0 in slot order.
    Until a source runs out, it is never a whole block away from its share; then the rest
    share what is left, in a new phase.  No row is dropped or repeated.

    Row numbers within a source come from per-partition totals, so a source with most of
    the rows is spread over all tasks.  One task draws up the schedule from the counts of
    the sources, however many, a row per block, and rows join it by block.  Weights are taken exactly, so ``period`` has no effect any more.  NULL is
    a source of its own, as is every other value; NULL ids and repeated rows are rows like
    others.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(source).alias("source"),
                       F.xxhash64(F.lit(seed), F.col(id_column)).alias("draw"), F.lit(1).cast("long").alias("one"))
    order = ["source", "draw", "id"]
    placed = materialize(running_totals(ordered_table(rows, order), order, {"row": "one"}, key="source"))
    sizes = placed.groupBy("source").count()
    kind = dict(rows.dtypes)["source"]
    slots = materialize(sizes.repartition(1).mapInArrow(
        _blocks(weights, exponent, block),
        f"source {kind}, block long, phase int, release long, deadline long, slot long, before long"))
    b, s = placed.withColumn("block", F.expr(f"row div {block}")).alias("b"), slots.alias("s")
    same = F.col("b.source").eqNullSafe(F.col("s.source")) & (F.col("b.block") == F.col("s.block"))
    return b.join(s, same).select(
        F.col("b.id").alias(id_column), F.col("b.source").alias(source), "b.block", "s.phase", "s.release", "s.deadline", "s.slot",
        (F.col("s.before") + F.col("b.row") % block).alias("position"))


def _blocks(weights: dict | None, exponent: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The schedule of sources (value, rows), with the number of rows before each block."""
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        sizes = list(zip(table.column(0).to_pylist(), table.column(1).to_pylist()))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k][0] is not None, sizes[k][0] if sizes[k][0] is not None else 0))
        values, sizes = table.column(0).combine_chunks().take(pa.array(order, pa.int64())), [sizes[k] for k in order]
        if weights is None:
            wanted = [n ** exponent for _, n in sizes]
        else:
            least = min((w for w in weights.values() if w > 0), default=1.0)
            wanted = [weights.get(s, 0) if weights.get(s, 0) > 0 else least for s, _ in sizes]
        most = (1 << 63) - 1  # of deadlines, which a tiny weight puts later
        done, before = [0] * len(sizes), 0
        entries = schedule([-(-n // block) for _, n in sizes], wanted)
        while some := list(islice(entries, BATCH)):
            out = []
            for phase, slot, s, release, deadline in some:
                out.append((s, done[s], phase, release, min(deadline, most), slot, before))
                before += min(block, sizes[s][1] - done[s] * block)
                done[s] += 1
            source, number, phase, *times = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [values.take(pa.array(source, pa.int64())), pa.array(number, pa.int64()), pa.array(phase, pa.int32()),
                 *(pa.array(x, pa.int64()) for x in times)],
                names=["source", "block", "phase", "release", "deadline", "slot", "before"])

    return run


@query("op1_mixing")
def op1_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mix(table(spark, directory, "documents", "doc_id", "source"))
