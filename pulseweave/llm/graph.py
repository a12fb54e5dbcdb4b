"""Connected components of a large edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseweave.session import materialize


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node with an edge to another; component is the smallest node reachable.

    Alternates two steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond"): every node hands its larger neighbours to its smallest one, then its
    smaller neighbours.  Each step is one aggregation and one join; a hub's minimum
    merges ahead of the shuffle and its edges are one side of a join that adaptive
    execution can split.  Every round is written to the shared folder, so a lost
    executor costs no earlier round.  NULL ends and loops count as no edge.
    """
    u, v = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    stars = materialize(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(u, v).where("u > v").distinct()
    )
    before = _fingerprint(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")),
        )).alias("e")).select("e.*").where("u > v").distinct()
        stars = materialize(small)
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _fingerprint(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
