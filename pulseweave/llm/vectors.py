"""Near-duplicate vectors: quantised tile products with rigorous error bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.graph import components
from pulseweave.session import materialize

#: Vectors of a tile; a task holds two tiles.
TILE = 4096
_STRIP = 512
#: Added to every bound for the rounding of the double arithmetic itself.
_SLACK = 1e-9


def usable(vector: str):
    """Not NULL, no NULL or non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scale of each unit vector, and the exact length of its error."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(unit - codes * scale[:, None], axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(left: np.ndarray, right: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of two sets of unit vectors with a cosine of ``threshold`` or more.

    With u = a + e and w = b + f (a, b quantised), Cauchy-Schwarz gives
    ``|u.w - a.b| <= |e| |w| + |a| |f|``.  Products of the codes are whole numbers small
    enough for float32 up to 1,040 components, beyond that float64 takes them: exact in
    both.  Only pairs that the bound can't exclude are computed again in double precision.
    """
    (p, s, e), (q, t, f) = quantise(left), quantise(right)
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    a = np.linalg.norm(p * s[:, None], axis=1)
    q_t = q.astype(kind).T
    for first in range(0, len(left), _STRIP):
        rows = slice(first, first + _STRIP)
        product = p[rows].astype(kind) @ q_t
        near = product * s[rows, None] * t
        near += e[rows, None] + a[rows, None] * f
        i, j = np.nonzero(near >= threshold - _SLACK)
        i += first
        if same:
            i, j = i[i < j], j[i < j]
        exact = np.empty(len(i))
        for k in range(0, len(i), 1 << 16):
            exact[k:k + (1 << 16)] = np.einsum("ij,ij->i", left[i[k:k + (1 << 16)]], right[j[k:k + (1 << 16)]])
        hit = exact >= threshold
        yield i[hit], j[hit]


def _forest(edges: np.ndarray, nodes: int) -> np.ndarray:
    """The edges that join two trees, one after the other."""
    parent = list(range(nodes))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = np.zeros(len(edges), bool)
    for k, (x, y) in enumerate(edges.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used[k] = True
    return edges[used]


def _tile_pairs(threshold: float):
    def run(batch: pa.Table) -> pa.Table:
        """Rows of two tiles: per vector its number of links, and edges that connect the same vectors."""
        batch = batch.combine_chunks()
        ids, size = batch["vec_id"].to_numpy(), batch["copies"].to_numpy()
        first, second = batch["first"][0].as_py(), batch["second"][0].as_py()
        values = batch["vector"].combine_chunks()
        x = unit_rows(values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
        tile = batch["tile"].to_numpy()
        left = np.flatnonzero(tile == first)
        right = left if first == second else np.flatnonzero(tile == second)
        count = np.zeros(len(ids), np.int64)
        edges = []
        if len(left) and len(right):
            for i, j in links(x[left], x[right], threshold, first == second):
                i, j = left[i], right[j]
                count += np.bincount(i, size[j], len(ids)).astype(np.int64)
                count += np.bincount(j, size[i], len(ids)).astype(np.int64)
                edges.append(_forest(np.stack([i, j], axis=1), len(ids)))
        edges = _forest(np.concatenate(edges), len(ids)) if edges else np.empty((0, 2), np.int64)
        hit = np.flatnonzero(count)
        nothing = pa.nulls(len(edges), pa.int64())
        return pa.table({
            "a": pa.array(np.concatenate([ids[hit], ids[edges[:, 0]]])),
            "b": pa.concat_arrays([pa.nulls(len(hit), pa.int64()), pa.array(ids[edges[:, 1]])]),
            "links": pa.concat_arrays([pa.array(count[hit]), nothing]),
        })

    return run


def near_vectors(vectors: DataFrame, threshold: float, id_column: str = "vec_id", vector: str = "embedding",
                 group: str = "label", tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two vectors are linked when their groups are equal and not NULL, their lengths are
    equal, both are usable (:func:`usable`) and their cosine is at least ``threshold``.
    ``n_links`` counts the other rows linked directly, ``component_id`` is the smallest id
    reachable, ``kept`` marks it.  Rows that link with nothing are their own component.

    Equal vectors of a group are compared once and counted as often as they occur.  A
    group is dealt into tiles of about ``tile`` vectors by a hash; every pair of tiles is a
    task of bounded size, so a large group becomes many tasks.  A task returns one count
    per vector and a forest of edges, never all its pairs.  The work grows with the square
    of a group's different vectors, which the exact count of links asks for.

    Rows that repeat with one id are copies of each other, and each gets a row.  Rows
    without id keep a NULL component, are kept and count in nobody's links.  Other
    columns are ignored.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(group).alias("label"),
                          F.col(vector).alias("vector"))
    good = rows.where(usable("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = good.withColumn("width", F.size("vector"))
    classes = materialize(good.groupBy("label", "width", "vector")
                          .agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")))
    groups = classes.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(groups, ["label", "width"]).withColumn(
        "tile", F.pmod(F.xxhash64(F.lit("tile"), "vec_id"), F.col("tiles")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
        "label", "width", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
        "tile", "vec_id", "copies", "vector")
    found = materialize(paired.groupBy("label", "width", "first", "second")
                        .applyInArrow(_tile_pairs(threshold), "a long, b long, links long"))
    edges = found.where("b is not null").select("a", "b")
    counts = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(edges, "a", "b")
    classes = (
        classes.join(counts, classes.vec_id == counts.a, "left")
        .join(joined, classes.vec_id == joined.node, "left")
        .select("label", "width", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "vec_id").alias("component_id"))
    )
    members = good.select("vec_id", "label", "width", "vector").join(classes, ["label", "width", "vector"]) \
        .select("vec_id", "n_links", "component_id")
    others = rows.where(~usable("vector") | F.col("label").isNull() | F.col("vec_id").isNull()) \
        .select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return members.unionByName(others).select(
        F.col("vec_id").alias(id_column), "n_links", "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


_ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT l.b, reach.r FROM reach JOIN links l ON l.a = reach.v),
low AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON v = vec_id
"""


@query("op7_near_vectors", _ORACLE)
def op7_near_vectors(spark: SparkSession, directory: str) -> DataFrame:
    return near_vectors(table(spark, directory, "embeddings"), 0.93)
