"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, erf, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.tokens import lists, mix
from pulseweave.llm.vectors import usable
from pulseweave.session import materialize

TABLES = 2
#: Rows a bucket should hold; the number of hash functions follows from it and the table's size.
BUCKET = 2048
#: Bound of the rows that the slot borders and the success estimate are fitted on.
SAMPLE = 4096
#: Estimated chance, over all tables, that a near neighbour's bucket is visited.
TARGET = 0.96
#: Buckets a query should reach TARGET with in a table.  Hash functions are given up until sampled
#: queries do; a query that still needs more visits goes on.
PROBES = 4096
#: The same chance in one table.
SHARE = 1 - (1 - TARGET) ** (1 / TABLES)
#: Chances up to which queries go on that found too few candidates; the last means all buckets.
SHARES = (SHARE, 0.9999, 2.0)
#: Bounds of a task: indexed vectors, and queries, that meet in it.
CHUNK = 2048
#: Rows of a batch that hashing returns.
OUT = 1 << 16
_SEED = 7
_erf = np.vectorize(erf, otypes=[float])


@dataclass
class Index:
    """Fitted hashing: ``floor((direction . x + shift) / slot)`` per function.

    Vectors are scaled by the largest norm and get one more component that makes all
    lengths 1; queries are scaled to length 1 and get 0 there.  Then the nearest in
    Euclidean distance has the largest inner product.
    """

    directions: np.ndarray  # width + 1, tables, functions
    shifts: np.ndarray  # tables, functions
    slot: float
    largest: float
    closeness: float  # of a query to its near neighbours: their cosine, after scaling
    slots: np.ndarray  # slot numbers that occur, outer ones stand for all beyond
    sample: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by width: classes, vectors, their buckets

    def floors(self, x: np.ndarray, keep: int, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        """A score that ``keep`` of those that each query finds reach: rows of the sample in
        buckets that it visits (``owner``, ``key``)."""
        _, known, held = self.sample.get(x.shape[1], ((), np.empty((0, x.shape[1])), np.empty((0, 1), np.int64)))
        if len(known) < keep:
            return np.full(len(x), -np.inf)
        names, place = np.unique(held, return_inverse=True)
        at = np.minimum(np.searchsorted(names, key), len(names) - 1)
        real = names[at] == key
        visited = np.zeros((len(x), len(names)), bool)
        visited[owner[real], at[real]] = True
        found = np.logical_or.reduce([visited[:, p] for p in place.reshape(held.shape).T])
        s = np.where(found, x @ known.T, -np.inf)
        return np.partition(s, s.shape[1] - keep, axis=1)[:, s.shape[1] - keep]

    def project(self, x: np.ndarray, queries: bool) -> np.ndarray:
        if queries:
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            last = np.zeros(len(x))
        else:
            x = x / self.largest
            last = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))
        width = x.shape[1]
        out = np.tensordot(x, self.directions[:width], 1) + last[:, None, None] * self.directions[-1]
        return out + self.shifts

    def buckets(self, numbers: np.ndarray, width: int) -> np.ndarray:
        """Bucket keys (rows, tables) from slot numbers (rows, tables, functions)."""
        numbers = np.clip(numbers, self.slots[0], self.slots[-1]).astype(np.int64).view(np.uint64)
        key = np.full(numbers.shape[:2], width, np.uint64) + np.arange(numbers.shape[1], dtype=np.uint64) * np.uint64(1 << 32)
        for k in range(numbers.shape[2]):
            key = mix(key * np.uint64(31) + numbers[:, :, k])
        return key.view(np.int64)

    def index(self, x: np.ndarray) -> np.ndarray:
        return self.buckets(np.floor(self.project(x, False) / self.slot), x.shape[1])

    def probes(self, x: np.ndarray, share: float = SHARE) -> tuple[np.ndarray, np.ndarray]:
        """(query number, bucket key) of all visits.

        A near neighbour's projection is normal around ``closeness`` times the query's, so
        each slot of each function has a chance, and a bucket the product of them.  Buckets
        are taken in falling order of it until the chances add up to ``share``, however
        many that takes: those of all buckets add up to 1.
        """
        tables, functions = self.shifts.shape
        chance = self.chances(x)
        every = len(self.slots) ** functions
        owners, keys = [], []
        for t in range(tables):
            todo, limit = np.arange(len(x)), min(PROBES, every)
            while len(todo):
                short = []
                step = max(1, len(x) * PROBES // limit)
                for first in range(0, len(todo), step):
                    part = todo[first:first + step]
                    found, picked = self.best(chance[part, t], limit)
                    before = np.cumsum(found, axis=1) - found
                    done = (before[:, -1] + found[:, -1] >= share) | (limit == every)
                    short.append(part[~done])
                    owner, place = np.nonzero((before < share) & done[:, None])
                    numbers = np.zeros((len(owner), tables, functions), np.int64)
                    numbers[:, t] = picked[owner, place]
                    owners.append(part[owner])
                    keys.append(self.buckets(numbers, x.shape[1])[:, t])
                todo, limit = np.concatenate(short), min(4 * limit, every)
        return np.concatenate(owners), np.concatenate(keys)

    def reaches(self, x: np.ndarray) -> bool:
        """Whether PROBES visits in each table bring all of these queries to the target."""
        chance = self.chances(x)
        return all((self.best(chance[:, t], PROBES)[0].sum(axis=1) >= SHARE).all() for t in range(chance.shape[1]))

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Logarithms (query, table, function, slot) of a near neighbour's chance of the slot."""
        at = self.closeness * (self.project(x, True) - self.shifts) + self.shifts
        spread = np.sqrt(2 * max(1e-6, 1 - self.closeness ** 2))
        borders = np.concatenate([[-np.inf], self.slots[1:] * self.slot, [np.inf]])
        below = 0.5 * (1 + _erf((borders - at[..., None]) / spread))
        return np.log(np.maximum(np.diff(below, axis=-1), 1e-300))

    def best(self, chance: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``limit`` likeliest buckets of each query in one table: chances, slot numbers."""
        score, picked = np.zeros((len(chance), 1)), np.zeros((len(chance), 1, 0), np.int64)
        for k in range(chance.shape[1]):
            # The best prefixes hold the prefix of each best sequence, so this order is exact.
            grown = (score[:, :, None] + chance[:, k][:, None, :]).reshape(len(chance), -1)
            best = np.argsort(-grown, axis=1, kind="stable")[:, :limit]
            score = np.take_along_axis(grown, best, 1)
            old, new = np.divmod(best, len(self.slots))
            picked = np.concatenate([np.take_along_axis(picked, old[:, :, None], 1), self.slots[new][:, :, None]], axis=2)
        return np.exp(score), picked


def fit(classes: DataFrame, neighbours: int) -> Index | None:
    """Fit on at most about SAMPLE rows, chosen by a hash; sizes and the largest norm are of all rows."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    n, width, largest = classes.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(norm)).first()
    if not n:
        return None
    draw = F.pmod(F.xxhash64(F.lit("sample"), "cls"), F.lit(1 << 24)) < int(min(1.0, SAMPLE / n) * (1 << 24))
    drawn = [(r[0], np.asarray(r[1], float)) for r in classes.where(draw).select("cls", "vector").collect()]
    sample = {}
    for size in {len(x) for _, x in drawn}:
        some = [(c, x) for c, x in drawn if len(x) == size]
        sample[size] = np.array([c for c, _ in some]), np.stack([x for _, x in some]), np.empty((0, 0), np.int64)
    functions = max(1, min(16, round(log2(max(n / BUCKET, 2)) / 2)))
    rng = np.random.default_rng(_SEED)
    directions, shifts = rng.standard_normal((width + 1, TABLES, functions)), rng.random((TABLES, functions))
    index = Index(directions, shifts, 1.0, largest, 0.5, np.arange(-3, 4), sample)
    cosines = []
    for _, x, _ in sample.values():
        if len(x) > 1:
            q = x[:256] / np.linalg.norm(x[:256], axis=1, keepdims=True)
            near = np.sort(q @ x.T, axis=1)[:, ::-1]
            rank = min(max(1, ceil(neighbours * len(x) / n)), len(x) - 1)  # after the query itself
            cosines.extend(near[:, rank] / largest)
    if cosines:
        index.closeness = float(np.clip(np.median(cosines), 0.05, 0.999))
    while functions > 1 and not all(index.reaches(x[:64]) for _, x, _ in sample.values()):
        functions -= 1
        index.directions, index.shifts = directions[:, :, :functions], shifts[:, :functions]
    index.sample = {size: (c, x, index.index(x)) for size, (c, x, _) in sample.items()}
    return index


def _keyed(held, queries: bool, keep: int, share: float = SHARE):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            cls, vectors = batch.column(0).to_numpy(), batch.column(1)
            widths = np.diff(vectors.offsets.to_numpy())
            for width in np.unique(widths):
                rows = np.flatnonzero(widths == width)
                some = vectors.take(pa.array(rows))
                flat = some.flatten().to_numpy(zero_copy_only=False)
                x = flat.astype(np.float64).reshape(len(rows), width)
                for first in range(0, len(rows), 64):
                    part = slice(first, first + 64)
                    if queries:
                        owner, key = index.probes(x[part], share)
                        floor = index.floors(x[part], keep, owner, key)
                    else:
                        key = index.index(x[part])
                        owner, key = np.repeat(np.arange(len(key)), key.shape[1]), key.ravel()
                        floor = np.zeros(len(x[part]))
                    kind = pa.float32() if flat.dtype == np.float32 else pa.float64()
                    for at in range(0, len(owner), OUT):
                        own = owner[at:at + OUT]
                        flat_part = x[part][own].astype(np.float32 if flat.dtype == np.float32 else np.float64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key[at:at + OUT]), pa.array(cls[rows[part]][own]), pa.array(floor[own]),
                            lists(flat_part.ravel(), np.full(len(own), width), kind),
                        ], names=["bucket", "cls", "floor", "vector"])

    return run


def _cell(keep: int):
    def run(rows: pa.Table) -> pa.Table:
        """Exact inner products of the queries and vectors of a cell: per query those of the
        best ``keep`` that reach its floor."""
        rows = rows.combine_chunks()
        probe, cls = rows["probe"].to_numpy(), rows["cls"].to_numpy()
        flat = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x = flat.astype(np.float64).reshape(len(cls), -1)
        q, c = np.flatnonzero(probe), np.flatnonzero(~probe)
        c = c[np.argsort(cls[c])]
        k = min(keep, len(c))
        least = rows["floor"].to_numpy()
        who, what, score = [], [], []
        for first in range(0, len(q) if k else 0, 256):
            part = q[first:first + 256]
            s = x[part] @ x[c].T
            # Of equal scores at the border all stay here, and the smallest ids win below.
            floor = np.maximum(np.partition(s, len(c) - k, axis=1)[:, len(c) - k], least[part] - 1e-9)
            i, j = np.nonzero(s >= floor[:, None])
            order = np.lexsort((j, -s[i, j], i))
            i, j = i[order], j[order]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            i, j = i[nth < keep], j[nth < keep]
            who.append(cls[part[i]])
            what.append(cls[c[j]])
            score.append(s[i, j])
        none = np.empty(0, np.int64)
        who, what, score = np.concatenate([none, *who]), np.concatenate([none, *what]), np.concatenate([np.empty(0), *score])
        asked, n = np.unique(who, return_counts=True)
        order = np.argsort(who, kind="stable")
        return pa.table({"query": pa.array(asked), "cls": lists(what[order], n, pa.int64()),
                         "score": lists(score[order], n, pa.float64())})

    return run


def _merged(keep: int):
    def run(rows: pa.Table) -> pa.Table:
        """The best ``keep`` different candidates of a query, from all cells it visited."""
        cls = rows["cls"].combine_chunks().flatten().to_numpy()
        score = rows["score"].combine_chunks().flatten().to_numpy()
        order = np.lexsort((cls, -score))
        cls, score = cls[order], score[order]
        first = np.sort(np.unique(cls, return_index=True)[1])[:keep]
        first = first[np.lexsort((cls[first], -score[first]))]
        return pa.table({"query": pa.array(np.repeat(rows["query"][0].as_py(), len(first))),
                         "cls": cls[first], "score": score[first]})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, neighbours: int, id_column: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``neighbours`` nearest rows found for each query.

    ``queries`` are rows of ``vectors``.  Nearness is the inner product of the original
    vectors in double precision, larger first, ties to the smaller id; a row is never its
    own neighbour.  Every row is indexed, in each table; only slot borders and the success
    estimate are fitted on a sample.  Recall is estimated, not certain: see TARGET.

    Equal vectors are hashed and compared once, as a class with its ``neighbours + 1``
    smallest ids.  A bucket is cut into chunks of vectors and of queries, so that a task is
    bounded however full a bucket is; it returns the best of each query only, and of these
    what reaches the score that so many rows of the sample reach in the buckets visited.

    Rows that are not :func:`usable`, or without id, take no part.  Vectors of different
    lengths are never neighbours.  A query that finds fewer than ``neighbours`` rows goes on
    to less likely buckets, in the end to all, until it has so many or there are no more.
    Rows with one id and different vectors count as several
    candidates; a row repeated exactly counts once.  Other columns are ignored.
    """
    spark = vectors.sparkSession
    good = lambda df: df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")) \
        .where(usable("vector") & F.col("id").isNotNull())
    rows, asked = good(vectors).distinct(), good(queries).distinct()
    lowest = Window.partitionBy("vector").orderBy("id")
    classes = materialize(
        rows.withColumn("n", F.row_number().over(lowest)).where(F.col("n") <= neighbours + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cls", F.col("ids")[0])
    )
    index = fit(classes, neighbours)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = materialize(asked.join(classes.select("vector", "cls"), "vector"))
    held = spark.sparkContext.broadcast(index)
    kind = dict(classes.dtypes)["vector"]
    schema = f"bucket long, cls long, floor double, vector {kind}"
    keep = neighbours + 1
    indexed = materialize(classes.select("cls", "vector").mapInArrow(_keyed(held, False, keep), schema))
    sizes = classes.select("cls", F.size("ids").alias("rows"), F.size("vector").alias("width"))
    there = sizes.groupBy("width").agg(F.sum("rows").alias("there"))
    todo, merged = asked.select("cls", "vector").dropDuplicates(["cls"]), None
    for share in SHARES:
        probes = materialize(todo.mapInArrow(_keyed(held, True, keep, share), schema))
        found = materialize(_compared(indexed, probes, keep))
        rows_found = found.join(sizes, "cls").groupBy("query").agg(F.sum("rows").alias("found"))
        short = materialize(
            todo.join(rows_found, F.col("cls") == F.col("query"), "left").withColumn("width", F.size("vector")).join(there, "width")
            .where(F.coalesce("found", F.lit(0)) < F.least(F.lit(keep), F.col("there"))).select("cls", "vector"))
        done = found.join(short.select(F.col("cls").alias("query")), "query", "left_anti")
        merged = done if merged is None else merged.unionByName(done)
        todo = short
        if share == SHARES[-1] or todo.isEmpty():
            break
    wide = merged.join(classes.select("cls", "ids"), "cls").select("query", F.explode("ids").alias("id"), "score")
    first = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    wide = wide.withColumn("n", F.row_number().over(first)).where(F.col("n") <= neighbours + 1)
    own = asked.select(F.col("id").alias("query_id"), F.col("cls").alias("query"))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (
        own.join(wide, "query").where("query_id <> id").withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= neighbours).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
    )


def _compared(indexed: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """(query, cls, score): the best ``keep`` classes of each query in the buckets that it visits."""

    def chunks(df, name):
        return df.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias(name))

    sizes = chunks(indexed, "parts").join(chunks(probes, "askers"), "bucket")
    draw = lambda n: F.pmod(F.xxhash64(F.lit("chunk"), "cls"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = indexed.join(sizes, "bucket").withColumn("part", draw("parts")).withColumn("asker", every("askers")) \
        .select("bucket", "part", "asker", F.lit(False).alias("probe"), "cls", "floor", "vector")
    met = met.unionByName(
        probes.join(sizes, "bucket").withColumn("asker", draw("askers")).withColumn("part", every("parts"))
        .select("bucket", "part", "asker", F.lit(True).alias("probe"), "cls", "floor", "vector"))
    best = met.groupBy("bucket", "part", "asker").applyInArrow(_cell(keep), "query long, cls array<long>, score array<double>")
    return best.groupBy("query").applyInArrow(_merged(keep), "query long, cls long, score double")


@query("op4_nearest")
def op4_nearest(spark: SparkSession, directory: str) -> DataFrame:
    vectors = table(spark, directory, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)
