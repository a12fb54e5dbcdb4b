"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.graph import components
from pulseweave.llm.tokens import Words, ascii_words, lists, mix, runs
from pulseweave.session import materialize

#: Values the two permutations are drawn over; shingles are hashed onto them.
DOMAIN_BITS = 21
#: At a similarity of 0.8 all bands miss a pair once in 4 million ((1 - 0.8**6)**50).
BANDS, ROWS = 50, 6
_SEED = 20240229


@lru_cache(2)
def permutations(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation; the second one, one window of ``coordinates`` values per shift."""
    rng = np.random.default_rng(_SEED)
    size = 1 << DOMAIN_BITS
    first = rng.permutation(size).astype(np.uint32)
    second = rng.permutation(size).astype(np.uint32)
    around = np.concatenate([second, second[:coordinates]])
    return first, np.lib.stride_tricks.sliding_window_view(around, coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash (Li and Li, "C-MinHash"): coordinate k is the minimum of the second
    permutation, shifted by k, over the values that the first one gives the shingles."""
    first, windows = permutations(coordinates)
    at = first[shingles & np.uint64((1 << DOMAIN_BITS) - 1)]
    low = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(at), 256):
        np.minimum(low, windows[at[k:k + 256]].min(axis=0), out=low)
    return low


def shingle_sets(texts: list[str], words_per_shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a run."""
    words = Words(texts, ascii_words())
    h = words.hashes()
    n, w = len(h), words_per_shingle
    rolled = np.zeros(max(n, 1), np.uint64)
    factors = mix(np.arange(1, w + 1, dtype=np.uint64)) | np.uint64(1)
    for k in range(w):
        rolled[:max(n - k, 0)] += h[k:] * factors[k]
    rolled = mix(rolled)
    out, first = [], 0
    for count in words.counts:
        if count >= w:
            out.append(np.unique(rolled[first:first + count - w + 1]))
        elif count:
            terms = h[first:first + count] * factors[:count]
            out.append(mix(np.array([terms.sum(dtype=np.uint64) + np.uint64(count)])))
        else:
            out.append(np.empty(0, np.uint64))
        first += count
    return out


#: The lowest bit of 256 coordinates.  At a similarity of 0.8 a tenth of them differ on
#: average; more than SKETCH_LIMIT do once in 10 million pairs (1 at half that similarity).
SKETCH = ("k0", "k1", "k2", "k3")
SKETCH_LIMIT = 56
#: Rows up to which an open bucket is small: chance brings few texts together, so from these
#: only plausible pairs, at most this many per row, hold a group together.
SMALL_BUCKET = 32
#: Shingles and rows of a tile; a task that compares a group in full holds two tiles.
TILE_SHINGLES, TILE_ROWS = 300_000, 4096
#: Texts that meet their common candidate in one task.
HUB_TEXTS = 128
#: Rows of 64 bits of the filter that picks the texts of candidates; it is broadcast, and as
#: large for any number of documents.
FILTER_ROWS = 1 << 18

SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, k0 long, k1 long, k2 long, k3 long, bands array<long>"


def _signed(words_per_shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = mix(np.arange(101, 101 + rows, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, run in runs(texts):
                sets = shingle_sets(run, words_per_shingle)
                sizes = np.array([len(s) for s in sets], np.int64)
                low = np.stack([signature(s, max(bands * rows, 256)) for s in sets])
                sketch = np.packbits((low[:, :256] & 1).astype(np.uint8), axis=1).view(np.int64)
                low = low[:, :bands * rows].reshape(len(sets), bands, rows)
                keys = mix((low.astype(np.uint64) * factors).sum(axis=2, dtype=np.uint64)
                           + np.arange(bands, dtype=np.uint64))
                keys = keys[sizes > 0].view(np.int64).ravel()
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                b = np.array([mix(s + np.uint64(7)).sum(dtype=np.uint64) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(first, len(run)), pa.array(sizes), pa.array(a.view(np.int64)),
                    pa.array(b.view(np.int64)), *[pa.array(np.ascontiguousarray(k)) for k in sketch.T], lists(keys, np.where(sizes > 0, bands, 0), pa.int64()),
                ], names=["doc_id", "n_shingles", "set_a", "set_b", *SKETCH, "bands"])

    return run


def _hub(words_per_shingle: int, percent: int):
    def run(rows: pa.Table) -> pa.Table:
        """The texts of a chunk that are similar enough to one of their common candidate's."""
        rows = rows.combine_chunks()
        hub, ids = rows["a"][0].as_py(), rows["doc_id"].to_numpy()
        sets = [s for _, run in runs(rows["text"].to_pylist()) for s in shingle_sets(run, words_per_shingle)]
        own = [s for k, s in zip(ids, sets) if k == hub]
        found = sorted({k for k, s in zip(ids.tolist(), sets) if k != hub and any(_similar(x, s, percent) for x in own)})
        return pa.table({"a": pa.array([hub] * len(found), pa.int64()), "b": pa.array(found, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words_per_shingle: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS, small_bucket: int = SMALL_BUCKET,
                    tile_shingles: int = TILE_SHINGLES, tile_rows: int = TILE_ROWS, hub_texts: int = HUB_TEXTS,
                    filter_rows: int = FILTER_ROWS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs without ASCII white space, A-Z in lower case; a document is the set of
    its distinct shingles of ``words_per_shingle`` words, or of its whole word sequence
    when that is shorter.  Documents are linked when ``100 * intersection >= percent *
    union``; ``component_id`` is the smallest id reachable by links, ``kept`` marks it.

    1. One pass computes every document's set size, two checksums of its set, a sketch of
       256 bits and its band keys.  Documents with equal sets form a class and go on as
       their smallest id.
    2. In each bucket (band, key), every class has the smallest id of the bucket as a
       candidate, and is compared with the smallest of its candidates: one pair per class,
       however large its buckets are.  Classes that are alone in a bucket leave it at once.
    3. Where that leaves a bucket with several components, its rows stay open.  Open rows
       that share large buckets or are plausible pairs of small ones, directly or through
       others, form a group, which is dealt into
       tiles of bounded size; every pair of tiles is a task that compares its rows across
       components, all of them, and returns no more than one link per pair of components.
    So in a bucket only pairs that links already connect stay untested.  A candidate is
    dropped untested only where sizes or sketches exclude the similarity, see SKETCH_LIMIT;
    the others are confirmed on the full sets (as 64-bit hashes of shingles).  The work
    grows with the square of an open group, which are texts that nearly reach the
    similarity; no pair of it is ever a row.

    NULL, empty and blank texts have an empty set and link with nothing.  Rows without id
    keep a NULL component and are kept.  Rows that share an id count as one node: each gets
    a row, with the component of the smallest of their classes.  Other columns are ignored.
    """
    narrow = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = materialize(narrow.mapInArrow(_signed(words_per_shingle, bands, rows), SIGNED))
    same_set = ["n_shingles", "set_a", "set_b"]
    usable = F.expr("n_shingles > 0 and doc_id is not null")
    classes = materialize(signed.where(usable).groupBy(*same_set).agg(F.min("doc_id").alias("doc_id")))
    firsts = signed.join(classes, ["doc_id", *same_set], "left_semi").dropDuplicates(["doc_id", *same_set])
    # One shuffle by bucket serves the minimum and the join; most rows are alone and end here.
    dealt = firsts.select("doc_id", F.explode("bands").alias("bucket")).repartition("bucket")
    shared = dealt.groupBy("bucket").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b")
    members = materialize(dealt.join(shared.select("bucket", "a"), "bucket"))
    sketches = firsts.select("doc_id", "n_shingles", *SKETCH)
    texts = narrow.where("doc_id is not null")

    pairs = members.where("doc_id > a").select("a", F.col("doc_id").alias("b")).distinct()
    members = members.drop("a")
    x, y = sketches.alias("x"), sketches.alias("y")
    tested = materialize(
        pairs.join(x, F.col("a") == F.col("x.doc_id"))
        .join(y, (F.col("b") == F.col("y.doc_id")) & _plausible("x", "y", percent))
        .groupBy("b").agg(F.min("a").alias("a"))
    )
    links = materialize(_confirm(tested, texts, words_per_shingle, percent, hub_texts, filter_rows))
    found = components(links, "a", "b")
    rest = materialize(_apart(members, found).join(sketches, "doc_id"))
    buckets = rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("low"))
    small = rest.join(buckets.where(F.col("rows") <= small_bucket).select("bucket"), "bucket", "left_semi")
    x, y = small.alias("x"), small.alias("y")
    ties = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component"))
                  & _plausible("x", "y", percent)).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b"))
    large = buckets.where(F.col("rows") > small_bucket)
    ties = ties.unionByName(rest.join(large, "bucket").select(F.col("low").alias("a"), F.col("doc_id").alias("b"))).distinct()
    near = components(ties, "a", "b").select(F.col("node").alias("doc_id"), F.col("component").alias("group"))
    open_rows = materialize(rest.select("doc_id", "component", "n_shingles", *SKETCH).distinct().join(near, "doc_id"))
    needed = F.greatest(F.sum("n_shingles") / tile_shingles, F.count(F.lit(1)) / tile_rows)
    tiles = open_rows.groupBy("group").agg(F.ceil(needed).cast("int").alias("tiles"))
    paired = (
        open_rows.join(_candidates(texts, open_rows.select("doc_id"), filter_rows), "doc_id").join(tiles, "group")
        .withColumn("tile", F.pmod(F.xxhash64(F.lit("tile"), "doc_id"), F.col("tiles")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("group", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
                "tile", "doc_id", "component", "n_shingles", *SKETCH, "text")
    )
    more = paired.groupBy("group", "first", "second").applyInArrow(_tile_links(words_per_shingle, percent), "a long, b long")
    found = components(links.unionByName(more), "a", "b")
    classes = classes.join(found, classes.doc_id == found.node, "left").select(
        *same_set, F.coalesce("component", "doc_id").alias("component_id"))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return signed.select("doc_id", *same_set).join(classes, same_set, "left").select(
        F.col("doc_id").alias(id_column), "n_shingles", own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    big, small = (a, b) if len(a) >= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(big):
        return False
    at = np.minimum(np.searchsorted(big, small), len(big) - 1)
    both = int((big[at] == small).sum())
    return 100 * both >= percent * (len(big) + len(small) - both)


def _tile_links(words_per_shingle: int, percent: int):
    limit = SKETCH_LIMIT if percent >= 80 else 256

    def run(rows: pa.Table) -> pa.Table:
        """Links between rows of two tiles that join components, a forest of them."""
        rows = rows.combine_chunks()
        ids, sizes = rows["doc_id"].to_numpy(), rows["n_shingles"].to_numpy()
        component = rows["component"].to_numpy().tolist()
        sketch = np.stack([rows[k].to_numpy() for k in SKETCH], axis=1).view(np.uint64)
        sets = [s for _, run in runs(rows["text"].to_pylist()) for s in shingle_sets(run, words_per_shingle)]
        tile = rows["tile"].to_numpy()
        left = np.flatnonzero(tile == rows["first"][0].as_py())
        right = np.flatnonzero(tile == rows["second"][0].as_py())
        parent = {c: c for c in component}

        def root(c):
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        a, b = [], []
        for first in range(0, len(left), 128):
            part = left[first:first + 128]
            differ = np.bitwise_count(sketch[part, None] ^ sketch[right]).sum(axis=2)
            low, high = np.minimum(sizes[part, None], sizes[right]), np.maximum(sizes[part, None], sizes[right])
            for i, j in np.argwhere((differ <= limit) & (100 * low >= percent * high)).tolist():
                i, j = int(part[i]), int(right[j])
                x, y = root(component[i]), root(component[j])
                if x != y and _similar(sets[i], sets[j], percent):
                    parent[max(x, y)] = min(x, y)
                    a.append(ids[i])
                    b.append(ids[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _plausible(x: str, y: str, percent: int):
    """Whether sizes and sketches leave room for the similarity."""
    n = [F.col(f"{side}.n_shingles") for side in (x, y)]
    differ = sum((F.bit_count(F.col(f"{x}.{k}").bitwiseXOR(F.col(f"{y}.{k}"))) for k in SKETCH), F.lit(0))
    limit = SKETCH_LIMIT if percent >= 80 else 256
    return (100 * F.least(*n) >= percent * F.greatest(*n)) & (differ <= limit)


def _apart(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members, with their components, of the buckets that hold several components."""
    labelled = members.join(found, members.doc_id == found.node, "left").select(
        *members.columns, F.coalesce("component", "doc_id").alias("component"))
    apart = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")) \
        .where("low < high").select("bucket")
    return labelled.join(apart, "bucket", "left_semi")


def _candidates(texts: DataFrame, ids: DataFrame, rows: int) -> DataFrame:
    """The texts of the documents ``ids`` and, by chance, of some others.

    ``ids`` become a filter of ``rows`` times 64 bits, whatever their number, so texts
    that no one asks for are passed over where they are read.  A join on the ids follows.
    """
    h = F.xxhash64(F.lit("filter"), "doc_id")
    slot, bit = F.pmod(F.shiftright(h, 6), F.lit(rows)), F.pmod(h, F.lit(64)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bits = ids.select(slot.alias("__slot"), mask.alias("__bit")).groupBy("__slot").agg(F.bit_or("__bit").alias("__bits"))
    passed = texts.withColumns({"__slot": slot, "__place": bit}).join(F.broadcast(materialize(bits)), "__slot")
    return passed.where(F.getbit("__bits", F.col("__place")) == 1).select(*texts.columns)


def _confirm(pairs: DataFrame, texts: DataFrame, words_per_shingle: int, percent: int, hub_texts: int,
             filter_rows: int) -> DataFrame:
    """The candidate pairs (a, b), one per b, whose sets are similar enough.

    Each text of a pair is told its group, which is its candidate ``a`` and a chunk of the
    texts that have it, and moves there; the candidate's own text is copied to its chunks.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / hub_texts).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "b"), F.col("chunks")).cast("int")
    routes = pairs.join(sizes, "a").select(F.col("b").alias("doc_id"), "a", chunk.alias("chunk")).unionByName(
        sizes.select(F.col("a").alias("doc_id"), "a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    met = _candidates(texts, routes.select("doc_id"), filter_rows).join(routes, "doc_id").select("a", "chunk", "doc_id", "text")
    return met.groupBy("a", "chunk").applyInArrow(_hub(words_per_shingle, percent), "a long, b long").distinct()


_ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b
  WHERE 100 * n >= 80 * (len(p.s) + len(q.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM sets UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.v),
low AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sets JOIN low ON v = doc_id
"""


@query("op9_minhash", _ORACLE)
def op9_minhash(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(table(spark, directory, "documents", "doc_id", "text"), words_per_shingle=2)
