"""Ranked lexical search over posting lists cut into blocks of similar documents."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table
from pulseweave.llm.tokens import Words, lists, runs
from pulseweave.session import materialize

#: Queries that are answered in one pass, on average; more take further passes.
QUERIES = 256
#: Documents and postings after which a segment is closed; documents of a block.
SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK_DOCS = 8192, 1 << 21, 64
#: Dimensions of the sketches by which documents are called similar.
SKETCH = 24
BEST = 10
_AT_ONCE = 1 << 16


@lru_cache
def alphanumeric_words() -> tuple[np.ndarray, np.ndarray]:
    """Tables for terms: everything but ASCII that is no letter or digit, with A-Z in lower case."""
    word = np.ones(0x110000, bool)
    for low, high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        word[low:high + 1] = False
    lower = np.arange(0x110000, dtype=np.uint32)
    lower[0x41:0x5B] += 32
    return word, lower


class Queries:
    """A bounded set of queries: their different terms as sorted hashes, and how often each has which."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashes, owner = [], []
        for first, run in runs(texts):
            words = Words(run, alphanumeric_words())
            hashes.append(words.hashes())
            owner.append(first + np.repeat(np.arange(len(run)), words.counts))
        empty = np.zeros(0, np.uint64)
        self.ids = ids
        self.terms, term = np.unique(np.concatenate([empty, *hashes]), return_inverse=True)
        owners = np.concatenate([np.zeros(0, np.int64), *owner])
        pairs, self.counts = np.unique(owners * max(len(self.terms), 1) + term, return_counts=True)
        self.owner, self.term = np.divmod(pairs, max(len(self.terms), 1))


# Documents as counts of the queries' terms


def _counted(terms: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, part in runs(texts):
                words = Words(part, alphanumeric_words())
                h = words.hashes()
                at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
                known = np.flatnonzero(terms[at] == h)
                doc = np.repeat(np.arange(len(part)), words.counts)[known]
                pairs, tf = np.unique(doc * len(terms) + at[known], return_counts=True)
                doc, term = np.divmod(pairs, len(terms))
                per_doc = np.bincount(doc, minlength=len(part))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(part)), pa.array(words.counts.astype(np.int64)),
                    lists(term.astype(np.int32), per_doc, pa.int32()), lists(tf.astype(np.int32), per_doc, pa.int32()),
                ], names=["doc_id", "n", "terms", "tfs"])

    return run


def _frequencies(n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(df[held])], names=["term", "df"])

    return run


# A segment


class Model:
    """What scores need of the whole corpus.  Terms are numbered by falling weight from here on."""

    def __init__(self, queries: Queries, n_docs: int, n_terms: int, df: np.ndarray):
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        order = np.argsort(-weight, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.weight, self.n_docs, self.n_terms = weight[order], n_docs, n_terms
        self.ids = queries.ids
        term = self.rank[queries.term]
        by_query = np.lexsort((term, queries.owner))
        self.owner, self.term, self.count = queries.owner[by_query], term[by_query], queries.counts[by_query].astype(np.int64)
        self.starts = np.searchsorted(self.owner, np.arange(len(self.ids) + 1))
        by_term = np.argsort(self.term, kind="stable")
        self.asking, self.asking_counts = self.owner[by_term], self.count[by_term]  # queries that have a term, by term
        self.asking_starts = np.searchsorted(self.term[by_term], np.arange(len(order) + 1))

    def saturation(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 25 + 75 * n * self.n_docs // self.n_terms
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Segment:
    """Posting lists of a bounded run of documents; a list's blocks are made when a query first needs them."""

    def __init__(self, model: Model, doc_ids: np.ndarray, n: np.ndarray, per_doc: np.ndarray, terms: np.ndarray, tfs: np.ndarray,
                 block_docs: int):
        self.model, self.doc_ids, self.block_docs = model, doc_ids, block_docs
        self.owner = np.repeat(np.arange(len(n)), per_doc)
        self.starts = np.concatenate([[0], np.cumsum(per_doc)])
        self.terms = model.rank[terms]
        self.part = model.saturation(tfs.astype(np.int64), n[self.owner].astype(np.int64))
        by_term = np.argsort(self.terms, kind="stable")
        self.posted = self.owner[by_term]
        self.list_starts = np.searchsorted(self.terms[by_term], np.arange(len(model.weight) + 1))
        self.most = np.zeros(len(model.weight), np.int64)  # of a term in any document here
        self.column = np.full(len(model.weight), -1, np.int64)
        filled = np.flatnonzero(np.diff(self.list_starts))
        if len(filled):
            self.most[filled] = np.maximum.reduceat(self.part[by_term], self.list_starts[filled])
        signs = np.random.default_rng(11).choice([-1.0, 1.0], (len(model.weight), SKETCH)).astype(np.float32)
        weighed = (model.weight[self.terms] * self.part).astype(np.float32)
        self.sketch = np.zeros((len(n), SKETCH), np.float32)
        some = np.flatnonzero(per_doc)
        if len(some):
            for docs in np.split(some, np.flatnonzero(np.diff(self.starts[some] // _AT_ONCE)) + 1):
                a, b = self.starts[docs[0]], self.starts[docs[-1] + 1]
                self.sketch[docs] = np.add.reduceat(signs[self.terms[a:b]] * weighed[a:b, None], self.starts[docs] - a)
            self.sketch[some] /= np.maximum(np.linalg.norm(self.sketch[some], axis=1, keepdims=True), 1e-9)

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of all entries of ``docs``, where each document's begin among them)."""
        size = self.starts[docs + 1] - self.starts[docs]
        begin = np.cumsum(size) - size
        return np.repeat(self.starts[docs] - begin, size) + np.arange(size.sum()), begin

    def blocks(self, term: int, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents of a list block by block, where each block begins, and the blocks' summaries.

        Documents go to the nearest of as many pivots as the list fills blocks, by their
        sketches; a crowd around one pivot is cut into blocks.  A summary has the largest
        part that any document of the block has in each of the terms ``columns``, those
        that the queries at hand can ask for.
        """
        docs = self.posted[self.list_starts[term]:self.list_starts[term + 1]]
        begins = np.zeros(1, np.int64)
        if len(docs) > self.block_docs:
            pivots = docs[::self.block_docs]
            nearest = np.argmax(self.sketch[docs] @ self.sketch[pivots].T, axis=1)
            order = np.argsort(nearest, kind="stable")
            docs, nearest = docs[order], nearest[order]
            first = np.searchsorted(nearest, np.arange(len(pivots)))
            place = np.arange(len(docs)) - first[nearest]
            begins = np.flatnonzero(place % self.block_docs == 0)
        at, begin = self.entries(docs)
        size = np.diff(np.append(begin, len(at)))
        self.column[columns] = np.arange(len(columns))
        column = self.column[self.terms[at]]
        self.column[columns] = -1
        wanted = np.flatnonzero(column >= 0)
        block = np.repeat(np.searchsorted(begins, np.arange(len(docs)), side="right") - 1, size)
        summary = np.zeros(len(begins) * len(columns))
        np.maximum.at(summary, block[wanted] * len(columns) + column[wanted], self.part[at[wanted]])
        return docs, begins, summary.reshape(-1, len(columns))

    def scores(self, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Exact scores of ``docs``, each of which has a term; ``counts`` by term."""
        at, begin = self.entries(docs)
        t = self.terms[at]
        return np.add.reduceat(counts[t] * self.model.weight[t] * self.part[at], begin)


class Search:
    """The best documents of each query so far, over segment after segment."""

    def __init__(self, model: Model, best: int):
        self.model, self.best = model, best
        n = len(model.ids)
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(n)]
        self.least = np.ones(n, np.int64)  # what a score must reach to count
        self.visited = [0, 0]  # blocks looked at, blocks skipped

    def add(self, segment: Segment) -> None:
        """Look for better documents in a segment; lists by falling weight of their terms.

        ``left`` bounds the score of a document that has none of a query's terms passed so
        far.  A document of the present list that has one was met there, so in a block's
        bound only the terms from here on count.  Bounds are sums of whole numbers in
        doubles, widened by more than they can be rounded; what reaches the least score
        that counts is scored exactly.
        """
        model = self.model
        gain = model.count * model.weight[model.term] * segment.most[model.term]
        left = np.bincount(model.owner, weights=gain, minlength=len(model.ids))
        passed = np.zeros(len(model.ids))
        counts, scored = {}, {}
        for term in np.flatnonzero(segment.most):
            a, b = model.asking_starts[term], model.asking_starts[term + 1]
            asking = model.asking[a:b]
            reach = (left[asking] - passed[asking]) * (1 + 1e-9) + 1
            active = asking[reach >= self.least[asking]]
            if len(active) and model.weight[term] > 0:
                for q in set(active.tolist()).difference(counts):
                    own = slice(model.starts[q], model.starts[q + 1])
                    counts[q] = np.zeros(len(model.weight), np.int64)
                    counts[q][model.term[own]] = model.count[own]
                    scored[q] = np.zeros(len(segment.doc_ids), bool)
                own = {q: model.term[model.starts[q]:model.starts[q + 1]] for q in active.tolist()}
                own = {q: terms[np.searchsorted(terms, term):] for q, terms in own.items()}
                columns = np.unique(np.concatenate(list(own.values())))
                docs, begins, summary = segment.blocks(term, columns)
                ends = np.append(begins[1:], len(docs))
                for q, terms in own.items():
                    gains = (counts[q][terms] * model.weight[terms]).astype(np.float64)
                    bound = summary[:, np.searchsorted(columns, terms)] @ gains
                    take = bound * (1 + 1e-9) + 1 >= self.least[q]
                    self.visited[0] += len(begins)
                    self.visited[1] += int((~take).sum())
                    if not take.any():
                        continue
                    chosen = docs if take.all() else docs[np.repeat(take, ends - begins)]
                    chosen = chosen[~scored[q][chosen]]
                    if len(chosen):
                        scored[q][chosen] = True
                        self._keep(q, segment.scores(chosen, counts[q]), segment.doc_ids[chosen])
            passed[asking] += model.asking_counts[a:b] * float(model.weight[term] * segment.most[term])

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        enough = scores >= self.least[q]
        scores, ids = np.concatenate([self.found[q][0], scores[enough]]), np.concatenate([self.found[q][1], ids[enough]])
        order = np.lexsort((ids, -scores))[:self.best]
        self.found[q] = scores[order], ids[order]
        if len(order) == self.best:
            self.least[q] = scores[order[-1]]


_NO_ID = np.iinfo(np.int64).max
_FOUND = "query int, doc_id long, score long"


def _searched(model: Model, best: int, segment_docs: int, segment_postings: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, held, docs, postings = Search(model, best), [], 0, 0

        def close():
            ids, n, per_doc, terms, tfs = (np.concatenate(c) for c in zip(*held))
            search.add(Segment(model, ids, n, per_doc, terms, tfs, block_docs))
            held.clear()

        for batch in batches:
            ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            terms, tfs = batch.column(2), batch.column(3)
            held.append((ids, batch.column(1).to_numpy(), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
            docs, postings = docs + len(ids), postings + len(held[-1][3])
            if docs >= segment_docs or postings >= segment_postings:
                close()
                docs = postings = 0
        if held:
            close()
        for q, (scores, ids) in enumerate(search.found):
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(scores), q, np.int32)), pa.array(ids, mask=ids == _NO_ID), pa.array(scores),
                ], names=["query", "doc_id", "score"])

    return run


# Jobs


def search(docs: DataFrame, items: DataFrame, best: int = BEST, doc_id: str = "doc_id", doc_text: str = "text",
           item_id: str = "item_id", item_text: str = "text", queries: int = QUERIES, segment_docs: int = SEGMENT_DOCS,
           segment_postings: int = SEGMENT_POSTINGS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``best`` documents of each item, see :func:`op11_lexical`.

    Items are answered in passes of about ``queries``, whose terms alone the driver
    holds.  A pass reads every whole text once and stores the documents as counts of the
    pass's terms, gathers the sums and document frequencies from that table, and searches
    it where it lies: each task cuts its documents into bounded segments, each segment
    has posting lists in blocks of similar documents, and lists are visited by falling
    weight until no unmet document can count.  A block is skipped only if its summary,
    the largest part of every term in it, can't reach the least score that counts.
    Postings are never shuffled; what a task returns are ``best`` rows per query.

    A NULL or empty text has no term: such a document takes no part and such an item gets no
    row.  Repeated documents are ranked each; a document without id comes after those of
    equal score.  Items that repeat entirely are answered once, items that share an id
    with different texts each on their own.  Documents or items without rows give an empty result.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).distinct()
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text"))
    passes = max(1, -(-asked.count() // queries))
    found = []
    for k in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).sort("item_id", "text").collect()
        asked_now = Queries([r.item_id for r in rows], [r.text for r in rows])
        if not len(asked_now.terms):
            continue
        index = materialize(corpus.mapInArrow(_counted(asked_now.terms), "doc_id long, n long, terms array<int>, tfs array<int>"))
        n_docs, n_terms = index.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not n_docs:
            break
        df = np.zeros(len(asked_now.terms), np.int64)
        frequent = index.select("terms").mapInArrow(_frequencies(len(df)), "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
        frequent = frequent.toPandas()  # a row per term of this pass
        df[frequent["term"]] = frequent["df"]
        model = Model(asked_now, n_docs, n_terms, df)
        names = spark.createDataFrame(list(enumerate(asked_now.ids)), "query int, item_id long")
        some = index.where("n > 0").mapInArrow(_searched(model, best, segment_docs, segment_postings, block_docs), _FOUND)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
        found.append(ranked.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
        if passes > 1:
            found[-1] = materialize(found[-1])
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ORACLE = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY ALL),
stats AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
asked AS (SELECT item_id, term, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), stats),
scored AS (
  SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (doc_id), stats GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


@query("op11_lexical", _ORACLE)
def op11_lexical(spark: SparkSession, directory: str) -> DataFrame:
    """Each item's ten documents of highest score above 0, equal scores by ascending doc_id.

    A term of weight w = floor(1000 ln((2 N + 2) / (2 df + 1))) that a document of n terms
    has tf times adds w * (10^9 tf div (1000 tf + 8 m)), m = 25 + 75 n N div L, for each
    time the item has it.
    """
    return search(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "benchmark", "item_id", "text"))
