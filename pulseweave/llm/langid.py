"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table, text_fold
from pulseweave.llm.tokens import Words, letter_words, mix, runs
from pulseweave.session import materialize

#: Bound of the fit: about so many documents of each language, chosen by a hash of the id.
DOCS_PER_LANGUAGE = 1500
#: Bound of the model: so many words, and n-grams of each order, of each language.
FEATURES = 50_000
#: Bound of the scores, texts times languages, held at once.
CELLS = 1 << 20
#: A feature is known from so many occurrences on, unless its language has none of that order that often.
MIN_COUNT = 2
ORDERS = (4, 3, 2, 1)
WORD = 0
UNKNOWN = "und"
_SMOOTH = 0.5


def grams(words: Words, which: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``which``, hash) of all n-grams of ``order`` letters of the chosen words."""
    n = words.ends[which] - words.starts[which] - order + 1
    n = np.maximum(n, 0)
    owner = np.repeat(np.arange(len(which)), n)
    first = np.repeat(np.cumsum(n) - n, n)
    at = words.starts[which][owner] + np.arange(len(owner)) - first
    return owner, words.spans(at, at + order)


def _tagged(h: np.ndarray, order: int) -> np.ndarray:
    return mix(h + np.uint64(order * 0x9E3779B9)).view(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in dict.fromkeys(langs):
            for _, run in runs([t for t, x in zip(texts, langs) if x == lang]):
                words = Words(run, letter_words())
                everything = np.arange(len(words.starts))
                for order in (WORD, *ORDERS):
                    h = words.hashes() if order == WORD else grams(words, everything, order)[1]
                    values, counts = np.unique(_tagged(h, order), return_counts=True)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), order, np.int32)),
                        pa.array(values), pa.array(counts.astype(np.int64)),
                    ], names=["lang", "n", "feature", "count"])


class Model:
    """Per order: sorted feature hashes, for each the languages that have it and their gains.

    A known feature is worth ``log((count + s) / (total + s * size))`` in a language; the
    part without a count is the language's floor, the rest is the gain.
    """

    def __init__(self, counts, languages: list[str]):
        self.languages = languages
        self.tables = {}
        number = {x: k for k, x in enumerate(languages)}
        for order in (WORD, *ORDERS):
            rows = counts[counts["n"] == order].sort_values(["feature", "lang"])
            lang = rows["lang"].map(number).to_numpy(np.int64)
            count = rows["count"].to_numpy(np.float64)
            features, first = np.unique(rows["feature"].to_numpy(np.int64), return_index=True)
            total = np.bincount(lang, count, len(languages)) + _SMOOTH * max(len(features), 1)
            self.tables[order] = (
                features, np.append(first, len(rows)), lang.astype(np.int32),
                np.log((count + _SMOOTH) / _SMOOTH).astype(np.float32), np.log(_SMOOTH / total),
            )

    def look_up(self, h: np.ndarray, order: int) -> np.ndarray:
        """Number of each feature in the table of ``order``, or -1."""
        features = self.tables[order][0]
        if not len(features):
            return np.full(len(h), -1)
        tagged = _tagged(h, order)
        at = np.minimum(np.searchsorted(features, tagged), len(features) - 1)
        return np.where(features[at] == tagged, at, -1)

    def gains(self, found: np.ndarray, owner: np.ndarray, owners: int, order: int,
              weights: np.ndarray | None = None) -> np.ndarray:
        """Summed gains (owners x languages) of the features ``found``, without the floors."""
        _, first, lang, gain, _ = self.tables[order]
        hit = found >= 0
        found, owner = found[hit], owner[hit]
        n = first[found + 1] - first[found]
        row = np.repeat(np.arange(len(found)), n)
        at = first[found][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        value = gain[at].astype(np.float64)
        if weights is not None:
            value *= weights[hit][row]
        size = len(self.languages)
        summed = np.bincount(owner[row] * size + lang[at], value, owners * size)
        return summed.astype(np.float64).reshape(owners, size)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood of a word in each language, and the number of words, per text."""
        words = Words(texts, letter_words())
        doc = np.repeat(np.arange(len(texts)), words.counts)
        found = self.look_up(words.hashes(), WORD)
        total = self.gains(found, doc, len(texts), WORD)
        total += np.bincount(doc[found >= 0], minlength=len(texts))[:, None] * self.tables[WORD][4]
        open_words = np.flatnonzero(found < 0)
        for order in ORDERS:
            # The longest order of which an open word has a known n-gram scores the word, by the mean of its n-grams.
            owner, h = grams(words, open_words, order)
            found = self.look_up(h, order)
            n = np.bincount(owner, minlength=len(open_words))
            known = np.bincount(owner[found >= 0], minlength=len(open_words)) > 0
            own_doc = doc[open_words]
            use = known[owner]
            total += self.gains(found[use], own_doc[owner[use]], len(texts), order, 1.0 / n[owner[use]])
            total += np.bincount(own_doc[known], minlength=len(texts))[:, None] * self.tables[order][4]
            open_words = open_words[~known]
        return total / np.maximum(words.counts, 1)[:, None], words.counts


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id",
        docs_per_language: int = DOCS_PER_LANGUAGE, features: int = FEATURES, min_count: int = MIN_COUNT) -> Model:
    """Fit on rows with text and language: a sample of about ``docs_per_language`` of each.

    The sample is taken by a hash of the id, so it is the same in every run.  Counting is
    a Spark aggregation.  Per language and order the model has the ``features`` most
    frequent ones of at least ``min_count`` occurrences; a language that has none so
    frequent keeps its most frequent ones, so every language whose sample has a letter is
    learned.  So many rows per language reach the driver, whose memory grows with the
    number of languages and nothing else.  Rows without id share one draw.
    """
    docs = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # Drawn by a broadcast row per language, so that only the sample is ever shuffled.
    share = F.least(F.lit(1.0), F.lit(float(docs_per_language)) / F.count(F.lit(1)))
    limits = docs.groupBy(F.col(lang).alias("__lang")).agg(F.floor(share * (1 << 20)).alias("__limit"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(id_column)), F.lit(1 << 20))
    drawn = docs.join(F.broadcast(limits), (F.col(lang) == F.col("__lang")) & (draw < F.col("__limit")))
    sample = drawn.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = sample.mapInArrow(_counted, "lang string, n int, feature long, count long") \
        .groupBy("lang", "n", "feature").agg(F.sum("count").alias("count"))
    counts = materialize(counts)
    most = counts.groupBy("lang", "n").agg(F.max("count").alias("most"))
    counts = counts.join(most, ["lang", "n"]).where(F.col("count") >= F.least(F.lit(min_count), F.col("most"))).drop("most")
    place = Window.partitionBy("lang", "n").orderBy(F.col("count").desc(), "feature")
    counts = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= features).drop("place").toPandas()
    return Model(counts, sorted(counts["lang"].unique()))


def decide(m: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score."""
    if not m.languages:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    step = max(1, CELLS // len(m.languages))
    if len(texts) > step:
        parts = [decide(m, texts[at:at + step]) for at in range(0, len(texts), step)]
        return [x for pred, _ in parts for x in pred], np.concatenate([conf for _, conf in parts])
    mean, n = m.scores(texts)
    share = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, 20)[:, None])
    best = mean.argmax(axis=1)
    return [m.languages[b] if k else UNKNOWN for b, k in zip(best, n)], np.where(n > 0, 1.0 / share.sum(axis=1), 0.0)


def _predicted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, run in runs(texts):
                pred, conf = decide(model.value, run)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(run)), pa.array(pred, pa.string()), pa.array(conf)],
                    names=["doc_id", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score) for every row, from its whole text.

    A text that is NULL or has no letter is ``und`` with score 0, and so is every text if
    nothing could be learned.  Ties go to the language first in order.  The score is the
    share of the winner's likelihood, with words beyond 20 weighing as if there were 20.
    Rows that repeat, also with NULL ids, get a row each; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_predicted(held), "doc_id long, lang_pred string, score double") \
        .withColumnRenamed("doc_id", id_column)


def identified(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in runs(batch.column(at).to_pylist()):
                pred, conf = decide(held.value, run)
                keep = np.array([p != UNKNOWN for p in pred]) & (conf >= least)
                yield batch.slice(first, len(run)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


@query("op5_language")
def op5_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents", "doc_id", "text", "lang")
    held_out = text_fold("doc_id", 4) == 2
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
