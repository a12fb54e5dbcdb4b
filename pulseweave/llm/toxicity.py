"""Toxicity: linear classifiers trained by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseweave.llm.common import query, table, text_fold
from pulseweave.llm.tokens import Words, letter_words, lists, mix, runs

#: Bounds of the fit: classifiers, and positive and unlabelled documents each is trained on.
CLASSIFIERS, POSITIVES, UNLABELLED = 4, 2500, 7500
#: With fewer positives than this for each, fewer classifiers are trained.
LEAST_POSITIVES = 300
#: Letters of a stem.
STEM = 5
#: Bound of the model: words and stems a classifier looks at.
FEATURES = 1024
_STEPS, _RATE, _DECAY, _MIN_Z, _MIN_DOCS = 400, 0.1, 3e-4, 5.0, 5


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word and, for its inflections, of each word's first letters."""
    words = Words(texts, letter_words())
    doc = np.repeat(np.arange(len(texts)), words.counts)
    long = np.flatnonzero(words.ends - words.starts > STEM)
    stems = mix(words.spans(words.starts[long], words.starts[long] + STEM) + np.uint64(STEM))
    return np.concatenate([doc, doc[long]]), np.concatenate([words.hashes(), stems]).view(np.int64)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, run in runs(batch.column(2).to_pylist()):
            doc, h = features(run)
            parts = [np.unique(h[doc == k]) for k in range(len(run))]
            column = lists(np.concatenate(parts), [len(p) for p in parts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(run)), batch.column(1).slice(first, len(run)), column],
                names=["bag", "positive", "words"])


def select_words(words: list[np.ndarray], positive: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """Sorted hashes of the words whose share of documents differs most between the two sets."""
    values, at = np.unique(np.concatenate(words), return_inverse=True)
    owner = np.repeat(positive, [len(w) for w in words])
    n_p, n_u = max(positive.sum(), 1), max((~positive).sum(), 1)
    p = np.bincount(at[owner], minlength=len(values)) / n_p
    u = np.bincount(at[~owner], minlength=len(values)) / n_u
    seen = p * n_p + u * n_u
    pooled = seen / (n_p + n_u)
    z = np.abs(p - u) / np.sqrt(pooled * (1 - pooled) * (1 / n_p + 1 / n_u) + 1e-12)
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(values[best[(z[best] >= _MIN_Z) & (seen[best] >= _MIN_DOCS)]])


def train(words: list[np.ndarray], positive: np.ndarray, prior: float, most: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """(word hashes, weights, bias) of a logistic classifier under the non-negative risk.

    The risk (Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk
    Estimator") is ``prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))``: the unlabelled
    text stands for all text, so the share of positives in it is taken out again.  Where
    that difference turns negative, a step is made against it, as the authors do.
    """
    chosen = select_words(words, positive, most)
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    flat = np.concatenate(words)
    at = np.minimum(np.searchsorted(chosen, flat), max(len(chosen) - 1, 0))
    hit = chosen[at] == flat if len(chosen) else np.zeros(len(flat), bool)
    rows, cols = rows[hit], at[hit]
    w, bias = np.zeros(len(chosen)), np.log(prior / (1 - prior))
    first, second = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    n_p, n_u = positive.sum(), (~positive).sum()
    for step in range(1, _STEPS + 1):
        f = np.bincount(rows, w[cols], len(words)) + bias
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        loss = np.logaddexp(0, f)  # of the label -1
        negative = loss[~positive].mean() - prior * loss[positive].mean()
        slope = np.zeros(len(words))
        if negative >= 0:
            slope[positive] = prior * (s[positive] - 1) / n_p - prior * s[positive] / n_p
            slope[~positive] = s[~positive] / n_u
        else:
            slope[positive] = prior * s[positive] / n_p
            slope[~positive] = -s[~positive] / n_u
        g = np.append(np.bincount(cols, slope[rows], len(chosen)) + _DECAY * w, slope.sum())
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        move = _RATE * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return chosen, w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_column: str = "doc_id",
        label: str = "toxic", classifiers: int = CLASSIFIERS, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        least_positives: int = LEAST_POSITIVES, words: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Train up to ``classifiers`` classifiers, each in a task of its own, and average them.

    Positives are documents whose label is 1; unlabelled text is a draw of all documents,
    whatever their label.  The prior is the share of 1 among labelled documents.  Bounds:
    a classifier learns from about so many ``positives`` and ``unlabelled`` documents, drawn
    by a hash of the id, and weighs up to so many ``words`` and stems, those whose share
    differs most between the two; there is one classifier per ``least_positives`` positives.

    Without documents or without positives the model knows no word and scores every text
    the same.  Documents without id are not learned from; NULL and empty texts count as
    documents without words.  Documents that repeat are learned from as often.
    """
    marked = labels.where(F.col(label).isNotNull()).groupBy(id_column).agg(F.max(label).alias("__mark"))
    rows = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("__text")).where(F.col("__id").isNotNull())
    ones = marked.where(F.col("__mark") == 1).select(F.col(id_column).alias("__id"))
    share = marked.agg(F.avg((F.col("__mark") == 1).cast("double"))).first()[0]
    n_p, n_u = ones.count(), rows.count()
    if not n_p or not n_u or not share:
        return np.empty(0, np.int64), np.empty(0), -4.0
    prior = min(max(share, 1e-3), 0.9)
    bags = min(classifiers, max(1, n_p // least_positives))

    def sample(df, positive, size, n):
        draw = F.pmod(F.xxhash64(F.lit(f"draw {positive}"), "__id"), F.lit(1 << 24))
        return df.where(draw < int(min(1.0, bags * size / n) * (1 << 24)))

    def dealt(df, positive):
        bag = F.pmod(F.xxhash64(F.lit("bag"), "__id"), F.lit(bags)).cast("int")
        return df.select(bag.alias("bag"), F.lit(positive).alias("positive"), "__text")

    # Both sides are drawn before they meet, so no more texts than the sample's are shuffled.
    toxic = sample(rows, True, positives, n_p).join(sample(ones, True, positives, n_p), "__id", "left_semi")
    drawn = dealt(toxic, True).unionByName(dealt(sample(rows, False, unlabelled, n_u), False))
    drawn = drawn.mapInArrow(_words, "bag int, positive boolean, words array<long>")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        positive = pdf["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"bias": [], "words": [], "weights": []})
        known, weights, bias = train([np.asarray(x, np.int64) for x in pdf["words"]], positive, prior, words)
        return pd.DataFrame({"bias": [bias], "words": [known], "weights": [weights]})

    trained = drawn.groupBy("bag").applyInPandas(one, "bias double, words array<long>, weights array<double>").toPandas()
    if trained.empty:
        return np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior)))
    known, at = np.unique(np.concatenate([np.asarray(x, np.int64) for x in trained["words"]]), return_inverse=True)
    weights = np.bincount(at, np.concatenate(list(trained["weights"])), len(known)) / len(trained)
    return known, weights, float(trained["bias"].mean())


def chances(model: tuple, texts: list[str]) -> np.ndarray:
    """Each text's chance of being toxic, from which words and stems it holds."""
    chosen, weights, bias = model
    f = np.full(len(texts), bias)
    if len(chosen):
        doc, h = features(texts)
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        hit = np.flatnonzero(chosen[at] == h)
        present = np.unique(doc[hit] * len(chosen) + at[hit])
        f = f + np.bincount(present // len(chosen), weights[present % len(chosen)], len(texts))
    return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, run in runs(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(run)), pa.array(chances(model.value, run))],
                                                 names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """(id, score, predicted) for every row, from which words its whole text holds.

    NULL and empty texts, and texts without letters, get the score of a text without any
    telling word.  Repeated rows and NULL ids get a row each; other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    scored = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(_scored(held), "doc_id long, score double")
    return scored.select(F.col("doc_id").alias(id_column), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def harmless(docs: DataFrame, model: tuple, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that score below 0.5; texts as in :func:`score`."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, run in runs(batch.column(at).to_pylist()):
                yield batch.slice(first, len(run)).filter(pa.array(chances(held.value, run) < 0.5))

    return docs.mapInArrow(run, docs.schema)


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = table(spark, directory, "documents", "doc_id", "text")
    labels = table(spark, directory, "labels", "doc_id", "toxic")
    held_out = text_fold("doc_id", 5) == 0
    found = score(docs, fit(docs.where(~held_out), labels.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")
