"""Ranked lexical search, against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pulseweave.llm import lexical


def terms_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, best=10):
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked, found = Counter(terms_of(text)), []
        for i, c, n in counted:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t, k in asked.items() if t in c)
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:best])]
    return sorted(out, key=repr)


def corpus(seed, n=700, vocabulary=400):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    odds = [1 / (k + 1) for k in range(vocabulary)]
    topics = [rng.sample(words, 25) for _ in range(8)]
    docs = []
    for k in range(n):
        common = rng.choices(words, odds, k=rng.choice([0, 3, 20, 90]))
        docs.append((k, " ".join(common + rng.choices(rng.choice(topics), k=rng.choice([0, 5, 30])))))
    items = [(k, " ".join(rng.choices(rng.choice(topics), k=12) + rng.choices(words, odds, k=10))) for k in range(25)]
    return docs, items


AWKWARD = [(9000, None), (9001, ""), (9002, "... --- !!"), (9003, "W1 w1, W1-w2"), (9004, "Été été ÉTÉ x\x00y\x7fz a_b 漢字 w1"), (9005, "w3 " * 9000),
           (None, "w1 w2 w7"), (9006, "w1 w2 w7"), (9007, "w1 w2 w7")] + [(9100 + k, "w5 w6 only copies") for k in range(300)] + [(9100, "w5 w6 only copies")]
ITEMS = [(100, None), (101, ""), (102, "!!"), (103, "Été W1 w1 漢字 nowhere"), (104, "w5 w6"), (105, "only copies w3"), (106, "w0"), (107, "W7 w2"),
         (107, "w7 w2"), (None, "w1 w2"), (108, "w9 w8"), (108, "w9 w8"), (108, "w8 x")]


def run(spark, docs, items, **sizes):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(4)
    i = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, score int")
    return sorted((tuple(r) for r in lexical.search(d, i, **sizes).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"segment_docs": 90, "block_docs": 4}, {"segment_postings": 300, "block_docs": 1}, {"queries": 5, "block_docs": 8, "best": 3}])
def test_ranks_equal_scores_of_all_documents(spark, sizes):
    docs, items = corpus(1)
    assert run(spark, docs + AWKWARD, items + ITEMS, **sizes) == brute(docs + AWKWARD, items + ITEMS, sizes.get("best", 10))


def test_blocks_are_skipped_and_hold_similar_documents():
    docs, items = corpus(2, 3000)
    q = lexical.Queries([i for i, _ in items], [t for _, t in items])
    rows = [r for b in lexical._counted(q.terms)(iter([lexical.pa.RecordBatch.from_arrays(
        [lexical.pa.array([i for i, _ in docs]), lexical.pa.array([t for _, t in docs])], names=["doc_id", "text"])])) for r in b.to_pylist()]
    df = np.bincount([t for r in rows for t in r["terms"]], minlength=len(q.terms))
    model = lexical.Model(q, sum(r["n"] > 0 for r in rows), sum(r["n"] for r in rows), df)
    segment = lexical.Segment(model, np.array([r["doc_id"] for r in rows]), np.array([r["n"] for r in rows]), np.array([len(r["terms"]) for r in rows]),
                              np.array([t for r in rows for t in r["terms"]]), np.array([t for r in rows for t in r["tfs"]]), 8)
    found = lexical.Search(model, 10)
    found.add(segment)
    looked, skipped = found.visited
    assert skipped > looked / 5
    got = sorted((items[k][0], r + 1, int(i), int(s)) for k, (scores, ids) in enumerate(found.found) for r, (s, i) in enumerate(zip(scores, ids)))
    assert got == sorted(brute(docs, items))
    for term in range(0, len(model.weight), 17):
        columns = np.arange(term, len(model.weight), 3)
        members, begins, summary = segment.blocks(term, columns)
        for b, (low, high) in enumerate(zip(begins, [*begins[1:], len(members)])):
            want = np.zeros(len(model.weight))
            for d in members[low:high]:
                span = slice(segment.starts[d], segment.starts[d + 1])
                want[segment.terms[span]] = np.maximum(want[segment.terms[span]], segment.part[span])
            assert high - low <= 8 and (summary[b] == want[columns]).all()


def test_nothing_to_search(spark):
    docs, items = [(1, "a b")], [(1, "a")]
    assert run(spark, docs, []) == [] and run(spark, [], items) == [] and run(spark, [(1, None)], items) == [] and run(spark, docs, [(1, None)]) == []
