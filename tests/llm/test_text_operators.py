"""Language, toxicity, near duplicates and segmentation, against brute force and awkward rows."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.llm import langid, minhash, pieces, tokens, toxicity

DOCS = "doc_id long, text string, lang string, source string, score string, component_id string, words string"


def docs_of(spark, texts, langs=None):
    rows = [(k, t, (langs or {}).get(k), "s", "x", "y", "z") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def sets_of(text, k):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_components(texts, k, percent=80):
    sets = [sets_of(t, k) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return [(k, len(sets[k]), root(k), root(k) == k) for k in range(len(texts))]


def near_copies(seed, groups=6, copies=12, length=80):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(length)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(0, 9)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    rng.shuffle(texts)
    return texts


AWKWARD = [None, "", " \t\n", "one", "ONE", "one two", " ", "É é", "x" * 30_000, ("ab " * 9000).strip(), ("ab " * 9000)]


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    texts = near_copies(k) + AWKWARD + near_copies(k)[:3]
    found = minhash.near_duplicates(docs_of(spark, texts), words_per_shingle=k)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect())) == brute_components(texts, k)


@pytest.mark.parametrize("sizes", [
    {"small_bucket": 1, "tile_shingles": 400}, {"small_bucket": 3, "tile_rows": 2, "hub_texts": 1}, {"filter_rows": 1, "hub_texts": 5},
])
def test_near_duplicates_in_large_buckets_and_many_tiles(spark, sizes):
    """Groups in which few pairs are similar enough, so that much is left open after the first candidates."""
    rng, texts = random.Random(3), []
    for _ in range(4):
        base = [f"w{rng.randrange(300)}" for _ in range(90)]
        for _ in range(30):
            own = list(base)
            for k in rng.sample(range(90), rng.randrange(0, 7)):
                own[k] = f"w{rng.randrange(300)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    found = minhash.near_duplicates(docs_of(spark, texts), words_per_shingle=2, **sizes)
    want = brute_components(texts, 2)
    assert sorted(map(tuple, found.collect())) == want
    assert 4 < len({c for _, _, c, _ in want}) < 100


def test_near_duplicates_without_ids_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")],
                               "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(df, words_per_shingle=2).collect()), key=repr)
    assert got == sorted([(1, 5, 1, True), (1, 5, 1, True), (None, 5, None, True), (2, 5, 1, False)], key=repr)
    assert minhash.near_duplicates(df.where("false")).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    whole = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    a, b = minhash.signature(whole[:300], 300), minhash.signature(whole[100:], 300)
    assert abs((a == b).mean() - 0.5) < 0.12


def test_words_match_a_pattern():
    texts = ["Ab c d", "", "x\ny\x0bZ", " lead", "é É"]
    words = tokens.Words(texts, tokens.ascii_words())
    got = np.split(words.hashes(), np.cumsum(words.counts)[:-1])
    same = {}
    for text, hashes in zip(texts, got):
        own = words_of(text)
        assert len(own) == len(hashes)
        for w, h in zip(own, hashes.tolist()):
            assert same.setdefault(w, h) == h
    assert len(set(same.values())) == len(same)


ENGLISH = "the cat and the dog with that man for this is it was"
GERMAN = "der hund und die katze mit dem mann ist das auf ein nicht"


def language_texts():
    rng = random.Random(1)
    texts, langs = [], {}
    for k in range(60):
        source = ENGLISH if k % 2 else GERMAN
        texts.append(" ".join(rng.choices(source.split(), k=30)))
        langs[k] = "en" if k % 2 else "de"
    return texts, langs


def test_language_and_awkward_texts(spark):
    texts, langs = language_texts()
    learned = docs_of(spark, texts, langs)
    model = langid.fit(learned)
    asked = ["the dogs with cats", "die hunde mit katzen", None, "", "12 34 !?", "THE CAT", "the " * 20_000]
    got = {r.doc_id: r for r in langid.predict(docs_of(spark, asked), model).collect()}
    assert [got[k].lang_pred for k in range(7)] == ["en", "de", "und", "und", "und", "en", "en"]
    assert all(0 <= got[k].score <= 1 for k in got) and got[3].score == 0
    kept = langid.identified(docs_of(spark, asked), model)
    assert kept.columns == docs_of(spark, asked).columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 5, 6]
    nothing = langid.fit(learned.where("false"))
    assert {r.lang_pred for r in langid.predict(docs_of(spark, asked), nothing).collect()} == {"und"}
    assert langid.predict(docs_of(spark, []), model).count() == 0


def test_any_number_of_languages(spark):
    texts, langs = language_texts()
    n = len(texts)
    word = lambda k: "zq" + chr(97 + k // 26) + chr(97 + k % 26)
    texts += [" ".join([word(k)] * 3) for k in range(600)]
    langs |= {n + k: f"dirty{k}" for k in range(600)}
    model = langid.fit(docs_of(spark, texts, langs))
    assert len(model.languages) == 602
    asked = ["the cat and the dog", "der hund und die katze", f"{word(7)} {word(7)}", None] * 600
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, asked), model).collect()}
    assert [got[k] for k in range(2400)] == ["en", "de", "dirty7", "und"] * 600


def test_a_language_without_any_feature_twice_is_learned(spark):
    texts, langs = language_texts()
    texts.append("qoph zayin")
    langs[len(texts) - 1] = "rare"
    model = langid.fit(docs_of(spark, texts, langs))
    assert "rare" in model.languages
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs_of(spark, ["qoph zayin", "the cat and the dog"]), model).collect()}
    assert got == {0: "rare", 1: "en"}


def test_language_backs_off_to_the_longest_known_ngram(spark):
    texts, langs = language_texts()
    model = langid.fit(docs_of(spark, texts, langs))
    mean, n = model.scores(["katzenhund"])
    assert n.tolist() == [1] and mean[0].argmax() == model.languages.index("de")

    # The word is unknown; of its n-grams of order 4 some are known, so their mean is its score.
    grams = ["katzenhund"[i:i + 4] for i in range(7)]
    values = []
    for lang in model.languages:
        own = [t for k, t in enumerate(texts) if langs[k] == lang]
        counts = {}
        for t in own:
            for w in t.split():
                for i in range(len(w) - 3):
                    counts[w[i:i + 4]] = counts.get(w[i:i + 4], 0) + 1
        counts = {g: c for g, c in counts.items() if c >= langid.MIN_COUNT}
        values.append(counts)
    size = len(set().union(*values))
    for column, counts in enumerate(values):
        total = sum(counts.values()) + 0.5 * size
        want = sum(math.log((counts.get(g, 0) + 0.5) / total) for g in grams) / len(grams)
        assert math.isclose(mean[0][column], want, rel_tol=1e-5)


def test_toxicity_learns_from_positives_and_unlabelled(spark):
    rng = random.Random(3)
    plain = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(1500):
        words = rng.choices(plain, k=40)
        bad = k % 10 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["scoundrel", "nitwit", "buffoon"])
        texts.append(" ".join(words))
        toxic.append(int(bad))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(k, toxic[k]) for k in range(0, 1000)] + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[k].predicted == toxic[k] for k in range(1000, 1500)) >= 490
    odd = {r.doc_id: r for r in toxicity.score(docs_of(spark, [None, "", "???", "nitwit " * 20_000]), model).collect()}
    assert odd[0].score == odd[1].score == odd[2].score < 0.5 and odd[3].predicted == 1
    kept = toxicity.harmless(docs_of(spark, [None, "nitwit scoundrel buffoon"]), model)
    assert [r.doc_id for r in kept.collect()] == [0] and kept.columns == docs.columns
    untaught = toxicity.fit(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score(docs, untaught).collect()} == {0}


def test_toxicity_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None)], "doc_id long, toxic int")
    for model in (toxicity.fit(docs.where("false"), labels), toxicity.fit(docs, labels.where("false")),
                  toxicity.fit(docs.where("doc_id is null"), labels)):
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == 2 and len({r.score for r in rows}) == 1 and {r.predicted for r in rows} == {0}
        assert toxicity.harmless(docs.where("false"), model).count() == 0


def test_risk_takes_the_prior_out():
    # Of 100 unlabelled documents 20 hold the positives' word: the risk must not call it negative.
    words = [np.array([7])] * 50 + [np.array([7])] * 20 + [np.array([9])] * 80
    positive = np.array([True] * 50 + [False] * 100)
    chosen, weights, bias = toxicity.train(words, positive, 0.2)
    assert dict(zip(chosen.tolist(), weights))[7] + bias > 0 > bias + dict(zip(chosen.tolist(), weights)).get(9, 0.0)


def segmentations(p, text):
    """All segmentations with their probabilities, by recursion over the marked text."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if np.isfinite(p.logp[i])}
    marked, out = ("▁" + text.replace(" ", "▁")) if text else "", {}

    def go(at, done, score):
        if at == len(marked):
            out[tuple(done)] = score
            return
        for size in range(1, 17):
            i = ids.get(marked[at:at + size])
            if i is not None and at + size <= len(marked):
                go(at + size, [*done, i], score + p.logp[i])
        if marked[at] not in ids:
            raw = marked[at].encode()
            go(at + 1, [*done, *(int(p.byte_ids[b]) for b in raw)], score + len(raw) * p.byte_logp)

    go(0, [], 0.0)
    whole = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(v - whole) for k, v in out.items()}


@pytest.mark.parametrize("text", ["the in", "ab", "é漢a"])
def test_samples_without_replacement_follow_the_lattice(text):
    p, n = pieces.pieces_of(pieces.MODEL), 4000
    want = segmentations(p, text)
    *found, left = pieces.sample([text] * n, tokens.mix(np.arange(n, dtype=np.uint64)), 2, p)
    drawn = []
    for docs, logp, perturbed, ids, counts in found:
        own = [tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])]
        for s, lp in zip(own, logp):
            assert math.isclose(math.exp(lp), want[s], rel_tol=1e-9)
        drawn.append(dict(zip(docs.tolist(), own)))
    assert all(drawn[0][k] != drawn[1].get(k) for k in range(n))
    for s in sorted(want, key=want.get)[-3:]:
        first = sum(v == s for v in drawn[0].values()) / n
        second = sum(v == s for v in drawn[1].values()) / n
        assert abs(first - want[s]) < 0.03
        assert abs(second - sum(q * want[s] / (1 - q) for o, q in want.items() if o != s)) < 0.03


def test_steps_bring_their_probability_and_single_characters_need_no_hash(monkeypatch):
    p, asked, find = pieces.pieces_of(pieces.MODEL), [], pieces.Pieces.find
    monkeypatch.setattr(pieces.Pieces, "find", lambda self, h: asked.append(len(h)) or find(self, h))
    lattice = pieces.Lattice(["a b c d"], p)
    assert asked == [4]  # the blanks that begin the four units, with the letter after them
    who, row, column, logp = lattice.walk(lattice.occ_unit, lattice.occ_size, np.arange(4, dtype=np.uint64))
    assert sorted(set(who.tolist())) == [0, 1, 2, 3]
    assert logp.tolist() == lattice.step_logp(row, column).tolist()


def test_query_searches_on_from_branches_of_several_samples(spark):
    rows = pieces.op3_pieces(spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("ids_hash").alias("different"), F.countDistinct("text_crc32").alias("texts"),
        F.transform(F.sort_array(F.collect_list(F.struct("sample", "perturbed"))), lambda s: s["perturbed"]).alias("scores")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert all(r.n == r.different == len(r.scores) and r.texts == 1 and r.scores == sorted(r.scores, reverse=True) for r in rows)
    assert all(r.n == 8 for r in rows if len(texts[r.doc_id] or "") > 40)


def test_encode_decodes_in_the_same_pass(spark):
    df = docs_of(spark, ["the in  and", None, "", "é\u2581☃ \n7", "a " * 300])
    told = pieces.encode(df.withColumn("own", F.col("text")), samples=4, carry=("own",), decoded=True).collect()
    apart = pieces.decode(pieces.encode(df, samples=4), ["doc_id", "sample", "ids"]).collect()
    assert sorted((r.doc_id, r["sample"], r.ids, r.decoded) for r in told) == sorted((r.doc_id, r["sample"], r.ids, r.text) for r in apart)
    assert all(r.decoded == (r.own or "") for r in told)
    plan = pieces.op3_pieces(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_branches_not_looked_at_first_are_found(monkeypatch):
    p = pieces.pieces_of(pieces.MODEL)
    texts = ["the in and of", "7" * 500 + " the in", "- " * 900 + "ab", "", "a " * 300, "ab"]
    draw = lambda: list(pieces.sample(texts, tokens.mix(np.arange(len(texts), dtype=np.uint64)), 9, p))
    few, whole = [], []
    for window, out in ((1, few), (1 << 20, whole)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        out += draw()
    assert len(few) == len(whole) == 10
    for a, b in zip(few[:-1], whole[:-1]):
        assert a[0].tolist() == b[0].tolist() and a[3].tolist() == b[3].tolist() and np.allclose(a[2], b[2])
    assert np.allclose(few[-1][1], whole[-1][1])


def test_exhausted_lattices_and_inclusion(spark):
    df = docs_of(spark, ["ab", None, "", "ab"])
    rows = pieces.encode(df, samples=9).collect()
    p = pieces.pieces_of(pieces.MODEL)
    assert {r.doc_id: sum(x.doc_id == r.doc_id for x in rows) for r in rows} == {0: len(segmentations(p, "ab")), 1: 1, 2: 1, 3: len(segmentations(p, "ab"))}
    assert all(r.inclusion == 1.0 for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 0}) == len(segmentations(p, "ab"))
    assert [list(r.ids) for r in rows if r.doc_id == 1] == [[]]


def test_round_trip_of_awkward_texts(spark):
    texts = ["a  b", " lead", "trail ", "\t\n x", "▁ literal", "漢字 ☃ é́", "<s> [INST] </s>", "q" * 3000, "a " * 20_000, ""]
    found = pieces.encode(docs_of(spark, texts), samples=3)
    told = pieces.decode(found, ["doc_id", "sample"]).collect()
    assert all(r.text == texts[r.doc_id] for r in told) and {r.doc_id for r in told} == set(range(len(texts)))
    again = pieces.encode(docs_of(spark, texts).repartition(3, "doc_id"), samples=3)
    key = lambda df: sorted((r.doc_id, r.sample, tuple(r.ids)) for r in df.collect())
    assert key(found) == key(again)
    assert pieces.encode(docs_of(spark, [])).count() == 0
