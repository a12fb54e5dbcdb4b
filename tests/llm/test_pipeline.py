"""The pipeline's stages, against plain Python."""

import random

import corpus_pipeline
from pulseweave.llm import langid, mixing, pieces, toxicity
from test_text_operators import brute_components, near_copies

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_encoded_rows_carry_the_schedule(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, f"text {k} {rng.random()}", "en", "ab"[k % 7 == 0], k) for k in range(400)] + [(None, "no id", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r.doc_id: r.position for r in mixing.mix(docs).collect()}
    corpus_pipeline.mixed(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    read = spark.read.parquet(f"{tmp_path}/mixed").repartition(3, "text")  # a reader that keeps no order
    got = corpus_pipeline.encoded(spark, read, "").collect()
    assert {r.doc_id: r.position for r in got} == want and sorted(want.values()) == list(range(401))
    assert [r.position for r in got] == sorted(r.position for r in got)
    plain = {(r.doc_id, r.sample): list(r.ids) for r in pieces.encode(docs).collect()}
    assert len(got) == len(plain) and {(r.doc_id, r.sample): list(r.ids) for r in got} == plain


def clashing(spark):
    """Documents with columns that the operators use for themselves."""
    rng = random.Random(5)
    english, german = "the cat and dog saw of is".split(), "der hund und katze sah von ist".split()
    texts = [" ".join(rng.choices(english if k % 2 else german, k=30)) + (" vilest muck" if k % 9 == 0 else "") for k in range(120)]
    texts += [None, "", "12 34", "the cat " * 3000] + near_copies(1, groups=2, copies=4)
    rows = [(k, t, "en" if k % 2 else "de", "ab"[k % 3 == 0], k, f"p{k}", k, "x", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + [rows[7]], DOCS + ", position string, __id int, component_id string, score int"), texts


def test_stages_equal_plain_python(spark, tmp_path):
    docs, texts = clashing(spark)
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(0, 120, 2)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    keep = lambda stage: sorted(r.doc_id for r in stage(spark, docs, str(tmp_path)).collect())
    ids = [*range(len(texts)), 7]

    pred, conf = langid.decide(langid.fit(docs), [t or "" for t in texts])
    assert keep(corpus_pipeline.language) == sorted(k for k in ids if pred[k] != "und" and conf[k] >= 0.5)
    chance = toxicity.chances(toxicity.fit(docs, labels), [t or "" for t in texts])
    assert keep(corpus_pipeline.clean) == sorted(k for k in ids if chance[k] < 0.5)
    first = {k: kept for k, _, _, kept in brute_components(texts, 5)}
    assert keep(corpus_pipeline.unique) == sorted(k for k in ids if first[k])
    assert keep(corpus_pipeline.mixed) == sorted(ids)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    got = corpus_pipeline.encoded(spark, docs, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == set(ids) and "position" in got.columns
    assert corpus_pipeline.encoded(spark, docs.where("false"), str(tmp_path)).count() == 0
