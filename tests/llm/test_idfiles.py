"""Token ids in plane files, against whole-text encoding by the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pulseweave.llm import idfiles

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_restore_blocks(kind):
    rng = np.random.default_rng(0)
    for n in (1, 7, 8, 1000):
        for top in (1, 300, 1 << 32):
            ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
            planes = [p if any(p) else b"" for p in idfiles.transpose(ids, kind)]
            assert (idfiles.restore(planes, n, kind) == ids).all()


AWKWARD = [
    "", " ", "  ", "a  b", "a \n b", "a\n b", "a \nb", "don't  stop's 's", "x  y", "x　 y z", "tab\t tab", "é é",
    "<|endoftext|> is a string", "a<|endoftext|> b", "!! !!! 12 3456 7a", "né à l'été ", "漢字 かな 漢", "​ zero", "\U0001f600 \U0001f600\U0001f600",
    "line\r\n next\x0b x\x1c y", " leading", "trailing ", "- - -- ...", "a\x00 b", "\x85 b", "²  ½ x", "a" * 3000 + " b",
]


def test_pieces_encode_as_whole_texts():
    whole, encoder = Tokenizer.from_file(PATH), idfiles._encoder(PATH)
    rng = random.Random(3)
    alphabet = "ab1'. \n\t é漢-!́s  "
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert encoder.separable
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time all pieces are known
        for t, ids, right in zip(texts, encoder.encode(texts), want):
            assert np.frombuffer(ids, "<u4").tolist() == right, repr(t)
    assert encoder.encode([]) == [] and encoder.encode([""]) == [b""]


def test_a_hash_that_two_pieces_share_is_noticed(monkeypatch):
    whole, encoder = Tokenizer.from_file(PATH), idfiles._Encoder(PATH)
    monkeypatch.setattr(idfiles, "mix", lambda h: h % np.uint64(50))
    texts = [" ".join(f"w{(k * j) % 97}" for j in range(9)) + "." for k in range(120)] + ["", "alone"]
    for t, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_a_worker_forgets_pieces(monkeypatch):
    whole, encoder = Tokenizer.from_file(PATH), idfiles._Encoder(PATH)
    monkeypatch.setattr(idfiles, "KEPT_PIECES", 40)
    for k in range(30):
        texts = [f"w{k} w{k + 1} the w{j}, " for j in range(25)]
        for t, ids in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids
        assert len(encoder.keys) <= 70


def test_tokenizers_that_cannot_be_cut_read_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    whole, encoder = Tokenizer.from_file(path), idfiles._encoder(path)
    assert not encoder.separable
    for t, ids in zip(AWKWARD, encoder.encode(AWKWARD)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("kind, block, per_file", [("byte", 64, 500), ("bit", 50, 1 << 20), ("byte", 1 << 16, 1)])
def test_files_round_trip(spark, tmp_path, kind, block, per_file):
    rng = random.Random(1)
    words = "the of thention ! é 12 über\n".split(" ")
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 90])))) for k in range(300)]
    rows += [(700 + k, t) for k, t in enumerate(AWKWARD)] + [(-5, None), (2000, "word " * 4000), (None, "no id")]
    rows += [(900_000, f"again {k}") for k in range(150)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, first int, file string").repartition(5)
    place = f"file://{tmp_path}/ids"
    idfiles.write_ids(df, place, PATH, planes=kind, block_ids=block, file_ids=per_file)
    whole = Tokenizer.from_file(PATH)
    ids_of = lambda t: whole.encode(t or "", add_special_tokens=False).ids + [0]
    got = sorted((tuple(r) for r in idfiles.checksums(spark, place).collect()), key=lambda r: r[1])
    # Ids ascend, starts have no gap, and each document's sum is that of its own text.
    assert [r[0] for r in got] == sorted((i for i, _ in rows), key=lambda i: -10**9 if i is None else i)
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist()
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r[0], r[2], r[3]) for r in got), key=key) == sorted(
        ((i, len(ids_of(t)), crc(ids_of(t))) for i, t in rows), key=key)
    found = idfiles.index(spark, place)
    assert sorted((r.start, r.n_tokens) for r in found.collect()) == [(r[1], r[2]) for r in got]
    for r in idfiles.fetch(found.where("doc_id in (2000, 3, 7, -5)"), place).collect():
        assert list(r.ids) == ids_of(dict(rows)[r.doc_id])


def test_empty_tables_write_nothing(spark, tmp_path):
    place = f"file://{tmp_path}/none"
    idfiles.write_ids(spark.createDataFrame([], "doc_id long, text string"), place, PATH)
    assert idfiles.checksums(spark, place).count() == 0
