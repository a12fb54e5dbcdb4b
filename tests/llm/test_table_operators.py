"""Sharding, mixing, vectors, chat and archives, against brute force and awkward rows."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseweave.llm import ann, chat, mixing, sharding, vectors, warc
from pulseweave.llm.graph import components


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (7, 900), (900, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()))
    want = {k: 10 for k in range(10, 41)} | {k: 100 for k in range(100, 160)} | {7: 7, 900: 7}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_shards(rows, n):
    """The law in plain Python: (id, size, crc, shard, slot)."""
    placed = []
    for i, t in rows:
        raw = None if t is None else t.encode()
        placed.append((-1 if raw is None else zlib.crc32(raw), len(raw or b"") + 16, i if i is not None else -10**9, raw))
    placed.sort(key=lambda r: r[:3])
    total, largest = sum(r[1] for r in placed), max(r[1] for r in placed)
    start, shards, groups = 0, [], {}
    for c, s, i, _ in placed:
        shards.append(start * n // total)
        groups.setdefault((c, s), []).append(len(shards) - 1)
        start += s
    for (c, s), at in groups.items():
        if s * len(at) <= largest:
            for k in at:
                shards[k] = shards[at[0]]
    slots, out = {}, []
    for (c, s, i, raw), shard in zip(placed, shards):
        out.append((None if i == -10**9 else i, s, None if raw is None else c, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return sorted(out, key=repr)


def test_shards_follow_the_law(spark):
    rng = random.Random(0)
    rows = [(k, "x" * rng.randrange(0, 400) + str(rng.randrange(60))) for k in range(500)]
    rows += [(1000 + k, "copied text") for k in range(250)] + [(2000, None), (2001, None), (2002, ""), (None, "no id"), (3000, "é" * 9000)]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, size int, shard string")
    got = sorted((tuple(r) for r in sharding.shard(df, 7).collect()), key=repr)
    assert got == brute_shards(rows, 7)
    assert sharding.shard(df.where("false"), 7).count() == 0


def test_pattern_keeps_every_source_within_a_block():
    for weights in ([5, 3, 2], [1] * 7, [100, 1, 1], [0.5, 0.3, 0.2, 0.01], [3]):
        period = 420
        whole = mixing.shares(weights, period)
        slots = mixing.pattern(whole, period)
        assert sum(whole) == period and sorted(t for s in slots for t in s) == list(range(period))
        for w, own in zip(whole, slots):
            assert len(own) == w
            for k, t in enumerate(own):
                assert k * period // w <= t < -(-(k + 1) * period // w)
            served = np.searchsorted(own, np.arange(period + 1))
            assert np.abs(served - np.arange(period + 1) * w / period).max() < 1


def test_mixing_places_every_row_once(spark):
    sizes = {"a": 700, "b": 90, None: 33, "": 5}
    rows = [(1000 * n + k, s, 0, "z") for n, (s, m) in enumerate(sizes.items()) for k in range(m)] + [(None, "b", 0, "z"), (1001, "b", 0, "z")]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot int, position string")
    got = mixing.mix(df, block=4, period=60).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    assert sorted((r.doc_id, r.source) for r in got if None not in (r.doc_id, r.source)) == sorted((i, s) for i, s, *_ in rows if None not in (i, s))
    assert all(r.release <= r.slot < r.deadline for r in got)
    first = [r for r in got if r.phase == 0]
    share = {s: m ** 0.5 for s, m in (("a", 700), ("b", 92), (None, 33), ("", 5))}
    for s in sizes:
        blocks = sorted({r.slot for r in first if r.source == s})
        for t in range(0, first[-1].slot):
            served = sum(b < t for b in blocks)
            assert abs(served - t * share[s] / sum(share.values())) < 1 + t / 60  # weights are rounded to 60ths
    assert mixing.mix(df.where("false")).count() == 0


def test_schedule_stays_within_a_block_of_the_exact_weights():
    for blocks, weights in (([3330, 2000, 2000, 1500, 1170], [n ** 0.5 for n in (3330, 2000, 2000, 1500, 1170)]),
                            ([40, 9000, 3, 500], [1.0, 1e5, 3e-4, 77.7]), ([2] * 300, [1 + k / 7 for k in range(300)]), ([0, 5], [2, 1])):
        exact = [Fraction(w) for w in weights]
        taken, phase, local, at = [0] * len(blocks), 0, {}, 0
        total, active = None, None
        for n, (p, slot, s, release, deadline) in enumerate(mixing.schedule(blocks, weights)):
            assert slot == n
            if p != phase or active is None:
                phase, local, at = p, {}, n
                active = [k for k in range(len(blocks)) if taken[k] < blocks[k]]
                total = sum(exact[k] for k in active)
            k, w = local.get(s, 0), exact[s] / total
            assert release == at + floor(k / w) <= slot < at + ceil((k + 1) / w) == deadline
            local[s], taken[s] = k + 1, taken[s] + 1
            for k in active if n % 97 == 0 else [s]:
                assert abs(local.get(k, 0) - exact[k] / total * (n + 1 - at)) < 1
        assert taken == blocks


def test_mixing_keeps_to_the_exact_weights(spark):
    sizes = {"a": 4000, "b": 1200, "c": 700, None: 9}
    rows = [(n * 10_000 + k, s) for n, (s, m) in enumerate(sizes.items()) for k in range(m)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=1, period=60).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows)))
    total = sum(m ** 0.5 for m in sizes.values())
    served = dict.fromkeys(sizes, 0)
    for n, r in enumerate(r for r in got if r.phase == 0):
        served[r.source] += 1
        assert all(abs(served[s] - (n + 1) * m ** 0.5 / total) < 1 for s, m in sizes.items())


def test_mixing_takes_any_number_of_sources(spark):
    rows = [(k, f"host{k % 700}") for k in range(3000)] + [(5000 + k, "big") for k in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string"), block=2).orderBy("position").collect()
    assert [r.position for r in got] == list(range(3900)) and sorted((r.doc_id, r.source) for r in got) == sorted(rows)
    assert all(r.release <= r.slot < r.deadline for r in got)


VECTORS = "vec_id long, embedding array<float>, label int, n_links string"


def vector_rows(seed=0, n=160, width=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, width))
    x = centres[rng.integers(0, 6, n)] + 0.25 * rng.standard_normal((n, width))
    rows = [(k, [float(np.float32(v)) for v in x[k]], int(rng.integers(0, 2)), "x") for k in range(n)]
    rows += [(n + k, rows[3][1], rows[3][2], "x") for k in range(9)]
    rows += [(5000, None, 0, "x"), (5001, [0.0] * width, 0, "x"), (5002, [1.0, None] + [0.0] * (width - 2), 0, "x"),
             (5003, [float("nan")] * width, 0, "x"), (5004, [1.0, 2.0], 0, "x"), (5005, rows[3][1], None, "x"), (5006, [], 0, "x"),
             (5007, [float("inf")] + [1.0] * (width - 1), 0, "x"), (5008, [2 * v for v in rows[3][1]], rows[3][2], "x")]
    return rows


def good(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("tile", [16, 4096])
def test_near_vectors_equal_brute_force(spark, tile):
    rows = vector_rows()
    got = {r[0]: tuple(r)[1:] for r in vectors.near_vectors(spark.createDataFrame(rows, VECTORS), 0.93, tile=tile).collect()}
    linked = {i: set() for i, *_ in rows}
    for i, v, a, _ in rows:
        for j, w, b, _ in rows:
            if i < j and a is not None and a == b and good(v) and good(w) and len(v) == len(w):
                v_, w_ = np.array(v), np.array(w)
                if v_ @ w_ / np.linalg.norm(v_) / np.linalg.norm(w_) >= 0.93:
                    linked[i].add(j)
                    linked[j].add(i)
    for i in linked:
        seen, todo = {i}, [i]
        while todo:
            for k in linked[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        assert got[i] == (len(linked[i]), min(seen), min(seen) == i), i
    assert vectors.near_vectors(spark.createDataFrame(rows, VECTORS).where("false"), 0.9).count() == 0


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(1)
    u = vectors.unit_rows(rng.standard_normal((300, 20)) * rng.choice([1e-3, 1, 1e3], 300)[:, None])
    q, s, e = vectors.quantise(u)
    a = q * s[:, None]
    assert (np.abs(u @ u.T - a @ a.T) <= e[:, None] + np.linalg.norm(a, axis=1)[:, None] * e[None] + 1e-12).all()


def test_nearest_recall_and_awkward_vectors(spark):
    rows = vector_rows(2, 900)
    df = spark.createDataFrame(rows, VECTORS)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable_rows = {i: np.array(v, float) for i, v, *_ in rows if good(v)}
    hits = wanted = 0
    for i in (i for i in usable_rows if i % 20 == 0):
        own = usable_rows[i]
        same = {j: v for j, v in usable_rows.items() if j != i and len(v) == len(own)}
        best = sorted((-float(own @ v), j) for j, v in same.items())[:20]
        found = sorted(got.get(i, []))
        assert [r for r, *_ in found] == list(range(1, len(found) + 1))
        for _, j, s in found:
            assert j != i and abs(s - float(own @ usable_rows[j])) < 1e-9
        assert found == sorted(found, key=lambda f: (-round(f[2], 9), f[1]))
        hits += len({j for _, j in best} & {j for _, j, _ in found})
        wanted += len(best)
    assert hits >= 0.9 * wanted
    assert set(got) <= set(usable_rows)
    assert ann.nearest(df.where("false"), df.where("false"), 20).count() == 0


@pytest.mark.parametrize("n", [1, 2, 21, 60])
def test_queries_find_as_many_as_there_are(spark, n, monkeypatch):
    """Far more buckets than rows: queries go on until they have all or 20 candidates."""
    monkeypatch.setattr(ann, "BUCKET", 1)
    x = sphere(n, 8, 3)
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df, 20).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert {k: len(v) for k, v in got.items()} == {k: min(20, n - 1) for k in range(n) if n > 1}
    if n == 21:
        for k, found in got.items():
            assert sorted(found) == [j for j in range(21) if j != k]


def sphere(n, width=32, seed=4):
    x = np.random.default_rng(seed).standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(functions, closeness, width=32):
    rng = np.random.default_rng(5)
    return ann.Index(rng.standard_normal((width + 1, ann.TABLES, functions)), rng.random((ann.TABLES, functions)), 1.0, 1.0,
                     closeness, np.arange(-3, 4), {})


@pytest.mark.parametrize("functions", [4, 7])
def test_probes_go_on_until_the_target(functions):
    index = fitted(functions, 0.4)
    q = np.repeat(sphere(8), 100, axis=0)
    u = np.random.default_rng(6).standard_normal(q.shape)
    u -= (u * q).sum(axis=1, keepdims=True) * q
    near = 0.4 * q + (1 - 0.4 ** 2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    owner, key = index.probes(q[::100])
    visited = [set(key[owner == k].tolist()) for k in range(8)]
    found = [not visited[k // 100].isdisjoint(own) for k, own in enumerate(index.index(near).tolist())]
    assert np.mean(found) > ann.TARGET - 0.03
    assert (np.bincount(owner) > ann.PROBES).all() == (functions == 7)


def test_functions_are_as_many_as_the_visits_can_serve(spark, monkeypatch):
    monkeypatch.setattr(ann, "BUCKET", 2000 / 4 ** 8)  # a table this full would get 8 functions
    x = sphere(2000)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "cls long, vector array<double>")
    index = ann.fit(df, 20)
    assert index.shifts.shape[1] < 8 and index.reaches(x[:64])
    keys, hits = index.index(x), 0
    owner, key = index.probes(x[:64])
    for k in range(64):
        found = np.isin(keys, key[owner == k]).any(axis=1)
        hits += found[np.argsort(-(x @ x[k]))[1:21]].sum()
    assert hits >= 0.9 * 64 * 20


def test_nearest_are_found_by_hashing_alone(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 100)
    monkeypatch.setattr(ann, "BUCKET", 40)
    x, n = sphere(2500), 2500
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.fit(df.select(F.col("vec_id").alias("cls"), F.col("embedding").alias("vector")), 20)
    assert index.shifts.shape[1] == 3 and len(index.sample[32][0]) < 200
    held = type("Held", (), {"value": index})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(x.tolist())], names=["cls", "vector"])
    rows = pa.Table.from_batches(ann._keyed(held, False, 21)([batch]))
    keys = index.index(x)
    assert rows.num_rows == n * ann.TABLES and set(rows["bucket"].to_pylist()) == set(keys.ravel().tolist())
    asked = pa.Table.from_batches(ann._keyed(held, True, 21)([batch.slice(0, 300)]))
    own, bucket, floor = (asked[c].to_numpy() for c in ("cls", "bucket", "floor"))
    got = {}
    for r in ann.nearest(df, df.where("vec_id < 300"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for k in range(300):
        score, found = x @ x[k], np.isin(keys, bucket[own == k]).any(axis=1)
        assert (score[found] >= floor[own == k].max() - 1e-9).sum() >= min(21, found.sum())
        reached = [j for j in np.argsort(-score).tolist() if found[j] and j != k]
        assert got[k] == set(reached[:20])
        hits += len(got[k] & set(np.argsort(-score)[1:21].tolist()))
    assert hits >= 0.9 * 300 * 20


def chat_events(rows):
    return [(c, s, m, k, r, t, "x") for c, s, m, k, r, t in rows]


EVENTS = "conv_id long, seq long, message long, kind string, role string, text string, turns string"


def test_events_fold_into_final_messages(spark):
    rows = [
        (1, 1, 0, "start", "user", None), (1, 2, 0, "delta", None, "hel"), (1, 3, 0, "delta", None, "lo"),
        (1, 4, 1, "start", "assistant", None), (1, 5, 1, "delta", None, "wrong"), (1, 6, 2, "start", "user", None),
        (1, 7, 2, "delta", None, "gone"), (1, 8, 1, "regenerate", None, None), (1, 9, 1, "delta", None, "ri"),
        (1, 10, 1, "delta", None, "ght"), (1, 11, 0, "edit", None, "HELLO"), (1, 12, 0, "delta", None, "!"),
        (2, 1, 0, "delta", None, None), (None, 1, 0, "start", None, None), (None, 2, 0, "delta", "user", "x"),
    ]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(chat_events(rows), EVENTS)
    got = sorted(map(tuple, chat.fold(df).collect()), key=repr)
    assert got == sorted([(1, 0, "user", "HELLO!"), (1, 1, "assistant", "right"), (2, 0, "", ""), (None, 0, "user", "x")], key=repr)
    assert chat.fold(df.where("false")).count() == 0


def test_events_of_one_seq_are_ordered_by_kind(spark):
    events = [(1, 0, 1, "start", "user", None), (1, 5, 1, "delta", None, "old"), (1, 5, 1, "edit", None, "NEW"), (1, 5, 1, "delta", None, "also old"),
              (1, 6, 1, "delta", None, " and on"), (2, 3, 1, "delta", None, "lost"), (2, 3, 1, "regenerate", None, None), (2, 3, 1, "start", "a", None),
              (2, 4, 1, "delta", None, "kept"), (3, 1, 1, "delta", None, "no "), (3, 2, 1, "delta", None, "start")]
    df = spark.createDataFrame(events, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {r.conv_id: (r.role, r.text) for r in chat.fold(df).collect()}
    assert got == {1: ("user", "NEW and on"), 2: ("a", "kept"), 3: ("", "no start")}


def test_template_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\/INST]", "<", "</s", "/s>", "[INST", "", " x ", "é☃\n</s>", "\\", "$1 \\1",
           "<s>" * 500, "a" * 50_000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(odd + odd[1:])] + [(2, 0, "assistant", None), (2, 0, "assistant", None),
            (3, None, None, "no role"), (None, 1, "as</s>[/INST] r", "x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    rendered = chat.render(chat.fold(chat.events_of(df)))
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert got[conv].loss_text == "".join(t for r, t in own if r == "assistant")


def page_rows():
    pages = [(k, f"http://x/{k}", f"<html>{k % 7}</html>" * (k % 5)) for k in range(60)]
    return pages + [(100, None, None), (101, "a b\r\nc", ""), (102, "u", "é" * 200_000), (103, "u", "\r\n\r\nWARC/1.1"), (None, "n", "x"), (None, "n", "x"),
                    (7, "twice", "<html>0</html><html>0</html>")]


@pytest.mark.parametrize("least", [0, 20])
def test_archive_round_trip(spark, tmp_path, least):
    rows = page_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, frame string")
    where = f"file://{tmp_path}/archive"
    index = warc.write_archive(df, where, least_bytes=least, frame_bytes=4000, bundle_bytes=20_000)
    payload = lambda t: (t or "").encode()
    lows = {}
    for i, _, t in rows:
        if i is not None:
            lows[payload(t)] = min(i, lows.get(payload(t), i))
    want = []
    for i, _, t in rows:
        p = payload(t)
        again = i is not None and len(p) >= least and i > lows[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", lows[p] if again else None))
    assert sorted(map(tuple, warc.read_archive(spark, where).collect()), key=repr) == sorted(want, key=repr)
    fetched = warc.fetch(index, where).collect()
    assert len(fetched) == len(rows)
    for r in fetched:
        assert bytes(r.record).startswith(b"WARC/1.1\r\n") and f"X-Page-ID: {'' if r.page_id is None else r.page_id}\r\n".encode() in bytes(r.record)
    assert index.select("bundle", "frame").distinct().count() > 3


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archive(df, f"file://{tmp_path}/archive").count() == 0
    assert warc.read_archive(spark, f"file://{tmp_path}/archive").count() == 0
