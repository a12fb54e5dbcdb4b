"""Prefix tries, against plain Python over all prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseweave.llm import trie

TURNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the trie, every prefix by itself."""
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t, role or "", text or ""))
    digest = lambda role, text: trie_digest(role, text)
    for c, turns in own.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))
        own[c] = [(role, text) for _, role, text in turns]
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
    nodes = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])),
                    sum(q not in kids for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_digest(role, text):
    import base64

    return base64.b64encode(hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:15]).decode()


def collected(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth int, key string").repartition(3)
    return sorted((tuple(r) for r in trie.prefix_trie(trie.rebuilt(df), **sizes).select(*trie.NODE).collect()), key=repr)


@pytest.mark.parametrize("seed, n, deep", [(0, 20, 3), (1, 600, 4), (2, 900, 60), (3, 3000, 900)])
def test_find_close_equals_a_stack(seed, n, deep):
    rng = random.Random(seed)
    bits, height = [1], 1
    for _ in range(n):
        up = height < deep and (height == 1 or rng.random() < 0.55)
        bits.append(int(up))
        height += 1 if up else -1
    bits += [0] * height
    stack, want = [], {}
    for at, b in enumerate(bits):
        if b:
            stack.append(at)
        else:
            want[stack.pop()] = at
    for block in (2, 5, 64, 256):
        found = trie.Excess(np.array(bits, np.uint8), block)
        opens = np.array(sorted(want))
        assert found.find_close(opens).tolist() == [want[k] for k in opens.tolist()]


def conversations(seed):
    """Families with equal heads, copies of whole conversations, and a long one that is copied."""
    rng, rows = random.Random(seed), []
    for c in range(260):
        if c == 200:
            continue  # a family without its first conversation
        rows += [(c, t, rng.choice("ua"), rng.choice(["yes", "no", "né"])) for t in range(rng.choice([0, 1, 2, 3, 4, 8]))]
    for c in (1000, 1001, 1002, 1003, 2000):
        rows += [(c, t, "u", f"turn {t}") for t in range(60)]
    for c in range(3000, 3080):
        rows += [(c, 0, "u", "hello"), (c, 1, "a", "hello to you")]
    rows += [(7000, 0, None, "x"), (7000, 1, "u", None), (7001, None, "z", "null first"), (7001, 0, "u", "then"), (7100, 0, None, None),
             (None, 0, "u", "nobody"), (-3, 0, "u", "yes"), (7002, 2, "u", "tie"), (7002, 2, "a", "tie"), (7002, 2, "a", "tie"), (7003, 0, "", "")]
    return rows


@pytest.mark.parametrize("sizes", [{"partitions": 1}, {"partitions": 1, "shard_turns": 7}, {"partitions": 5, "shard_turns": 20, "piece_ids": 3},
                                   {"partitions": 40, "piece_ids": 1}])
def test_nodes_equal_all_prefixes(spark, sizes):
    rows = conversations(4)
    assert collected(spark, rows, **sizes) == brute(rows)


def test_hot_paths_cross_many_shards(spark):
    """One conversation that most rows share, turnless ones and prefixes of it, cut into many shards."""
    rows = [(c, t, "u", f"t{t}") for c in range(100, 500) for t in range(3)]
    rows += [(c, t, "u", f"t{t}") for c in range(601, 640) for t in range(2)] + [(600, 0, "u", "t0")]
    rows += [(c, t, "u", f"t{t}") for c in range(701, 760) for t in range(2)]
    for sizes in ({"partitions": 30, "piece_ids": 4}, {"partitions": 3, "shard_turns": 1}):
        assert collected(spark, rows, **sizes) == brute(rows)


def test_no_conversations(spark):
    assert trie.prefix_trie(trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    lone = spark.createDataFrame([(None, 1, "u", "x")], TURNS)
    assert trie.prefix_trie(trie.rebuilt(lone)).count() == 0
    assert trie.rebuilt(lone).agg(F.count("*")).first()[0] == 0
