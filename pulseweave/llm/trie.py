"""Prefix trie of conversations as balanced parentheses per shard, with shared spines merged."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pulseweave.llm.common import query, table
from pulseweave.session import materialize

#: Characters that stand for a turn in a path: 15 bytes of SHA-256 in base 64.
WIDTH = 20
#: Conversations are rebuilt from the head of the first one of their family: ids in a family, longest head.
FAMILY, LONGEST_HEAD = 100, 5
#: Turns after which a shard is closed, parentheses of a block, conversations of a piece.
SHARD_TURNS, BLOCK, PIECE_IDS = 1 << 19, 256, 4096

NO_ENDS = hashlib.sha256(b"").hexdigest()

# What a task returns; ``kind`` tells which of the columns are set.
_CLOSED, _OPEN, _PIECE, _BORDER = range(4)
_FIELDS = [
    ("kind", pa.int32()), ("part", pa.int32()), ("seq", pa.int64()), ("key", pa.string()), ("parent_key", pa.string()),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    ("ids", pa.string()), ("first_keys", pa.list_(pa.string())), ("keys", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())),
]
_SCHEMA = (
    "kind int, part int, seq long, key string, parent_key string, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string, "
    "first_keys array<string>, keys array<string>, sums array<long>"
)
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


# Balanced parentheses


class Excess:
    """Excess of a balanced sequence (1 opens, 0 closes) with the range minimum and maximum of blocks."""

    def __init__(self, bits: np.ndarray, block: int = BLOCK):
        self.block, self.n = block, len(bits)
        self.values = np.cumsum(2 * bits.astype(np.int64) - 1)
        padded = np.concatenate([self.values, np.full(-self.n % block, self.values[-1], np.int64)]).reshape(-1, block)
        self.low, self.high = [padded.min(axis=1)], [padded.max(axis=1)]
        while len(self.low[-1]) > 1:
            low, high = self.low[-1], self.high[-1]
            if len(low) % 2:
                low, high = np.append(low, low[-1]), np.append(high, high[-1])
            self.low.append(np.minimum(low[::2], low[1::2]))
            self.high.append(np.maximum(high[::2], high[1::2]))

    def _scan(self, at: np.ndarray, target: np.ndarray, out: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Look for ``target`` from ``at`` to the end of its block; returns those not found there."""
        end, far = np.minimum((at // self.block + 1) * self.block, self.n), []
        while len(which):
            inside = at < end
            far.append(which[~inside])
            at, target, end, which = at[inside], target[inside], end[inside], which[inside]
            hit = self.values[at] == target
            out[which[hit]] = at[hit]
            at, target, end, which = at[~hit] + 1, target[~hit], end[~hit], which[~hit]
        return np.concatenate([*far, np.zeros(0, np.int64)])

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The parenthesis that closes each of ``opens``: the next place with one less excess."""
        target, out = self.values[opens] - 1, np.full(len(opens), -1, np.int64)
        far = self._scan(opens + 1, target, out, np.arange(len(opens)))
        blocks = self._next_block((opens[far] + 1) // self.block + 1, target[far])
        self._scan(blocks * self.block, target[far], out, far)
        return out

    def _next_block(self, place: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The first block from ``place`` on whose range of excess holds ``target``: up the tree, then down."""
        level, found = np.full(len(place), -1), place.copy()
        for k, (low, high) in enumerate(zip(self.low, self.high)):
            for step in (0, 1):  # a right sibling comes after its left one, under the same parent
                at = np.minimum(place + step, len(low) - 1)
                hit = (level < 0) & (place + step < len(low)) & (low[at] <= target) & (target <= high[at])
                hit &= (step == 0) | (place % 2 == 0)
                level[hit], found[hit] = k, at[hit]
            place = place // 2 + 1
        for k in range(len(self.low) - 1, 0, -1):
            down = level == k
            left = 2 * found[down]
            here = (self.low[k - 1][left] <= target[down]) & (target[down] <= self.high[k - 1][left])
            found[down], level[down] = np.where(here, left, left + 1), k - 1
        return found


class Shard:
    """The trie of a run of conversations in the order of their paths, as parentheses and arrays in preorder."""

    def __init__(self):
        self.bits, self.depth, self.parent, self.length = bytearray(b"\1"), [0], [-1], [0]
        self.ends, self.least, self.digest = [0], [None], [None]
        self.first, self.path, self.spine, self.turns = None, [], [0], 0

    def add(self, path: list[str], lengths: list[int], n: int, least: int, digest: str | None):
        """``n`` conversations with one path, the least of whose ids is ``least``."""
        shared = 0
        for a, b in zip(self.path, path):
            if a != b:
                break
            shared += 1
        self.bits += b"\0" * (len(self.path) - shared) + b"\1" * (len(path) - shared)
        del self.spine[shared + 1:]
        for k in range(shared, len(path)):
            self.parent.append(self.spine[-1])
            self.spine.append(len(self.depth))
            self.depth.append(k + 1)
            self.length.append(lengths[k])
            self.ends.append(0)
            self.least.append(None)
            self.digest.append(None)
        node = self.spine[-1]
        self.ends[node], self.least[node], self.digest[node] = n, least, digest
        self.path, self.turns = path, self.turns + len(path) + 1
        if self.first is None:
            self.first = path

    def evaluate(self) -> dict[str, np.ndarray]:
        """Members, children, leaves and savings of every node, from the parentheses."""
        bits = np.frombuffer(bytes(self.bits) + b"\0" * len(self.spine), np.uint8)
        opens = np.flatnonzero(bits)
        closes = Excess(bits).find_close(opens)
        n = len(opens)
        here, after = np.arange(n), np.arange(n) + (closes - opens + 1) // 2
        below = lambda values: (c := np.concatenate([[0], np.cumsum(values)]))[after] - c[here]
        members = below(np.array(self.ends, np.int64))
        leaf_pairs = np.concatenate([[0], np.cumsum((bits[:-1] == 1) & (bits[1:] == 0))])
        parent, least = np.array(self.parent), list(self.least)
        for k in range(n - 1, 0, -1):  # children follow their parents
            p = self.parent[k]
            if least[p] is None or least[k] < least[p]:
                least[p] = least[k]
        return {
            "n_convs": members, "n_leaves": leaf_pairs[closes] - leaf_pairs[opens],
            "n_children": np.bincount(parent[1:], minlength=n).astype(np.int64),
            "saved_tokens": below((members - 1) * np.array(self.length, np.int64)),
            "conv_id": np.array(least, np.int64), "parent": parent, "depth": np.array(self.depth, np.int64),
        }


def node_keys(path: list[str]) -> list[str]:
    """A name for the root and for each node on ``path``; equal names have equal paths."""
    keys, last = [""], b""
    for turn in path:
        last = hashlib.blake2b(last + turn.encode(), digest_size=16).digest()
        keys.append(last.hex())
    return keys


# A task


class _Run:
    """Consecutive conversations with one path; the list of their ids is hashed, and given out in pieces."""

    def __init__(self, path: str, lengths: list[int], conv_id: int, first: bool):
        self.text, self.lengths, self.least, self.first = path, lengths, conv_id, first
        self.path = [path[k:k + WIDTH] for k in range(0, len(path), WIDTH)]
        self.n, self.hash, self.waiting, self.key = 0, hashlib.sha256(), [], None

    def add(self, conv_id: int):
        self.hash.update(f"{',' * (self.n > 0)}{conv_id}".encode())
        self.waiting.append(str(conv_id))
        self.n += 1

    def piece(self, part: int, seq: int) -> dict:
        self.key = node_keys(self.path)[-1] if self.key is None else self.key
        ids, self.waiting = ",".join(self.waiting), []
        return {"kind": _PIECE, "part": part, "seq": seq, "key": self.key, "ids": ids}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])


def _border(path: list[str], lengths: list[int], following: list[str]) -> Iterator[dict]:
    """What two neighbouring shards count twice on the spine they share, by node.

    A node in both was taken for two: its savings lack one text, its parent has a child
    too many, and if the first shard ends at the end of the spine, a leaf is no leaf or
    counted twice.
    """
    shared = 0
    for a, b in zip(path, following):
        if a != b:
            break
        shared += 1
    keys, total = node_keys(path[:shared]), sum(lengths[:shared])
    before = 0
    for d, key in enumerate(keys):
        yield {"kind": _OPEN, "key": key, "n_children": -(d < shared), "n_leaves": -(len(path) == shared),
               "saved_tokens": total - before, "n_convs": 0}
        before += lengths[d - 1] if d else 0


def _nodes(shard: Shard) -> Iterator[pa.RecordBatch]:
    """Nodes on the first and last path of a shard as open ones, the others finished."""
    found = shard.evaluate()
    n = len(found["depth"])
    keys = dict(zip(range(len(shard.first) + 1), node_keys(shard.first))) | dict(zip(shard.spine, node_keys(shard.path)))
    spine = np.zeros(n, bool)
    spine[list(keys)] = True
    parent_open = np.zeros(n, bool)
    parent_open[1:] = spine[found["parent"][1:]]
    columns = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens")
    yield _batch([{c: int(found[c][k]) for c in columns} | {
        "kind": _OPEN, "key": key, "parent_key": keys.get(int(found["parent"][k])), "ends_sha256": shard.digest[k],
    } for k, key in keys.items()])
    step = 1 << 16
    for low in range(0, n, step):
        at = np.flatnonzero(~spine[low:low + step]) + low
        if not len(at):
            continue
        parents, hidden = found["parent"][at], parent_open[at]
        given = {c: pa.array(found[c][at], pa.int64()) for c in columns} | {
            "kind": pa.array(np.zeros(len(at), np.int32)),
            "parent_conv_id": pa.array(found["conv_id"][parents], pa.int64(), mask=hidden),
            "parent_key": pa.array([keys.get(p) for p in parents.tolist()], pa.string()),
            "ends_sha256": pa.array([shard.digest[k] or NO_ENDS for k in at.tolist()], pa.string()),
        }
        yield pa.RecordBatch.from_arrays([given.get(c, pa.nulls(len(at), t)) for c, t in _FIELDS], names=[c for c, _ in _FIELDS])


def _tries(shard_turns: int, piece_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        shard, group, first, last = Shard(), None, None, None
        for batch in batches:
            for conv_id, path, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if group is None or path != group.text:
                    if group is not None:
                        if group.first:
                            yield _batch([group.piece(part, seq)])
                            seq += 1
                        shard.add(group.path, group.lengths, group.n, group.least, None if group.first else group.hash.hexdigest())
                        if shard.turns >= shard_turns:
                            yield from _nodes(shard)
                            last, shard = (group.path, group.lengths), Shard()
                    group = _Run(path, lengths, conv_id, first is None)
                    first = group.path if first is None else first
                    if last is not None:
                        yield _batch(list(_border(*last, group.path)))
                        last = None
                group.add(conv_id)
                if len(group.waiting) == piece_ids:
                    yield _batch([group.piece(part, seq)])
                    seq += 1
        if group is not None:
            yield _batch([group.piece(part, seq)])
            shard.add(group.path, group.lengths, group.n, group.least, None)
            yield from _nodes(shard)
            sums = np.concatenate([[0], np.cumsum(group.lengths, dtype=np.int64)]).tolist()
            yield _batch([{"kind": _BORDER, "part": part, "first_keys": node_keys(first), "keys": node_keys(group.path), "sums": sums}])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends_sha256) from pieces in order; a piece at a time is held."""
    key, digest = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if key is not None:
                    yield row()
                key, digest, joint = k, hashlib.sha256(), ""
            if ids:
                digest.update((joint + ids).encode())
                joint = ","
    if key is not None:
        yield row()


# Jobs


def rebuilt(conversations: DataFrame, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
            family: int = FAMILY, longest_head: int = LONGEST_HEAD) -> DataFrame:
    """(conv_id, path, lengths): each conversation after taking over the head of its family's first one.

    A turn is 120 bits of the SHA-256 of role and text, and the number of its code points;
    texts are read once and not shuffled.  ``path`` joins the turns' digests, so that paths
    sort like the trie is walked and a prefix is a prefix.  The turns of one conversation
    are one value of 24 bytes each.  Turns without number come first; turns of one number are
    ordered by their digests.  A family is ``c - c % family`` (the remainder has the sign of c).
    """
    c = F.col(id_column).cast("long")
    said, spoke = F.coalesce(F.col(text).cast("string"), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    digest = F.base64(F.substring(F.unhex(F.sha2(F.concat(F.char_length(spoke).cast("string"), F.lit(":"), spoke, said), 256)), 1, 15))
    rows = conversations.select(c.alias("conv_id"), F.struct(
        F.col(turn).cast("long").alias("turn"), digest.alias("d"), F.char_length(said).alias("n"),
    ).alias("t")).where("conv_id is not null")
    own = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = rows.where(F.col("conv_id") % family == 0).groupBy(F.col("conv_id").alias("base")).agg(
        F.slice(F.sort_array(F.collect_list("t")), 1, longest_head).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (longest_head + 1)).cast("int")
    both = own.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    taken = F.when(F.col("head").isNull(), F.slice("turns", F.lit(1), F.lit(0))).otherwise(F.slice("head", F.lit(1), h))
    turns = F.concat(taken, F.slice("turns", h + 1, F.size("turns")))
    return both.select("conv_id", turns.alias("turns")).select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t.d), "").alias("path"), F.transform("turns", lambda t: t.n).alias("lengths"),
    )


def prefix_trie(paths: DataFrame, partitions: int | None = None, shard_turns: int = SHARD_TURNS, piece_ids: int = PIECE_IDS) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, lengths), see :func:`op13_trie` for the columns.

    Ranges of (path, conv_id) cut the walk through the trie into shards: a first turn, or a
    whole conversation, that a third of all rows share is cut into as many ranges as it
    needs.  Each shard is a sequence of balanced parentheses; the close of a node, found
    through the range minima of blocks, delimits its subtree, ranks count the leaf pairs
    in it and cumulative arrays its members and savings.  What lies inside a shard is
    finished there.  Nodes on its first and last path go on into other shards, if any:
    their sums are added up by node, and each border takes away what its spine counts
    twice, which depends on the two paths at the border alone.  So nothing but spines is
    shuffled again, and children of spine nodes, to learn their parent's smallest member.

    A task holds one shard of about ``shard_turns`` turns and a batch of conversations.
    The ids that end at a node are hashed while they pass; where they cross a border they
    go, in pieces, through one more task per node, as SHA-256 demands.  The border window
    has a row per partition.
    """
    spark = paths.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = paths.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id") \
        .select("conv_id", "path", "lengths")
    local = materialize(walked.mapInArrow(_tries(shard_turns, piece_ids), _SCHEMA))

    following = F.lead("first_keys").over(Window.orderBy("part"))
    borders = local.where(F.col("kind") == _BORDER).select("keys", "sums", following.alias("next")).where("next is not null")
    borders = borders.withColumn("shared", F.expr(
        "size(filter(sequence(0, least(size(keys), size(next)) - 1), i -> keys[i] = next[i]))"))
    twice = borders.select("*", F.explode(F.sequence(F.lit(0), F.col("shared") - 1)).alias("d")).select(
        F.expr("keys[d]").alias("key"), F.lit(0).cast("long").alias("n_convs"),
        F.expr("if(d < shared - 1, -1L, 0L)").alias("n_children"),
        F.expr("if(size(keys) = shared, -1L, 0L)").alias("n_leaves"),
        F.expr("sums[shared - 1] - if(d > 0, sums[d - 1], 0L)").alias("saved_tokens"),
    )
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    pieces = local.where(F.col("kind") == _PIECE).select("key", "part", "seq", "ids")
    ends = pieces.repartition("key").sortWithinPartitions("key", "part", "seq").select("key", "ids") \
        .mapInArrow(_hashed, "key string, ends_sha256 string").withColumnRenamed("ends_sha256", "joint")
    spines = local.where(F.col("kind") == _OPEN).unionByName(twice, allowMissingColumns=True).groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"),
        F.max("ends_sha256").alias("ends_sha256"), *[F.sum(c).alias(c) for c in sums],
    ).join(ends, "key", "left")
    spines = materialize(spines.withColumn("ends_sha256", F.coalesce("ends_sha256", "joint", F.lit(NO_ENDS))))
    parents = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))

    given = [c for c in NODE if c != "parent_conv_id"]
    closed = local.where(F.col("kind") == _CLOSED)
    waiting = closed.where("parent_key is not null").select("parent_key", *given).unionByName(
        spines.where("depth > 0").select("parent_key", *given))
    return closed.where("parent_key is null").select(*NODE).unionByName(
        waiting.join(parents, "parent_key").select(*NODE)).unionByName(
        spines.where("depth = 0").select(*given, F.lit(None).cast("long").alias("parent_conv_id")).select(*NODE))


def _crc32(text: str) -> str:
    """DuckDB: a recursive step over the bits of the decimal digits."""
    return f"""crc AS (
  SELECT c, CAST(c AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM {text}
  UNION ALL
  SELECT c, s, k + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) FROM (
    SELECT c, s, k, CASE WHEN k % 8 = 0 THEN xor(v, CAST(ascii(substr(s, k // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x
    FROM crc WHERE k < 8 * length(s))
)"""


_ORACLE = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
{_crc32("ids")},
heads AS (SELECT c, xor(v, CAST(4294967295 AS BIGINT)) % 6 AS h FROM crc WHERE k = 8 * length(s)),
own AS (
  SELECT conv_id AS c, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d,
    length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT heads.c, 0 AS side, r, d, n FROM heads JOIN own ON own.c = heads.c - heads.c % 100 AND r <= h
  UNION ALL
  SELECT heads.c, 1, r, d, n FROM heads JOIN own ON own.c = heads.c AND r > h),
steps AS (
  SELECT c, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path, n FROM turns WINDOW w AS (PARTITION BY c ORDER BY side, r)
  UNION ALL SELECT c, 0, '', 0 FROM ids),
nodes AS (SELECT path, min(c) AS conv_id, any_value(depth) AS depth, any_value(n) AS n, count(*) AS n_convs FROM steps GROUP BY path),
last AS (SELECT c, max(depth) AS depth FROM steps GROUP BY c),
ends AS (SELECT path, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c)) AS ends FROM steps JOIN last USING (c, depth) GROUP BY path),
children AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT substr(path, 1, 32 * k) AS path, (n_convs - 1) * n AS saved, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM (SELECT nodes.*, n_children, unnest(range(0, depth + 1)) AS k FROM nodes LEFT JOIN children USING (path))),
below AS (SELECT path, CAST(sum(saved) AS BIGINT) AS saved_tokens, CAST(sum(leaf) AS BIGINT) AS n_leaves FROM above GROUP BY path)
SELECT nodes.conv_id, nodes.depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM nodes JOIN below USING (path) LEFT JOIN ends USING (path) LEFT JOIN children USING (path)
LEFT JOIN nodes AS up ON nodes.depth > 0 AND up.path = substr(nodes.path, 1, length(nodes.path) - 32)
"""


@query("op13_trie", _ORACLE)
def op13_trie(spark: SparkSession, directory: str) -> DataFrame:
    """A row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, code points that members after the first needn't repeat)
    and ends_sha256 (of the ids that end there).

    Rows without conv_id belong to no conversation.  An empty table has no node, not even a root.
    """
    conversations = table(spark, directory, "conversations", "conv_id", "turn", "role", "text")
    return prefix_trie(materialize(rebuilt(conversations)))
