"""A prefix trie of conversations: members, children, leaves and shareable tokens of every node.

A node is a distinct sequence of first turns (role, text). Turns are encoded by
a dictionary; distinct sequences of ids are dealt to shards by range, so a shard
holds neighbouring paths. Each shard builds a ternary search tree, inserting the
sorted sequences median first, which keeps the search among siblings balanced.
Nodes are created after their parents, so one pass backwards over them adds up
members, leaves and savings without recursion. Prefixes that a shard shares with
its neighbour (they lie on its first or last path) come out as partial rows; they
are merged by digest, and their sums are completed in the small tree they form.

Copies of a conversation shrink to one sequence with a count before the shards.
A turn that a large share of all rows repeat is encoded by a broadcast of the
frequent turns, of which there can only be a few for each partition; other turns
by a join. Ids of members that end at a node are sorted by range and hashed in
pieces of bounded size. A single conversation is one row of ids, put together
from pieces of ``PIECE`` turn numbers.

Defined cases: rows with a null conversation id belong to no conversation; null
role and text are empty; null turns come first; equal turn numbers are ordered
by a hash of role and text, so repeated rows stay as often as they come; a
conversation without turns is a member of the root; an empty table has no nodes;
further columns are not looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobloom.session import stage

from .tables import parallel

PIECE = 1024
SHARD_TURNS = 400_000
HASH_PIECE = 2_000
SMALL_TOP = 200_000  # rows of (digest, long): under 10 MB
NOWHERE = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

_NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (id, words)."""
    said = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    rows = stage(turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("at"),
        F.unhex(F.sha2(F.concat(F.char_length(said[0]).cast("string"), F.lit(":"), *said), 256)).alias("said"),
        F.xxhash64(*said).alias("tie"), F.regexp_count(said[1], F.lit(WORD)).cast("long").alias("words")), "turns")
    book = stage(rows.groupBy("said").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("w")).select(
        F.monotonically_increasing_id().alias("id"), "said", "n"), "dictionary")
    # At most 2 * partitions turns can be that frequent.
    often = F.broadcast(book.where(F.col("n") > max(1, rows.count() // (2 * parallel(turns)))).select("said", "id"))
    rare = book.join(often, "said", "left_anti").select("said", "id")
    coded = rows.join(often, "said").unionByName(rows.join(often, "said", "left_anti").join(rare, "said"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("at").isNotNull().alias("known"), "at", "tie", "id", "words")))
    pieces = coded.groupBy("conv_id", F.floor(F.col("at") / PIECE).alias("piece")).agg(ordered.alias("rows"))
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("piece").isNotNull().alias("known"), "piece", "rows"))).alias("pieces"))
    return whole.select("conv_id", F.transform(
        F.flatten(F.col("pieces.rows")), lambda r: F.struct(r["id"].alias("id"), r["words"].alias("words"))).alias("turns"))


def _ends(paths: DataFrame) -> DataFrame:
    """(path, ends): SHA-256 of the ascending decimal ids of the conversations with each path."""
    n = parallel(paths)
    ids = paths.select("path", "conv_id").repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")

    def join(batches):
        for b in batches:
            keys, convs = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, at = ([], [], []), 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[at] or i - at == HASH_PIECE:
                    for column, value in zip(out, (keys[at], convs[at], ",".join(map(str, convs[at:i]))), strict=True):
                        column.append(value)
                    at = i
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())],
                                             names=["path", "first", "ids"])

    def digest(batches):
        path, state = None, None
        for b in batches:
            done = ([], [])
            for p, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p != path:
                    if state is not None:
                        done[0].append(path)
                        done[1].append(state.hexdigest())
                    path, state = p, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["path", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path", "ends"])

    pieces = ids.mapInArrow(join, "path binary, first long, ids string")
    return pieces.repartition(n, "path").sortWithinPartitions("path", "first").mapInArrow(digest, "path binary, ends string")


class Tree:
    """A ternary search tree in flat lists; node 0 is the root."""

    def __init__(self):
        self.key, self.low, self.high, self.down = [0], [-1], [-1], [-1]
        self.up, self.depth, self.words = [-1], [0], [0]
        self.members, self.least, self.ends = [0], [None], [None]

    def _node(self, key: int, up: int, words: int) -> int:
        for column, value in (
                (self.key, key), (self.low, -1), (self.high, -1), (self.down, -1), (self.up, up), (self.words, words),
                (self.depth, self.depth[up] + 1), (self.members, 0), (self.least, None), (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def insert(self, ids: list[int], words: list[int], members: int, least: int, ends: str) -> None:
        at = 0
        for key, w in zip(ids, words, strict=True):
            x = self.down[at]
            if x < 0:
                x = self.down[at] = self._node(key, at, w)
            while self.key[x] != key:
                side = self.low if key < self.key[x] else self.high
                if side[x] < 0:
                    side[x] = self._node(key, at, w)
                x = side[x]
            at = x
        self.members[at] += members
        self.least[at] = least if self.least[at] is None else min(least, self.least[at])
        self.ends[at] = ends

    def path(self, ids: list[int], depth: int) -> list[int]:
        """Nodes of the first ``depth`` ids, the root first."""
        out = [0]
        for key in ids[:depth]:
            x = self.down[out[-1]]
            while self.key[x] != key:
                x = self.low[x] if key < self.key[x] else self.high[x]
            out.append(x)
        return out


def medians(n: int):
    """0..n-1, the middle of each range before its halves."""
    todo = [(0, n)]
    for lo, hi in todo:
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            todo += [(lo, mid), (mid + 1, hi)]


def _shard(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("ids", "words", "n", "conv_id", "ends")), strict=True), key=lambda r: r[0])
    left, right = (table.column(c)[0].as_py() for c in ("left", "right"))
    t = Tree()
    for i in medians(len(rows)):
        t.insert(*rows[i])
    size = len(t.key)
    shared = {}  # node -> digest, for prefixes that neighbouring shards may hold too
    for ids, depth in ((rows[0][0], left), (rows[-1][0], right)):
        h = hashlib.sha256()
        for node, key in zip(t.path(ids, depth), [None, *ids]):
            if key is not None:
                h.update(key.to_bytes(8, "big", signed=True))
            shared[node] = h.digest()
    inner, leaves, saved = [0] * size, [0] * size, [0] * size
    for x in range(size - 1, -1, -1):
        if x not in shared:
            leaves[x] += inner[x] == 0
            saved[x] += (t.members[x] - 1) * t.words[x]
        if x:
            up = t.up[x]
            t.members[up] += t.members[x]
            t.least[up] = t.least[x] if t.least[up] is None else min(t.least[up], t.least[x])
            inner[up] += x not in shared
            leaves[up] += leaves[x]
            saved[up] += saved[x]
    return pa.Table.from_pydict({
        "digest": [shared.get(x) for x in range(size)], "parent": [shared.get(t.up[x]) for x in range(size)],
        "parent_conv_id": [t.least[t.up[x]] if x else None for x in range(size)],
        "conv_id": t.least, "depth": t.depth, "n_convs": t.members, "inner": inner, "leaves": leaves, "saved": saved,
        "words": t.words, "ends": t.ends}, schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema([
    ("digest", pa.binary()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()),
    ("n_convs", pa.int64()), ("inner", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("ends", pa.string())])
_SHARD = ("digest binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, inner long, leaves long, "
          "saved long, words long, ends string")
_TOP_ARROW = pa.schema([
    ("digest", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())])


def _complete(table: pa.Table) -> pa.Table:
    """Final rows of the nodes that several shards share, deepest first into their parents.

    Sums of nodes inside shards are there already; only what shared nodes add themselves moves up.
    """
    nodes = {r["digest"]: r | {"own": [0, 0]} for r in table.to_pylist()}
    for r in sorted(nodes.values(), key=lambda r: -r["depth"]):
        own = r["own"]
        own[0] += r["inner"] == 0
        own[1] += (r["n_convs"] - 1) * r["words"]
        r["leaves"] += own[0]
        r["saved"] += own[1]
        up = nodes.get(r["parent"])
        r["parent_conv_id"] = up and up["conv_id"]
        if up:
            up["inner"] += 1
            up["own"][0] += own[0]
            up["own"][1] += own[1]
    names = dict(zip(_TOP_ARROW.names, ("digest", "conv_id", "depth", "parent_conv_id", "n_convs", "inner", "leaves", "saved", "ends"), strict=True))
    return pa.Table.from_pydict({out: [r[c] for r in nodes.values()] for out, c in names.items()}, schema=_TOP_ARROW)


def _equal_start(a: str, b: str):
    """Length of the common start of two different arrays; 0 where one is missing."""
    return F.expr(f"coalesce(array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false) - 1, 0)")


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie over ``seqs(conv_id, turns array<struct<id, words>>)``, one row per conversation.

    Columns: conv_id (smallest member), depth, parent_conv_id (of the parent), n_convs, n_children, n_leaves,
    saved_tokens (summed over the subtree: members less one, times words of the last turn), ends_sha256.
    """
    paths = seqs.select(
        "conv_id", F.col("turns.id").alias("ids"), F.col("turns.words").alias("words"),
        F.unhex(F.sha2(F.array_join(F.col("turns.id").cast("array<string>"), ","), 256)).alias("path"))
    paths = stage(paths, "paths")
    distinct = paths.groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.first("ids").alias("ids"), F.first("words").alias("words"))
    turns = paths.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = max(1, -(-turns // shard_turns))
    dealt = stage(
        distinct.join(_ends(paths), "path").repartitionByRange(shards, "ids").withColumn("shard", F.spark_partition_id()), "shards")
    # One row per shard, with the neighbouring paths.
    by = Window.orderBy("shard")
    cuts = dealt.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high")).select(
        "shard", "low", "high", F.lag("high").over(by).alias("before"), F.lead("low").over(by).alias("after"))
    cuts = cuts.select("shard", _equal_start("low", "before").alias("left"), _equal_start("high", "after").alias("right"))
    nodes = stage(dealt.join(F.broadcast(cuts), "shard").groupBy("shard").applyInArrow(_shard, _SHARD), "nodes")
    parts = nodes.where("digest IS NOT NULL").groupBy("digest").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "inner", "leaves", "saved")], F.max("words").alias("words"), F.max("ends").alias("ends"))
    # Only prefixes across a cut between two shards: at most their common depth for each cut.
    top = stage(parts.groupBy(F.expr("0L * depth").alias("all")).applyInArrow(_complete, "digest binary, " + _NODE), "top")
    parents = top.select(F.col("digest").alias("parent"), F.col("conv_id").alias("above"))
    if top.count() <= SMALL_TOP:
        parents = F.broadcast(parents)
    nowhere = F.lit(NOWHERE)
    inside = nodes.where("digest IS NULL").join(parents, "parent", "left").select(
        "conv_id", "depth", F.coalesce("above", "parent_conv_id").alias("parent_conv_id"), "n_convs", F.col("inner").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", nowhere).alias("ends_sha256"))
    return inside.unionByName(top.drop("digest").withColumn("ends_sha256", F.coalesce("ends_sha256", nowhere)))
