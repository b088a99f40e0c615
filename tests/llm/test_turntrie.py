import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from lobloom.llm import queries, turntrie

TURNS = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()), T.StructField("id", T.StringType()), T.StructField("shard", T.LongType())])


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], TURNS)


def ordered(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def plain(convs):
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    out = set()
    for s, ms in members.items():
        below = [x for x in members if x[: len(s)] == s]
        kids = [x for x in below if len(x) == len(s) + 1]
        leaves = sum(1 for x in below if not any(y[:-1] == x for y in members if y))
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(s))))
        out.add((min(ms), len(s), min(members[s[:-1]]) if s else None, len(ms), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows(seed=1, convs=150, spread=4):
    r = random.Random(seed)
    out = []
    for c in range(convs):
        n = 1 if c % 7 == 0 else r.randrange(1, 7)
        for t in range(n):
            out.append((c, t, r.choice(["user", "assistant", None]), r.choice([None, "", "a b", "a  b", "hello\u000bthere you", "ü x"][: spread + 2])))
    out += [(200 + i, t, "user", f"same {t}") for i in range(60) for t in range(5)]  # copies
    out += [(300, t, "user", "on and on") for t in range(1200)] + [(301, t, "user", "on and on") for t in range(900)]
    out += [(400, None, "user", "first"), (400, -3, "user", "second"), (400, 5, "a", "p"), (400, 5, "a", "p"), (None, 0, "user", "lost")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("per_shard", [400_000, 60, 1])
def test_nodes(spark, per_shard):
    data = [x for x in rows() if x[0] not in (300, 301)]
    nodes = turntrie.prefix_trie(queries.rebuilt(turntrie.sequences(table(spark, data))), per_shard)
    got = [tuple(r) for r in nodes.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rebuilt(ordered(data)))


def test_long_conversations(spark):
    data = [x for x in rows() if x[0] in (300, 301, 400)]
    got = {tuple(r) for r in turntrie.prefix_trie(turntrie.sequences(table(spark, data)), 100).collect()}
    convs = ordered(data)
    assert max(r[1] for r in got) == 1200
    assert {r[:4] for r in got if r[1] == 900} == {(300, 900, 300, 2)}
    assert {r[:6] for r in got if r[1] == 1000} == {(300, 1000, 300, 1, 1, 1)}
    root = next(r for r in got if r[1] == 0)
    assert root[3:7] == (3, 2, 2, 900 * 3) and len(got) == 1 + 1200 + len(convs[400])


def test_members_hash_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "HASH_PIECE", 3)
    data = [(i, 0, "user", "hi") for i in range(95, 130)]
    got = {r.depth: r for r in turntrie.prefix_trie(turntrie.sequences(table(spark, data))).collect()}
    assert got[1].ends_sha256 == hashlib.sha256(",".join(map(str, range(95, 130))).encode()).hexdigest()
    assert got[0].ends_sha256 == turntrie.NOWHERE and got[0].n_leaves == 1 and got[0].saved_tokens == 34


def test_empty(spark):
    assert turntrie.prefix_trie(turntrie.sequences(table(spark, []))).count() == 0
    assert turntrie.prefix_trie(turntrie.sequences(table(spark, [(None, 1, "user", "x")]))).count() == 0


def test_search_tree_is_balanced():
    t = turntrie.Tree()
    for i in turntrie.medians(1000):
        t.insert([i], [1], 1, i, "")
    deepest = 0
    for x in range(1, 1001):
        steps, at = 1, t.down[0]
        while at != x:
            at = t.low[at] if t.key[x] < t.key[at] else t.high[at]
            steps += 1
        deepest = max(deepest, steps)
    assert deepest == 10
