import random
import zlib
from collections import defaultdict

from helpers import docs, empty, odd_texts, prose
from lobloom.llm import sharding


def test_differencing_moves_add_up():
    r = random.Random(1)
    for k, n in ((2, 1), (4, 30), (16, 200)):
        vectors = [[r.randrange(1000), *[0] * (k - 1)] for _ in range(n)]
        sums, moves = sharding.difference(vectors)
        back = [0] * k
        for v, m in zip(vectors, moves):
            assert sorted(m) == list(range(k))
            for j, place in enumerate(m):
                back[place] += v[j]
        assert back == sums
    assert max(sums) - min(sums) <= 10


def test_beats_greedy_by_size():
    sums, _ = sharding.difference([[x, 0] for x in (8, 7, 6, 5, 4)])
    assert sorted(sums) == [14, 16]


def test_shards(spark):
    texts = odd_texts() + [prose(i % 150, 30 + i % 7) for i in range(600)]
    got = sharding.shard(docs(spark, texts, extra=True), shards=4).collect()
    assert len(got) == len(texts)
    at, size, slots = {}, defaultdict(int), defaultdict(list)
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert at.setdefault(t, r.shard) == r.shard
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) == {0, 1, 2, 3} and max(size.values()) - min(size.values()) <= 400


def test_empty_and_repeated(spark):
    assert sharding.shard(empty(spark)).count() == 0
    rows = docs(spark, ["a", None]).union(docs(spark, ["a", None]))
    got = sharding.shard(rows, 3).collect()
    assert len(got) == 4 and len({(r.shard, r.slot) for r in got}) == 4
