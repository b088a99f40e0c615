import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from helpers import docs, empty, odd_texts
from lobloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(lengths, capacity):
    """Exact number of sequences for a handful of lengths."""
    best = len(lengths)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in {r: j for j, r in enumerate(rooms) if r >= lengths[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - lengths[i]])

    lengths = sorted(lengths, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(25))
def test_plan_is_complete_and_optimal_on_small_sets(seed):
    r = random.Random(seed)
    lengths = [r.randrange(1, 60) for _ in range(10)]
    counts = {n: lengths.count(n) for n in lengths}
    plan = packing.plan(counts, 60)
    held = sorted(itertools.chain.from_iterable(h * n for n, h in plan))
    assert held == sorted(lengths)
    assert all(sum(h) <= 60 for _, h in plan)
    used, need = sum(n for n, _ in plan), fewest(lengths, 60)
    assert packing.lower_bound(counts, 60) <= need <= used <= need + 1
    assert used == need or seed in ()


def test_plan_reaches_the_bound_on_many_pieces():
    r = np.random.default_rng(3)
    n, c = np.unique(np.clip(r.lognormal(6, 1, 50_000).astype(int), 1, 2048), return_counts=True)
    counts = dict(zip(n.tolist(), c.tolist()))
    assert sum(k for k, _ in packing.plan(counts)) == packing.lower_bound(counts, 2048)


@pytest.mark.parametrize("extra", [False, True])
def test_pieces_and_places(spark, extra):
    got = packing.pack_documents(docs(spark, extra=extra), PATH, keep_ids=True).collect()
    model = Tokenizer.from_file(PATH)
    want = {}
    for i, t in enumerate(odd_texts()):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            want[i, k] = (lo, ids[lo : lo + 2048])
    assert {(r.doc_id, r.piece): (r.start, list(r.ids)) for r in got} == want
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, rows in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows:
            assert r.offset == at
            at += r.length
        assert at <= 2048
    lengths = {}
    for r in got:
        lengths[r.length] = lengths.get(r.length, 0) + 1
    assert len({r.sequence_id for r in got}) == packing.lower_bound(lengths, 2048)


def test_repeated_rows_and_empty_table(spark):
    twice = docs(spark, ["a b", None]).union(docs(spark, ["a b", None]))
    got = packing.pack_documents(twice, PATH).collect()
    assert len(got) == 4 and len({(r.sequence_id, r.offset) for r in got}) == 4
    assert packing.pack_documents(empty(spark), PATH).count() == 0


def test_one_group_of_words_is_encoded_at_a_time(monkeypatch):
    from lobloom.llm import tokens

    model = tokens.WordEncoder(PATH)
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(8)) + r.choice(["", "1", ")"]) for _ in range(12_000)]
    ask, most = model._ids, []
    monkeypatch.setattr(model, "_ids", lambda texts: most.append(len(texts)) or ask(texts))
    assert model.encode([" ".join(words)])[0] == np.array(Tokenizer.from_file(PATH).encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert max(most) == 1 and len(most) > 12
