import random

import pytest
from helpers import docs, empty, prose

from lobloom.llm import simhash_similar as ss


def shingles(t, n=5):
    w = t.lower().replace(",", " ").replace(".", " ").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def edited(text, edits, seed):
    r = random.Random(seed)
    w = text.split(" ")
    for i in r.sample(range(len(w)), edits):
        w[i] = f"changed{seed}w{i}"
    return " ".join(w)


def corpus():
    out = [prose(i, 150 + 10 * (i % 9)) for i in range(120)]
    for i in range(30):
        out.append(edited(out[i], 1 + i % 3, i))
    out += [out[3], out[3], "", None, "one", "two", "one two", "three four"] + [f"short text {i}" for i in range(40)]
    return out


@pytest.mark.parametrize("limit", [2_048, 3])
def test_finds_pairs_and_leaves_others(spark, monkeypatch, limit):
    monkeypatch.setattr(ss, "LIST", limit)
    texts = corpus()
    got = {r.doc_id: r.component_id for r in ss.near_duplicates(docs(spark, texts, extra=True)).collect()}
    assert set(got) == set(range(len(texts)))
    caught = alike = 0
    for i in range(30):
        a, b = shingles(texts[i]), shingles(texts[120 + i])
        if len(a & b) / len(a | b) >= 0.8:
            alike += 1
            caught += got[120 + i] == got[i]
    assert alike > 20 and caught >= 0.9 * alike
    assert got[150] == got[151] == got[3]
    assert got[152] == got[153] == 152
    joined = {k for k, c in got.items() if k != c}
    assert joined <= set(range(120, 152)) | {153}


def test_keep_one_and_empty(spark):
    rows = docs(spark, [prose(1, 200), prose(2, 200), prose(1, 200)], extra=True)
    kept = ss.keep_one(rows)
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1]
    assert ss.near_duplicates(empty(spark)).count() == 0
    nulls = rows.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert ss.keep_one(nulls).count() == 3


def pair_at(seed, least, below):
    """Two texts of 250 words whose shingles are alike in [least, below)."""
    r = random.Random(seed)
    words = [f"w{seed}x{i}" for i in range(250)]
    while True:
        other = list(words)
        for i in r.sample(range(250), r.randrange(3, 9)):
            other[i] = f"v{seed}x{i}"
        a, b = " ".join(words), " ".join(other)
        x, y = shingles(a), shingles(b)
        if least <= len(x & y) / len(x | y) < below:
            return [a, b]


@pytest.mark.parametrize("limit", [2_048, 3])
def test_the_threshold_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(ss, "LIST", limit)
    texts = [t for i in range(100) for t in pair_at(i, 0.8, 0.83)] + [t for i in range(100, 200) for t in pair_at(i, 0.75, 0.8)]
    got = {r.doc_id: r.component_id for r in ss.near_duplicates(docs(spark, texts)).collect()}
    linked = [got[i] == got[i + 1] for i in range(0, 400, 2)]
    assert sum(linked[:100]) >= 97
    assert not any(linked[100:])


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ss, "GROUP_BYTES", 4_000)
    monkeypatch.setattr(ss, "BROADCAST_ROWS", -1)
    base = prose(5, 300)
    texts = [edited(base, 2, k) for k in range(20)] + [prose(6, 300)]
    got = {r.doc_id: r.component_id for r in ss.near_duplicates(docs(spark, texts)).collect()}
    assert {got[i] for i in range(20)} == {0} and got[20] == 20


def test_rows_that_repeat_an_id_are_one_document(spark):
    d = docs(spark, [prose(1, 200), prose(2, 200), prose(3, 200), prose(2, 200)]).selectExpr("CASE WHEN doc_id = 1 THEN 0 ELSE doc_id END AS doc_id", "text")
    got = {r.doc_id: r.component_id for r in ss.near_duplicates(d).collect()}
    assert got == {0: 0, 2: 2, 3: 0}


def test_lists_over_batches_and_long_lists():
    import numpy as np
    import pyarrow as pa

    keys = [1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4, 4, 4, 9, 9]
    parts = [0, 1, 0, *[0] * 7, 0, (1 << 62) - 1, 1, 0, (1 << 40) - 1]
    rows = [pa.array(keys, pa.int32()), pa.array(range(100, 115), pa.int64()), pa.array(parts, pa.int64())]
    for size in (1, 2, 3, 4, 15):
        batches = [pa.RecordBatch.from_arrays([c.slice(i, size) for c in rows], names=["key", "rep", "slice"]) for i in range(0, 15, size)]
        got = [r for b in ss._meetings(8, 4)(batches) for r in b.to_pylist()]
        assert sorted(r["members"] for r in got if r["members"]) == [[100, 101], [110, 112]]
        assert [(r["key"], r["rep"]) for r in got if not r["members"]] == [(3, k) for k in range(103, 110)]
    assert ss._near_members(np.arange(600, dtype=np.uint64) << np.uint64(20), 1).all()
