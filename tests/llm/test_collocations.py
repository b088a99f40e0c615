import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs, empty, odd_texts, prose

from lobloom.llm import collocations as co


def pieces(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def plain(rows, least, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        for ws in pieces(text):
            n[lang] += len(ws)
            for size in (1, 2, 3, 4):
                for i in range(len(ws) - size + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in cands.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    inside[p[i : i + size]] = max(inside[p[i : i + size]], a)
        kept = []
        for p, a in cands.items():
            if p in inside and 100 * inside[p] >= 80 * a:
                continue
            s, _, left, right = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-s, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def corpus():
    texts = [*odd_texts(), *[prose(k % 7, 150) for k in range(60)], *["New York City Hall. new york city hall; San  Francisco\tBay"] * 40, "x" * 9000, "a\x00b c\x0bd"]
    return texts


@pytest.mark.parametrize(("least", "buckets", "flush"), [(30, 1 << 20, 1 << 25), (3, 256, 20_000)])
def test_against_plain_counts(spark, monkeypatch, least, buckets, flush):
    monkeypatch.setattr(co, "BUCKET_ENTRIES", buckets)
    monkeypatch.setattr(co, "FLUSH_BYTES", flush)
    monkeypatch.setattr(co, "HELD_WORDS", 200)
    d = docs(spark, corpus(), extra=True)
    rows = [(r.lang or "und", r.text) for r in d.collect()]
    got = sorted(tuple(r) for r in co.collocations(d, least=least).collect())
    assert got == plain(rows, least) and got


def test_first_rows_only(spark):
    d = docs(spark, corpus())
    want = plain([(r.lang or "und", r.text) for r in d.collect()], 5, top=7)
    assert sorted(tuple(r) for r in co.collocations(d, least=5, top=7).collect()) == want


def test_full_bitmap_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "_bitmap", lambda often: b"\xff" * 4096)
    d = docs(spark, corpus()[:40])
    assert sorted(tuple(r) for r in co.collocations(d, least=4).collect()) == plain([(r.lang or "und", r.text) for r in d.collect()], 4)


def test_empty_and_rare(spark):
    assert co.collocations(empty(spark)).count() == 0
    assert co.collocations(docs(spark, [None, "", "one two"])).count() == 0


@pytest.mark.parametrize("size", [0, 1, 200, 300, 70_000])
@pytest.mark.parametrize("lanes", [1, 2, 4])
def test_filters_are_lossless(size, lanes):
    r = np.random.default_rng(size + lanes)
    ids = [r.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(lanes)]
    first, rest, n = co.counted(co.permuted(ids), ids[1:])
    n = n * r.integers(1, 400, len(n))
    for skip in (0, 3, 8):
        bucket = 5 % (1 << skip)
        mine = (first >> np.uint64(64 - skip)) == bucket if skip else np.ones(len(first), bool)
        f, x, k = first[mine], [y[mine] for y in rest], n[mine]
        got = co.unpacked(co.packed(f, x, k, skip), lanes, bucket, skip)
        assert np.array_equal(got[0], f) and all(np.array_equal(a, b) for a, b in zip(got[1], x, strict=True)) and np.array_equal(got[2], k)
    back = co.restored(first, rest)
    assert set(zip(back.tolist(), *[y.tolist() for y in rest], strict=True)) == set(zip(*[i.tolist() for i in ids], strict=True))


def test_equal_first_lanes_of_different_phrases():
    first = np.array([5, 5, 5, 5, 1], np.uint64)
    rest = [np.array([1, 2, 1, 2, 9], np.uint64)]
    f, x, n = co.counted(first, rest)
    assert (f.tolist(), x[0].tolist(), n.tolist()) == ([1, 5, 5], [9, 1, 2], [1, 2, 2])


def test_words_that_share_an_id(spark, monkeypatch):
    counts = co._word_counts

    def blunt(plain):
        def scan(batches):
            for b in counts(plain)(batches):
                yield b if plain else b.set_column(1, "id", pa.array([1] * b.num_rows, pa.int64()))

        return scan

    monkeypatch.setattr(co, "_word_counts", blunt)
    r = random.Random(3)
    d = docs(spark, [" ".join(r.choice(["ab", "cd", "efg", "hij"]) for _ in range(80)) for _ in range(20)])
    assert sorted(tuple(x) for x in co.collocations(d, least=10).collect()) == plain([(x.lang or "und", x.text) for x in d.collect()], 10)


def test_different_words_of_a_chunk_are_told_apart(monkeypatch):
    monkeypatch.setattr(co, "runs_hash", lambda low, a, z: (z - a).astype(np.uint64))
    batch = pa.record_batch([pa.array(["en"]), pa.array(["ab cd ab efg"])], names=["lang", "text"])
    rows = [r for b in co._word_counts(False)([batch]) for r in b.to_pylist()]
    assert {(r["id"], r["word"], r["n"]) for r in rows} == {(2, b"ab", 2), (2, b"cd", 1), (3, b"efg", 1)}


def test_held_words_are_flat_and_summed_before_they_leave(monkeypatch):
    monkeypatch.setattr(co, "HELD_WORDS", 50)
    monkeypatch.setattr(co, "DRAIN_ROWS", 7)
    batches = [pa.record_batch([pa.array(["en", "de"]), pa.array([prose(k % 3, 60), None])], names=["lang", "text"]) for k in range(30)]
    want = Counter(w for b in batches for t in b.column(1).to_pylist() for ws in pieces(t) for w in ws)
    out = list(co._word_counts(False)(batches))
    got = Counter()
    for b in out:
        for r in b.to_pylist():
            got[r["word"].decode()] += r["n"]
    assert got == want and max(b.num_rows for b in out) <= 7

    ids, words, n = co._summed(np.array([1, 2, 1, 3], np.uint64), pa.array([b"a", b"b", b"a", b"c"]), np.array([1, 2, 3, 4]))
    assert (ids.tolist(), words.to_pylist(), n.tolist()) == ([1, 2, 3], [b"a", b"b", b"c"], [4, 2, 4])
