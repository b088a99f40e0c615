import random

import numpy as np
import pytest

from helpers import docs, empty, odd_texts, prose
from lobloom.llm import suffixdedup as sd


def plain(texts, n=50):
    """(bytes, removed, spans, kept) by looking up every string in all earlier documents."""
    raw = [(t or "").encode() for t in texts]
    first = {}
    for i, t in enumerate(raw):
        for s in range(len(t) - n + 1):
            first.setdefault(t[s : s + n], i)
    out = []
    for i, t in enumerate(raw):
        gone = [False] * len(t)
        last = 0
        for s in range(len(t) - n + 1):
            if first[t[s : s + n]] < i:
                for k in range(max(s, last), s + n):
                    gone[k] = True
                last = s + n
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, bytes(c for c, g in zip(t, gone) if not g)))
    return out


def tangled(seed=3):
    r = random.Random(seed)
    passages = [prose(100 + i, 25) for i in range(6)]
    base = prose(7, 400)
    out = []
    for i in range(60):
        t = base if i % 4 == 0 else prose(200 + i, r.randrange(5, 120))
        b = list(t)
        for _ in range(r.randrange(4)):
            b[r.randrange(len(b))] = r.choice("äz?\x00\x01")
        t = "".join(b)
        for p in r.sample(passages, r.randrange(3)):
            k = r.randrange(len(t))
            t = t[:k] + p + t[k:]
        out.append(t)
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_against_lookup(spark, group):
    for texts in (tangled(), odd_texts()):
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_substrings(docs(spark, texts, extra=True), group=group).collect()}
        assert got == dict(enumerate(plain(texts)))


def test_intervals_are_repeats():
    r = random.Random(5)
    text = bytes(r.choice(b"ab") for _ in range(400)) + b"\0"
    at, number = sd.intervals(np.frombuffer(text, np.uint8), 7)
    groups = {}
    for i in range(len(text) - 6):
        groups.setdefault(text[i : i + 7], []).append(i)
    got = {}
    for a, n in zip(at.tolist(), number.tolist()):
        if a + 7 <= len(text):
            got.setdefault(n, []).append(a)
    assert sorted(sorted(g) for g in got.values()) == sorted(g for g in groups.values() if len(g) > 1)


def test_long_texts_in_segments(monkeypatch):
    text = prose(11, 3000).encode()
    whole = sd.stretches([text])
    monkeypatch.setattr(sd, "SEGMENT", 700)
    parts = sd.stretches([text])
    cover = lambda x: sorted((s + k, a) for s, n, a in zip(x[1].tolist(), x[2].tolist(), x[4].tolist()) for k in range(n))
    assert cover(whole) == cover(parts) and len(cover(whole)) == len(text) - 49


def test_all_bytes_differ():
    strings = [bytes([x]) * 60 for x in (0, 1, 2, 255)] + [b"\x00\x01" * 30, b"\x01\x01" * 30]
    got = sd.covered_windows(strings, np.arange(6), 50)
    assert got == [(5, 0, 11)]


def test_odd_tables(spark):
    assert sd.dedup_substrings(empty(spark)).count() == 0
    long = "0123456789" * 7 + "é"
    rows = docs(spark, [long, None, long]).union(docs(spark, [long]))
    got = sorted((r.doc_id, r.n_removed, r.n_spans) for r in sd.dedup_substrings(rows).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (2, 72, 1)]
    nulls = rows.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert {r.n_removed for r in sd.dedup_substrings(nulls).collect()} == {0}
