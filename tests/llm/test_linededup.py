import random
import re

import numpy as np
import pytest

from helpers import docs, empty, odd_texts, prose, smallest_reachable
from lobloom.llm import linededup as ld
from lobloom.llm.textbatch import runs_hash


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(40))
def test_edit_distance(seed):
    r = random.Random(seed)
    a = bytes(r.choice(b"abc") for _ in range(r.randrange(90)))
    b = bytearray(a)
    for _ in range(r.randrange(12)):
        if b and r.random() < 0.5:
            del b[r.randrange(len(b))]
        else:
            b.insert(r.randrange(len(b) + 1), r.choice(b"abcd"))
    d = levenshtein(a, bytes(b))
    assert ld.edit_distance(a, bytes(b), 200) == d
    for most in range(12):
        got = ld.edit_distance(a, bytes(b), most)
        assert (got == d) if d <= most else (got > most)


@pytest.mark.parametrize("seed", range(60))
def test_similarity_is_the_distance_rule(seed):
    r = random.Random(seed)
    a = [r.choice([b"alpha", b"be", b"gamma", b"d"]) for _ in range(r.randrange(1, 30))]
    b = list(a)
    for _ in range(r.randrange(6)):
        k = r.randrange(len(b)) if b else 0
        b[k : k + r.randrange(2)] = [r.choice([b"alpa", b"zz", b"gammas"])] * r.randrange(2)
    x, y = b" ".join(a), b" ".join(b)
    assert ld.similar(x, y, 0.8) == (levenshtein(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9)


def normal(line):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in line)
    return [re.sub("[0-9]", "0", w) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain(texts, k=ld.K, least=ld.SIMILARITY):
    """Texts after line removal, all pairs of lines compared."""
    lines = [(i, n, normal(x)) for i, t in enumerate(texts) if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [(i, n, w) for i, n, w in lines if len(w) >= ld.MIN_WORDS]
    first = {}
    for i, n, w in lines:
        first.setdefault(" ".join(w), (i, n))
    bodies = list(first)

    def sim(body):
        hs = []
        for w in body.split(" "):
            v = np.frombuffer(w.encode(), np.uint8)
            hs.append(int(runs_hash(v, np.array([0]), np.array([len(v)]))[0]))
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    sims = [sim(b) for b in bodies]
    pairs = [
        (i, j) for i in range(len(bodies)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= k
        and levenshtein(bodies[i].encode(), bodies[j].encode()) <= (1 - least) * max(len(bodies[i].encode()), len(bodies[j].encode())) + 1e-9]
    group = smallest_reachable(range(len(bodies)), pairs)
    kept = {}
    for i, b in enumerate(bodies):
        kept[group[i]] = min(kept.get(group[i], first[b]), first[b])
    at = {b: kept[group[i]] for i, b in enumerate(bodies)}
    cut = {(i, n) for i, n, w in lines if at[" ".join(w)] != (i, n)}
    return [None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in cut) for i, t in enumerate(texts)]


def fuzzy_texts():
    r = random.Random(8)
    base = [" ".join(r.choice(["alpha", "beta", "gamma", "delta", "über", "omega", "x9"]) + str(r.randrange(30)) for _ in range(r.randrange(6, 40))) for _ in range(12)]
    out = []
    for _ in range(40):
        lines = []
        for b in r.sample(base, 3):
            w = b.split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(5))
            lines.append(" ".join(w) if r.random() < 0.6 else b.upper() + ".")
        out.append("\n".join([*lines, "short line", ""]))
    return out


@pytest.mark.parametrize("texts", [fuzzy_texts(), [t for t in odd_texts() if t is None or len(t) < 5001]])
def test_against_all_pairs(spark, texts):
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts, extra=True)).collect()}
    want = dict(enumerate(plain(texts)))
    assert got == want


def test_full_keys_are_cut_finer(spark, monkeypatch):
    monkeypatch.setattr(ld, "LIST", 2)
    texts = fuzzy_texts()
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_shuffled_text_lookup(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_ROWS", -1)
    texts = fuzzy_texts()[:15]
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_odd_tables(spark):
    assert ld.dedup_lines(empty(spark)).count() == 0
    line = "one two three four five six"
    rows = docs(spark, [line, line + "\nb"]).union(docs(spark, [line]))
    assert sorted((r.doc_id, r.text) for r in ld.dedup_lines(rows).collect()) == [(0, line), (0, line), (1, "b")]
    nulls = rows.selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")
    assert {r.line_dedup.n_removed for r in ld.dedup_lines(nulls).collect()} == {0}
    all_gone = docs(spark, [line, line + "\n" + line])
    assert {r.doc_id: r.text for r in ld.dedup_lines(all_gone).collect()} == {0: line, 1: ""}


def test_short_lines_take_part(spark):
    texts = ["All rights reserved.\nLes.\n--\n", "ALL RIGHTS RESERVED\nles\n--\n", "数据分析是一个重要的领域\nx", "数据分析是一个重要的领域。\ny"]
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "--\n", 2: texts[2], 3: "数据分析是一个重要的领域。\ny"}


@pytest.mark.parametrize("bound", ["MEMBERS", "MEMBER_BYTES"])
def test_lines_of_one_fingerprint_are_compared_in_blocks(spark, monkeypatch, bound):
    most = {"MEMBERS": 8, "MEMBER_BYTES": 400}[bound]
    monkeypatch.setattr(ld, bound, most)
    forest = ld._forest

    def watched(ids, *rest):
        assert len(ids) <= 40, "a whole fingerprint in one task"
        return forest(ids, *rest)

    monkeypatch.setattr(ld, "_forest", watched)
    r = random.Random(3)
    # More than half of the words are one number: every row has the fingerprint of that word.
    table = [" ".join(["12"] * 9 + ["".join(r.choice("abcdefgh") for _ in range(r.randrange(1, 9))) for _ in range(3)]) for _ in range(150)]
    texts = ["\n".join(table[i : i + 5]) for i in range(0, 150, 5)]
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs(spark, texts)).collect()}
    assert got == dict(enumerate(plain(texts)))


def test_replaced_and_moved_words_need_no_distance_table(monkeypatch):
    def never(*_):
        raise AssertionError("a table of distances for words that line up")

    r = random.Random(5)
    words = [b"w%d" % r.randrange(10**6) for _ in range(80)]
    monkeypatch.setattr(ld, "edit_distance", never)
    assert ld.similar(b" ".join(words), b" ".join([*words[:20], b"new", *words[20:50], b"other", *words[51:70], *words[72:]]), 0.8)


@pytest.mark.parametrize("seed", range(30))
def test_alignment_is_a_distance_or_more(seed):
    r = random.Random(seed)
    x = [r.choice([b"a", b"bc", b"def", "ü".encode()]) for _ in range(r.randrange(1, 40))]
    y = [w for w in x if r.random() < 0.9] + [b"end"] * r.randrange(2)
    r.random() < 0.3 and r.shuffle(y)
    got = ld.aligned(x, y, 30)
    assert got > 30 or got >= levenshtein(b" ".join(x), b" ".join(y))


@pytest.mark.parametrize("seed", range(6))
def test_distance_of_long_texts(seed):
    r = random.Random(seed)
    a = bytes(r.choice(b"abcdef ") for _ in range(r.randrange(150, 400)))
    b = bytearray(a) if seed % 2 else bytearray(r.choice(b"abcdef ") for _ in range(300))
    for _ in range(r.randrange(60)):
        b[r.randrange(len(b))] = r.choice(b"abcdef")
    d = levenshtein(a, bytes(b))
    for most in (d // 2, d - 1, d, d + 1, 400):
        got = ld.edit_distance(a, bytes(b), most)
        assert (got == d) if d <= most else (got > most)


def test_votes_of_long_runs():
    r = np.random.default_rng(2)
    hashes = r.integers(0, 1 << 63, 2_000, dtype=np.uint64) | np.uint64(1)
    first, last = np.array([0, 1, 256, 511, 767]), np.array([1, 256, 511, 767, 2_000])
    want = [[int((hashes[a:b] >> np.uint64(bit) & np.uint64(1)).sum()) for bit in range(64)] for a, b in zip(first, last, strict=True)]
    assert ld._votes(hashes, first, last).tolist() == want
