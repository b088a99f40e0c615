import random

import numpy as np
import xxhash

from helpers import docs, empty, odd_texts, prose, smallest_reachable
from lobloom.llm import simhash
from lobloom.llm.tables import components


def plain_fingerprint(text, n):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, cur = [], ""
    for c in w:
        if c == " " or "\t" <= c <= "\r":
            words += [cur] if cur else []
            cur = ""
        else:
            cur += c
    words += [cur] if cur else []
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_matches_plain():
    for t in [*odd_texts(), prose(9, 300), "A\x0bB\x0cC\x1cD\x85E F", "one two", "one two three"]:
        assert simhash.fingerprint((t or "").encode(), 3) == plain_fingerprint(t, 3)


def test_components_and_fingerprints(spark):
    texts = odd_texts() + [prose(5, 200) + (" x" * k) for k in range(12)]
    got = simhash.near_duplicates(docs(spark, texts, extra=True), k=2, words=3).collect()
    fps = [plain_fingerprint(t, 3) for t in texts]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = smallest_reachable(range(len(fps)), pairs)
    assert {r.doc_id: (r.fingerprint % (1 << 64), r.component_id) for r in got} == {i: (f, want[i]) for i, f in enumerate(fps)}


def test_links_connect_all_close_fingerprints(spark):
    r = random.Random(4)
    seeds = [r.getrandbits(64) for _ in range(12)]
    fps = {s ^ sum(1 << b for b in set(r.choices(range(64), k=r.randrange(5)))) for s in seeds for _ in range(25)}
    fps = sorted(fps)
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)]
    for k in (1, 2, 3):
        found = components(simhash.links(spark.createDataFrame(rows, "fp long, rep long"), k).distinct()).collect()
        pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= k]
        want = smallest_reachable(range(len(fps)), pairs)
        got = {i: i for i in range(len(fps))} | {x.node: x.component for x in found}
        assert got == want


def test_null_ids_and_empty(spark):
    df = docs(spark, ["a b c d", "a b c d", "q r s t u v"]).selectExpr("CASE WHEN doc_id <> 1 THEN doc_id END AS doc_id", "text")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in simhash.near_duplicates(df, 2, 3).collect())
    assert got == [(False, 0, 0), (False, 2, 2), (True, None, 0)]
    assert simhash.near_duplicates(empty(spark), 2).count() == 0
