import re

import pytest
from helpers import docs, empty, odd_texts, prose
from pyspark.sql import types as T

from lobloom.llm import decontaminate as dc

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(texts, items, width=10):
    wins = {}
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[tuple(w[k : k + n])]
        out.append((len(w), len(hit), sorted(i for i in found if i is not None)))
    return out


def case(spark):
    long = prose(21, 60)
    items = [(1, long), (2, " ".join(words(long)[5:30])), (3, "Unique short item"), (4, None), (5, ""), (None, "null named item"), (3, "Unique short item"), (7, "naïve ÜBER x")]
    texts = [*odd_texts(), "before. " + long.upper() + " after", "so UNIQUE, short. item here", " ".join(words(long)[3:12]), " ".join(words(long)[3:13]),
             "a null named item", "naïve über x", "naïve Über x", prose(50, 30) + " unique short item " + prose(51, 2000)]
    return texts, items, docs(spark, texts, extra=True), spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("held", [10_000, 3])
def test_counts_and_items(spark, held):
    texts, items, d, b = case(spark)
    got = {r.doc_id: r.decontamination for r in dc.scan(d, b, broadcast_windows=held).collect()}
    assert {k: (r["n_words"], r["n_hit"], list(r["items"])) for k, r in got.items()} == dict(enumerate(plain(texts, items)))


def test_removal(spark):
    texts, items, d, b = case(spark)
    want = plain(texts, items)
    kept = dc.decontaminate(d, b)
    assert kept.columns == d.columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: t for i, t in enumerate(texts) if not want[i][1]}
    spans = {r.doc_id: r.text for r in dc.decontaminate(d, b, remove="spans").collect()}
    assert len(spans) == len(texts)
    for i, t in enumerate(texts):
        if not want[i][1]:
            assert spans[i] == t
        else:
            assert len(words(spans[i])) == want[i][0] - want[i][1]


def test_empty(spark):
    texts, _, d, b = case(spark)
    assert dc.scan(empty(spark), b).count() == 0
    none = dc.scan(d, spark.createDataFrame([], ITEMS)).collect()
    assert len(none) == len(texts) and not any(r.decontamination.n_hit for r in none)
    twice = docs(spark, ["unique short item"]).union(docs(spark, ["unique short item"]))
    assert [r.decontamination.n_hit for r in dc.scan(twice, b).collect()] == [3, 3]
