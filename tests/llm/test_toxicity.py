import random

import numpy as np
from helpers import docs, empty, odd_texts
from pyspark.sql import types as T

from lobloom.llm import toxicity as tx

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])
BAD = ["rotten", "vile", "wretch"]


def corpus(n=600):
    r = random.Random(1)
    texts, toxic = [], []
    for i in range(n):
        w = [f"word{int(r.paretovariate(1.0)) % 300}" for _ in range(r.randrange(20, 120))]
        bad = i % 5 == 0
        for _ in range(r.randrange(2, 8) if bad else 0):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", ".", "!"]))
        texts.append(" ".join(w))
        toxic.append(int(bad))
    return texts, toxic


def test_gradient_fit_separates_and_orders():
    r = np.random.default_rng(0)
    x = r.integers(0, 4, (500, 3))
    grade = np.digitize(x @ [1, 2, 0] + r.normal(size=500) * 0.3, [2.5, 6.5])
    row, col = np.nonzero(x)
    w, t = tx.fit_ordinal(row, col, x[row, col].astype(float), grade, 3)
    assert w[1] > w[0] > abs(w[2]) and t[0] < t[1]
    above = tx.Model(w, t).above(x @ w)
    assert np.mean(np.round(above).sum(axis=1) == grade) > 0.85
    assert (np.diff(above, axis=1) <= 0).all()


def test_held_out_accuracy(spark):
    texts, toxic = corpus()
    d = docs(spark, texts + odd_texts(), extra=True)
    labels = spark.createDataFrame([(i, None, t) for i, t in enumerate(toxic[:400])] + [(None, 1, 1), (3, 0, None), (10**9, 1, 1)], LABELS)
    scored = tx.score(d, tx.fit(d, labels))
    assert scored.columns == [*d.columns, "toxicity"]
    got = {r.doc_id: r.toxicity for r in scored.collect()}
    held = range(400, 600)
    assert np.mean([got[i].toxic == bool(toxic[i]) for i in held]) > 0.97
    assert not any(got[i].toxic for i in range(600, 600 + len(odd_texts())))
    assert all(0 <= x.severity <= tx.GRADES - 1 and 0 <= x.p_toxic <= 1 for x in got.values())
    kept = tx.without_toxic(d, labels)
    assert kept.columns == d.columns and kept.count() == sum(not x.toxic for x in got.values())


def test_no_labels(spark):
    d = docs(spark, ["vile rotten", None])
    for rows in ([], [(0, 1, 0)], [(0, 1, 1)]):
        assert not any(r.toxicity.toxic for r in tx.score(d, tx.fit(d, spark.createDataFrame(rows, LABELS))).collect())
    assert tx.score(empty(spark), tx.fit(empty(spark), spark.createDataFrame([(0, 1, 1)], LABELS))).count() == 0
