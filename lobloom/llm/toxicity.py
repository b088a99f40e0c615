"""Toxicity severity by cumulative-link (proportional-odds) ordinal regression.

Labels say toxic or not. Grade 0 is not toxic; toxic training documents are split
into grades 1 and 2 at the median of how many toxic-leaning features they hold.
With one weight per feature and ordered thresholds, ``P(grade > j) = sigmoid(w.x - t_j)``;
all thresholds share ``w``. The result is the expected severity, the sum of these
probabilities, and a document is toxic if ``P(grade > 0)`` reaches ``REJECT``.

Features are sparse: lower-cased words and word beginnings of 5 to 8 bytes, hashed
into 2^18 buckets, with ``1 + log(count)`` as value. Only buckets whose document
frequency differs between toxic and other documents (z-score of at least
``Z_SCORE``) get a weight, ``FEATURES`` at most.

Training uses at most ``SAMPLE`` labelled documents, those with the smallest hash
of their id, so it is the same for every partitioning; feature counts are
aggregated where the rows are, and the driver fits the few selected columns.
Scoring covers every row and whole texts, where they are read: no shuffle.

Defined cases: null and empty texts have no features; labels with a null id or
null ``toxic`` are left out; an id with several labels is toxic if one says so;
with no labels, or only one kind, no document is toxic; rows are scored one by one; other columns are carried.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import result_name
from .textbatch import Words, column_chunks, runs_hash

BITS = 18
PREFIXES = (5, 6, 7, 8)
SAMPLE = 8_000
FEATURES = 4_096
Z_SCORE = 5.0
LEAST_DOCUMENTS = 4
GRADES = 3
REJECT = 0.5
RIDGE = 0.3
STEPS = 300


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence of a chunk."""
    size = w.ends - w.starts
    words = np.arange(len(size))
    at, hashes = [words], [w.hashes]
    for n in PREFIXES:
        long = words[size > n]
        at.append(long)
        hashes.append(runs_hash(w.low, w.starts[long], w.starts[long] + n) ^ np.uint64(n))
    return w.doc_of(np.concatenate(at)), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _counts(doc: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, n = np.unique((doc << BITS) | bucket, return_counts=True)
    return key >> BITS, key & ((1 << BITS) - 1), n


@dataclass
class Model:
    weights: np.ndarray  # one for each bucket, mostly 0
    thresholds: np.ndarray  # increasing

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each score (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(-(score[:, None] - self.thresholds[None, :])))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, columns: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds with the largest ridge-penalised likelihood (limited-memory BFGS)."""
    n, cuts = len(grade), grades - 1

    def thresholds(x):
        # t_0, t_0 + exp(g_1), ...: ordered whatever the parameters are
        return x[columns] + np.concatenate([[0.0], np.cumsum(np.exp(x[columns + 1 :]))])

    def loss(x):
        w, t = x[:columns], thresholds(x)
        eta = np.bincount(row, value * w[col], n)
        upper = np.where(grade < cuts, _sigmoid(t[np.minimum(grade, cuts - 1)] - eta), 1.0)
        lower = np.where(grade > 0, _sigmoid(t[np.maximum(grade, 1) - 1] - eta), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        at_t = np.array([
            np.sum((upper * (1 - upper) / p)[grade == j]) - np.sum((lower * (1 - lower) / p)[grade == j + 1]) for j in range(cuts)])
        up = np.concatenate([
            np.bincount(col, value * (upper + lower - 1)[row], columns) - RIDGE * w, [at_t.sum()],
            [at_t[j + 1 :].sum() * np.exp(g) for j, g in enumerate(x[columns + 1 :])]])
        return RIDGE / 2 * (w @ w) - np.log(p).sum(), -up

    share = np.clip([np.mean(grade > j) for j in range(cuts)], 1e-6, 1 - 1e-6)
    first = -np.log(share / (1 - share))
    x = np.concatenate([np.zeros(columns), first[:1], np.log(np.maximum(np.diff(first), 1e-2))])
    value_now, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(STEPS):
        d, alphas = -g, []
        for s, y, rho in reversed(past):
            alphas.append(rho * (s @ d))
            d = d - alphas[-1] * y
        if past:
            s, y, _ = past[-1]
            d = d * ((s @ y) / (y @ y))
        else:
            d = d / max(1.0, np.linalg.norm(d))
        for (s, y, rho), a in zip(past, reversed(alphas), strict=True):
            d = d + (a - rho * (y @ d)) * s
        step, slope = 1.0, g @ d
        while True:
            value_new, g_new = loss(x + step * d)
            if value_new <= value_now + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * d, g_new - g
        done = value_now - value_new < 1e-9 * n
        x, value_now, g = x + s, value_new, g_new
        if done:
            break
        if s @ y > 1e-12:
            past = [*past[-9:], (s, y, 1 / (s @ y))]
    return x[:columns], thresholds(x)


def marked(labels: DataFrame) -> DataFrame:
    """(doc_id, bad) of labels(doc_id, toxic)."""
    return labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Trains on at most ``sample`` documents of ``labels(doc_id, toxic)``."""
    none = Model(np.zeros(1 << BITS, np.float32), np.full(GRADES - 1, 40.0))
    chosen = marked(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most ``sample`` small rows
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def features(batches):
        for b in batches:
            bad = np.asarray(b.column(2))
            for first, texts in column_chunks(b.column(1)):
                doc, bucket, n = _counts(*_buckets(Words(texts)))
                split = np.searchsorted(doc, np.arange(1, len(texts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bad[first : first + len(texts)].astype(np.int32)), pa.array(np.split(bucket.astype(np.int32), split), pa.list_(pa.int32())),
                     pa.array(np.split(n.astype(np.int32), split), pa.list_(pa.int32()))], names=["bad", "buckets", "counts"])

    table = stage(rows.select("doc_id", "text", "bad").mapInArrow(features, "bad int, buckets array<int>, counts array<int>"), "features")
    table = table.withColumn("row", F.monotonically_increasing_id())  # of written rows
    sizes = {r["bad"]: r["n"] for r in table.groupBy("bad").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return none
    seen = table.select("bad", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(
        F.sum((F.col("bad") > 0).cast("long")).alias("a"), F.sum((F.col("bad") == 0).cast("long")).alias("b"))
    p = (F.col("a") + F.col("b")) / F.lit(bad + good)
    z = (F.col("a") / bad - F.col("b") / good) / F.sqrt(p * (1 - p) * (1 / bad + 1 / good))
    found = [(r["bucket"], r["z"] > 0) for r in seen.where((F.col("a") + F.col("b") >= LEAST_DOCUMENTS) & (p < 1)).select("bucket", z.alias("z"))
              .where(F.abs("z") >= Z_SCORE).orderBy(F.desc(F.abs("z")), "bucket").limit(FEATURES).collect()]
    picked, leaning = [b for b, _ in found], np.array([p for _, p in found], bool)
    if not picked:
        return none
    number = {b: i for i, b in enumerate(picked)}
    pairs = table.select("row", "bad", F.arrays_zip("buckets", "counts").alias("f"))
    # Every sampled row stays, with the selected features only: bounded by sample times features.
    keep = docs.sparkSession.createDataFrame([(b,) for b in picked], "bucket int")
    held = pairs.select("row", F.explode("f").alias("x")).join(F.broadcast(keep), F.col("x.buckets") == F.col("bucket"))
    held = held.groupBy("row").agg(F.collect_list("x").alias("f"))
    slim = table.select("row", "bad").join(held, "row", "left").select("bad", "f")
    row, col, value, bad = [], [], [], []
    for i, r in enumerate(slim.collect()):
        bad.append(r["bad"])
        for x in r["f"] or ():
            row.append(i)
            col.append(number[x["buckets"]])
            value.append(1 + np.log(x["counts"]))
    row, col, grade = np.array(row, np.int64), np.array(col, np.int64), np.array(bad)
    evidence = np.bincount(row, leaning[col], len(grade))
    grade[(grade > 0) & (evidence > np.median(evidence[grade > 0]))] = 2
    w, thresholds = fit_ordinal(row, col, np.array(value), grade, len(picked))
    weights = np.zeros(1 << BITS, np.float32)
    weights[picked] = w
    return Model(weights, thresholds)


def score(docs: DataFrame, model: Model, reject: float = REJECT, text: str = "text") -> DataFrame:
    """Adds struct ``toxicity`` (severity, grade, p_toxic, toxic) to ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 floats
    at = docs.columns.index(text)
    result = T.StructType([T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()),
                           T.StructField("p_toxic", T.DoubleType()), T.StructField("toxic", T.BooleanType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(result_name(docs, "toxicity"), result)])

    def judge(batches):
        m = shared.value
        for b in batches:
            scores = np.zeros(b.num_rows)
            for first, texts in column_chunks(b.column(at)):
                doc, bucket = _buckets(Words(texts))
                hit = m.weights[bucket] != 0
                doc, bucket, n = _counts(doc[hit], bucket[hit])
                scores[first : first + len(texts)] = np.bincount(doc, m.weights[bucket] * (1 + np.log(n)), len(texts))
            above = m.above(scores)
            grade = np.round(above).sum(axis=1).astype(np.int32)  # the median grade
            struct = pa.StructArray.from_arrays(
                [pa.array(above.sum(axis=1)), pa.array(grade), pa.array(above[:, 0]), pa.array(above[:, 0] >= reject)], names=result.names)
            yield pa.RecordBatch.from_arrays([*b.columns, struct], names=schema.names)

    return docs.mapInArrow(judge, schema)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the model finds toxic."""
    name = result_name(docs, "toxicity")
    return score(docs, fit(docs, labels)).where(~F.col(f"{name}.toxic")).drop(name)
