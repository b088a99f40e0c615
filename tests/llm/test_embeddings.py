import numpy as np
import pytest
from helpers import smallest_reachable
from pyspark.sql import types as T

from lobloom.llm import embeddings as em

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def plain(rows, cosine=0.9):
    ok = [k for k, (i, v, _) in enumerate(rows) if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    x = {k: np.array(rows[k][1], np.float32).astype(np.float64) for k in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(x[a]) == len(x[b])
             and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= cosine]
    degree = {k: 0 for k in range(len(rows))}
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    group = smallest_reachable(range(len(rows)), pairs)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[group[k]] = min(least.get(group[k], i), i)
    return sorted(((i if i is not None else -1), degree[k], least.get(group[k]) if i is not None else None, i is not None and least[group[k]] == i) for k, (i, _, _) in enumerate(rows))


def table(n=400, dims=8, seed=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    rows = []
    for i in range(n):
        v = centres[r.integers(12)] + r.normal(size=dims) * r.choice([0.05, 0.3, 0.6])
        rows.append([i, v.astype(np.float32).tolist(), int(r.integers(3))])
    for i in range(0, 60, 2):
        rows[i + 1][1] = [x * (1 if i % 4 else 2.0) for x in rows[i][1]]
    rows += [[n, None, 0], [n + 1, [0.0] * dims, 0], [n + 2, [1.0, None, *[0.0] * (dims - 2)], None], [n + 3, [float("nan")] * dims, 0],
             [n + 4, [float("inf"), *[0.0] * (dims - 1)], 0], [n + 5, [1.0, 2.0], 0], [n + 6, [2.0, 4.0], 0], [None, rows[0][1], 0], [n + 7, [], 0]]
    return [tuple(x) for x in rows]


@pytest.mark.parametrize(("block", "pivots", "dims"), [(4096, 64, 8), (40, 64, 8), (64, 3, 3), (100, 8, 32)])
def test_against_all_pairs(spark, block, pivots, dims):
    rows = table(dims=dims)
    got = em.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block, pivots=pivots).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in got) == plain(rows)


def test_repeated_rows_and_empty(spark):
    assert em.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [3.0, 0.0], 1), (3, [0.0, 1.0], 1)]
    got = em.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]


def shuffled(spark):
    """Bytes that all stages so far have written to shuffle files."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_disk_grows_with_the_vectors_not_with_pairs_of_blocks(spark):
    n, dims = 4000, 8
    x = np.random.default_rng(5).normal(size=(n, dims)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    before = shuffled(spark)
    got = em.near_duplicates(df, block=50, pivots=4).agg({"n_links": "sum"}).first()[0]
    assert shuffled(spark) - before < 20 * x.nbytes
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert got == int((unit @ unit.T >= 0.9).sum()) - n


def test_forest_connects_what_the_links_connect():
    near = np.zeros((6, 5), bool)
    near[[0, 0, 2, 4, 5], [1, 3, 3, 0, 0]] = True
    top, end, column = em.forest(near)
    assert sorted(zip(top.tolist(), end.tolist(), column.tolist(), strict=True)) == [
        (0, 1, True), (0, 2, False), (0, 3, True), (4, 0, True), (4, 5, False)]
