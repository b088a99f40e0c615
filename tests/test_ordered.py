"""Chunked operators must equal a plain loop, whatever the chunk size."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lobloom.operators.asof import asof
from lobloom.operators.decay import decayed_sums, decayed_sums_near
from lobloom.operators.lifecycle import islands
from lobloom.operators.ordered import carry_forward, dense_order, first_per_key, flag_first, rolling_dense, shift_dense, span_of


def rows_of(n=120, seed=1):
    rnd = random.Random(seed)
    out, rid = [], 0
    for _ in range(n):
        rid += rnd.choice((1, 1, 2, 7))
        out.append((rnd.choice("ab"), rid, rnd.choice((None, rnd.randint(1, 9))), rnd.randint(0, 3)))
    return out


@pytest.fixture(scope="module")
def data(spark):
    rows = rows_of()
    return rows, spark.createDataFrame(rows, "k string, row_id long, v long, c int").repartition(5).cache()


@pytest.mark.parametrize("span", [None, 3, 16, 10_000])
@pytest.mark.parametrize("backward", [False, True])
def test_carry_forward(data, span, backward):
    rows, df = data
    got = {
        (r.k, r.row_id): (r.last, r.total, r.top)
        for r in carry_forward(
            df, ["k"], last={"last": F.col("v")}, sums={"total": F.col("v")}, maxs={"top": F.col("v")},
            span=span, backward=backward).collect()
    }
    for key in "ab":
        last, total, top = None, 0, None
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[1], reverse=backward)
        for _, rid, v, _c in mine:
            assert got[key, rid] == (last, total, top)
            if v is not None:
                last, total, top = v, total + v, v if top is None else max(top, v)


@pytest.mark.parametrize("span", [4, 7, 1000])
def test_shift_and_rolling(data, span):
    rows, df = data
    d = dense_order(df, ["k"], span=5)
    s = shift_dense(d, ["k"], "seq", {"a": (F.col("row_id"), 3), "b": (F.col("row_id"), -2)}, span=span)
    r = rolling_dense(d, ["k"], "seq", 3, {"m": F.sum("c")}, span=span)
    got = {(x.k, x.seq): (x.a, x.b) for x in s.collect()}
    sums = {(x.k, x.seq): x.m for x in r.collect()}
    for key in "ab":
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: x[1])
        ids = [x[1] for x in mine]
        for i in range(len(ids)):
            a = ids[i + 3] if i + 3 < len(ids) else None
            b = ids[i - 2] if i >= 2 else None
            assert got[key, i + 1] == (a, b)
            want = [x[3] for x in mine[max(0, i - 3):i]]
            assert sums[key, i + 1] == (sum(want) if want else None)
    assert len(got) == len(rows)


@pytest.mark.parametrize("span", [2, 50, None])
def test_islands_end_on_any_other_row(spark, span):
    acts = ["T1", "T1", "C", "T1", "T2", "T2", "C", "C", "T2"]
    df = spark.createDataFrame([("x", i + 1, a[0] == "T", a) for i, a in enumerate(acts)], "k string, row_id long, t boolean, a string")
    got = {r.row_id: r.isle for r in islands(df, F.col("t"), [F.col("a")], ["k"], out="isle", span=span).collect()}
    assert [got[i] for i in range(1, 10)] == [1, 1, None, 2, 3, 3, None, None, 4]


@pytest.mark.parametrize("direction,strict", [("forward", False), ("forward", True), ("backward", False), ("backward", True)])
def test_asof_against_brute_force(spark, direction, strict):
    rnd = random.Random(7)
    ev = [("g", rnd.randint(0, 60), i) for i in range(40)]
    pr = [("g", rnd.randint(-5, 70), i) for i in range(60)]
    e = spark.createDataFrame(ev, "k string, t long, row_id long")
    p = spark.createDataFrame(pr, "k string, at long, i long")
    got = {r.i: r.hit for r in asof(p, e, ["k"], "at", "t", {"hit": F.col("row_id")}, direction=direction, strict=strict, span=4).collect()}
    for _, at, i in pr:
        if direction == "forward":
            ok = [x for x in ev if (x[1] > at if strict else x[1] >= at)]
            want = min(ok, key=lambda x: (x[1], x[2]))[2] if ok else None
        else:
            ok = [x for x in ev if (x[1] < at if strict else x[1] <= at)]
            want = max(ok, key=lambda x: (x[1], x[2]))[2] if ok else None
        assert got[i] == want


def test_decay_matches_recursion(spark):
    rnd = random.Random(3)
    t, rows = 0, []
    for i in range(200):
        t += rnd.choice((0, 5, 40, 900))
        rows.append(("s", i, t, rnd.choice((None, 100.0, 250.0))))
    df = spark.createDataFrame(rows, "k string, row_id long, ms long, v double")
    got = {r.row_id: r.x for r in decayed_sums(df, ["k"], "row_id", "ms", 500.0, {"x": F.col("v")}, block=1000, span=16).collect()}
    value, last = 0.0, None
    for _, i, ms, v in rows:
        if last is not None:
            value *= 2.0 ** (-(ms - last) / 500.0)
        value += v or 0.0
        last = ms
        assert math.isclose(got[i], value, rel_tol=1e-9, abs_tol=1e-9)


def test_first_rows_keep_null_keys(spark):
    df = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (None, 4, "c"), (None, 9, "d")], "r long, row_id long, p string")
    flags = {x.row_id: x.is_first for x in flag_first(df, ["r"]).collect()}
    assert flags == {5: False, 3: True, 4: True, 9: True}
    assert [tuple(x) for x in first_per_key(df.filter("r = 1"), ["r"], "row_id", ["p"]).collect()] == [(1, 3, "b")]


def test_near_decays_are_exact_wherever_they_stand(spark):
    # 150 values make three lists; sums by definition, and bit for bit where one value counts.
    rnd, t, no, rows = random.Random(5), 0, 0, []
    for i in range(400):
        t += rnd.choice((0, 5, 40, 900))
        held = rnd.random() < 0.4
        no += held
        rows.append(("s", i, t, no, held, rnd.choice("BS"), 100 * rnd.randint(1, 20)))
    rows += [(f"one{k}", i, 7_000 * k + i, i, i == 1, "B", 1700) for k in range(40) for i in (1, 2)]
    df = spark.createDataFrame([(*r[:3], min(r[3], 1) if r[0] != "s" else r[3], *r[4:]) for r in rows], "k string, row_id long, ms long, no long, held boolean, side string, v long")
    got = decayed_sums_near(df, ["k"], "no", F.col("held"), {s: F.col("side") == s for s in "BS"}, "v",
                            {"a": ("ms", 500.0, 1000), "b": ("no", 20.0, 200)}).collect()
    assert len(got) == len(rows)
    for g in (g for g in got if g.k == "s"):
        for s in "BS":
            past = [(r[2], r[3], r[6]) for r in rows if r[0] == "s" and r[4] and r[5] == s and r[3] <= g.no]
            assert math.isclose(g[f"a_{s}"], sum(v * 2.0 ** (-(g.ms - m) / 500.0) for m, _, v in past), rel_tol=1e-12)
            assert math.isclose(g[f"b_{s}"], sum(v * 2.0 ** (-(g.no - n) / 20.0) for _, n, v in past), rel_tol=1e-12)
    assert {g.a_B for g in got if g.k != "s" and g.row_id == 1} == {1700.0}
    assert len({g.a_B for g in got if g.k != "s" and g.row_id == 2}) == 1


@pytest.mark.parametrize("span, most", [(3, None), (2, 2)])
def test_plain_windows_only_for_counted_groups(spark, span, most):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 1)], "k string, row_id long")
    assert span_of(df, ["k"], span) == most
