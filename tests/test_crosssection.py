"""Ranks, quantiles and residuals against direct computation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lobloom.operators import crosssection as C
from lobloom.operators import history as H
from lobloom.plans import evaluation as E


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(11)
    rows = [(d, f"S{i:03d}", float(rnd.randint(0, 12)), rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)) for d in (1, 2) for i in range(57)]
    rows.append((3, "S000", 1.0, 0.1, 0.2, 0.3))
    return rows, spark.createDataFrame(rows, "date int, symbol string, x double, y double, s1 double, s2 double").repartition(6).cache()


@pytest.mark.parametrize("one_in", [1, 2, 16_384])
def test_position_is_exact_for_any_sample(panel, one_in):
    rows, df = panel
    got = {(r.date, r.symbol): (r.pos, r.n) for r in C.position(df, ["date"], [F.col("x"), F.col("symbol")], total="n", one_in=one_in).collect()}
    for d in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]))
        for i, r in enumerate(mine):
            assert got[d, r[1]] == (i + 1, len(mine))


def test_rank_modes(panel):
    rows, df = panel
    for mode in ("pct_half", "pct_zero", "open", "centred", "pos"):
        got = {(r.date, r.symbol): r.p for r in C.percentile_rank(df, ["date"], "x", mode, out="p").collect()}
        for d in (1, 2, 3):
            mine = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]))
            n = len(mine)
            for i, r in enumerate(mine):
                same = [k for k, q in enumerate(mine) if q[2] == r[2]]
                rank = sum(same) / len(same) + 1
                want = {"pct_half": (rank - 1) / (n - 1) if n > 1 else 0.5, "pct_zero": (rank - 1) / (n - 1) if n > 1 else 0.0,
                        "open": rank / (n + 1), "centred": rank / (n + 1) - 0.5, "pos": i / (n - 1) if n > 1 else 0.0}[mode]
                assert got[d, r[1]] == pytest.approx(want)


def test_buckets_and_deciles(panel):
    rows, df = panel
    b = {(r.date, r.symbol): r.bucket for r in C.equal_buckets(df, ["date"], "x", 4).collect()}
    dec = {(r.date, r.symbol): r.decile for r in C.slice_deciles(df, ["date"], "x").collect()}
    for d in (1, 2):
        mine = sorted((r for r in rows if r[0] == d), key=lambda r: (r[2], r[1]))
        n = len(mine)
        for i, r in enumerate(mine):
            assert b[d, r[1]] == 4 * i // n
            k = next(k for k in range(10) if k * n // 10 <= i < (k + 1) * n // 10)
            assert dec[d, r[1]] == k + 1


def test_quantiles_and_winsorise(panel):
    rows, df = panel
    w = {(r.date, r.symbol): r.w for r in C.winsorise(df, ["date"], {"w": "y"}, 0.05, 0.9).collect()}
    for d in (1, 2):
        ys = np.array([r[3] for r in rows if r[0] == d])
        lo, hi = np.quantile(ys, 0.05), np.quantile(ys, 0.9)
        for r in rows:
            if r[0] == d:
                assert w[d, r[1]] == pytest.approx(min(max(r[3], lo), hi))


def test_residuals_are_orthogonal_and_drop_twins(panel):
    rows, df = panel
    d2 = df.filter("date < 3").withColumn("twin", F.col("s1") * 2 + 1)
    res = C.residualise(d2, ["date"], {"e": ("y", ["s1", "twin", "s2"]), "e1": ("y", ["s1"])}, r2=True, sd=True, rank=True).collect()
    for d in (1, 2):
        mine = [r for r in res if r.date == d]
        e = np.array([r.e for r in mine])
        x = np.column_stack([np.ones(len(mine)), [r.s1 for r in mine], [r.s2 for r in mine]])
        y = np.array([r.y for r in mine])
        want = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.allclose(e, want, atol=1e-9)
        assert mine[0].e_rank == 2
        assert mine[0].e_r2 == pytest.approx(1 - want.var() / y.var())
        assert mine[0].e_sd == pytest.approx(want.std())


def test_newey_west_lag_zero_is_plain_t(spark):
    v = [0.3, -0.1, 0.5, 0.2, -0.4, 0.6]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "k string, date int, v double")
    t0 = E.newey_west(df, ["k"], "v", 0).first()
    assert t0.t == pytest.approx(np.mean(v) / (np.std(v, ddof=1) / np.sqrt(len(v))))
    c = np.array(v) - np.mean(v)
    lr = (c @ c + 2 * 0.5 * (c[1:] @ c[:-1])) / len(v)
    assert E.newey_west(df, ["k"], "v", 1).first().t == pytest.approx(np.mean(v) / np.sqrt(lr / len(v)))


def test_history_uses_only_the_past(spark):
    rnd = random.Random(5)
    v = [rnd.gauss(0, 1) for _ in range(30)]
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(v)], "symbol string, date int, v double")
    s = H.surprise(df, ["symbol"], {"s": "v"}, 8)
    s = H.recursive_ewma(s, ["symbol"], "v", 3, "e3")
    s = H.persistence(s, ["symbol"], "v", "p")
    got = {r.date: r for r in s.collect()}
    ewma = None
    for i, x in enumerate(v):
        past = v[max(0, i - 8):i]
        if len(past) < 8:
            assert got[i].s is None
        else:
            c = past[0]
            for y in past[1:]:
                c = 2 / 9 * y + 7 / 9 * c
            assert got[i].s == pytest.approx((x - c) / np.std(past))
        ewma = x if ewma is None else 0.5 * x + 0.5 * ewma
        assert got[i].e3 == pytest.approx(ewma)
        run = 1
        while i - run >= 0 and (v[i - run] > 0) == (x > 0):
            run += 1
        assert got[i].p_same_sign_run_length == run
    changed = df.withColumn("v", F.when(F.col("date") >= 20, 99.0).otherwise(F.col("v")))
    again = {r.date: r.s for r in H.surprise(changed, ["symbol"], {"s": "v"}, 8).collect()}
    assert all(again[i] == got[i].s for i in range(20))


def test_hysteresis_matches_loop(spark):
    rnd = random.Random(9)
    rows = [(f"s{k}", d, rnd.random()) for k in range(6) for d in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date int, p double")
    got = {(r.symbol, r.date): r.held for r in H.hysteresis(df, ["symbol"], F.col("p") >= 0.8, F.col("p") >= 0.5).collect()}
    for k in range(6):
        held = False
        for s, d, p in sorted(r for r in rows if r[0] == f"s{k}"):
            held = p >= 0.5 if held else p >= 0.8
            assert got[s, d] == held


@pytest.mark.parametrize(("one_in", "wide"), [(4, 2), (2, 8), (64, 4)])
def test_position_with_two_levels_of_ranges(spark, monkeypatch, one_in, wide):
    monkeypatch.setattr(C, "WIDE", wide)
    df = spark.range(6000).select(
        (F.col("id") % 17 == 0).cast("int").alias("g"), (F.xxhash64("id") % 500).alias("x"), F.col("id").alias("k"), (F.col("id") % 3).alias("w"))
    got = C.position(df, ["g"], [F.col("x"), F.col("k")], weight="w", total="n", one_in=one_in).toPandas()
    got = got.sort_values(["g", "x", "k"])
    want = got.groupby("g")["w"]
    assert len(got) == 6000 and (got["pos"] == want.cumsum()).all() and (got["n"] == want.transform("sum")).all()
