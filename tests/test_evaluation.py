"""Scoped evaluation: plain windows and value ranges give the same scores."""

import math
import random

from lobloom.operators.crosssection import percentile_ranks
from lobloom.plans import evaluation as E
from lobloom.plans.studies import liquidity_scores


def table(spark):
    rnd = random.Random(2)
    rows = [(f"s{i:03}", d, rnd.choice("ab"), rnd.choice(("SH", "SZ")), rnd.choice((None, *range(9))), float(rnd.randint(0, 9)), rnd.choice((None, rnd.random())))
            for d in (1, 2) for i in range(90)]
    return spark.createDataFrame(rows, "symbol string, date int, domain string, exchange string, f int, g double, t double")


def test_whole_and_ranged_cross_sections_agree(spark):
    df = table(spark)
    got = [{tuple(r[k] for k in E.SCOPE_KEYS): (r.n, r.rank_ic, r.d10_d1) for r in E.evaluate(df, ["f", "g"], ["t", "g"], 10, whole).collect()} for whole in (True, False)]
    assert got[0].keys() == got[1].keys() and len(got[0]) > 20
    for k, a in got[0].items():
        assert a[0] == got[1][k][0] and all(math.isclose(x, y, abs_tol=1e-11) for x, y in zip(a[1:], got[1][k][1:], strict=True))


def test_a_cross_section_is_shuffled_once(spark):
    plan = E.evaluate(table(spark), ["f"], ["t"], 10, True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(scope") == 1


def test_only_counted_dates_are_sorted_whole(spark, monkeypatch):
    df = table(spark)
    assert E.fits(df)
    monkeypatch.setattr(E, "WHOLE", 89)
    assert not E.fits(df)


def test_a_split_is_evaluated_like_its_parts(spark):
    df = table(spark).selectExpr("*", "exchange as part")
    for whole in (True, False):
        got = E.evaluate(df, ["f"], ["t"], 5, whole, split="part").collect()
        for n in ("SH", "SZ", "all"):
            part = {tuple(r[k] for k in E.SCOPE_KEYS): (r.n, r.rank_ic, r.d10_d1) for r in got if r.part == n}
            rows = df if n == "all" else df.filter(df.part == n)
            want = {tuple(r[k] for k in E.SCOPE_KEYS): (r.n, r.rank_ic, r.d10_d1) for r in E.evaluate(rows, ["f"], ["t"], 5, whole).collect()}
            assert part.keys() == want.keys() and part
            assert all(a[0] == want[k][0] and all(math.isclose(x, y, abs_tol=1e-11) for x, y in zip(a[1:], want[k][1:], strict=True)) for k, a in part.items())


def test_plain_windows_give_the_percentile_ranks_of_value_ranges(spark):
    df = table(spark)
    got = [{tuple(r[k] for k in ("symbol", "date")): (r.a, r.b) for r in percentile_ranks(df, ["date", "domain"], {"a": "f", "b": "t"}, whole=w).collect()} for w in (True, False)]
    assert got[0] == got[1] and any(a is None for a, _ in got[0].values())


def test_liquidity_scores_shuffle_once(spark):
    df = table(spark).selectExpr("symbol", "date", "domain", "f as a", "g as b", "t as c", "f + g as d")
    plan = liquidity_scores(df, "a", "b", "c", "d", whole=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
