"""Contrast tables against values worked out by hand."""

import math

from pyspark.sql import functions as F

from lobloom.plans import contrasts as C
from lobloom.plans import mechanism as M


def _stats(spark, rows):
    return spark.createDataFrame(
        [("all/all", m, v, g, s, d, float(x), float(w)) for m, v, g, s, d, x, w in rows],
        "domain string, mechanism string, variant string, group_key string, symbol string, date int, value_sum double, weight_sum double")


def _rows(df):
    return {r["contrast"]: r.asDict() for r in df.collect()}


def test_definitions_are_complete():
    assert len(C.state_contrasts()) == 2 * (5 + 8)
    assert len(C.heat_contrasts()) == 10
    assert len(C.quote_contrasts()) == 4 * (2 * 3 + 2 * 2 * 3)
    assert len(C.prepost_contrasts()) == 4 * 3 * 5
    for made in (C.state_contrasts(), C.heat_contrasts(), C.quote_contrasts(), C.prepost_contrasts()):
        assert len({(k.mechanism, k.name) for k in made}) == len(made)
    names = {k.name for k in C.state_contrasts()}
    assert {"trade_event_S_opposite_high_vs_low_fill_continuous", "B_own_high_vs_low_fill_60s", "sell_high_vs_low_bid_depth"} <= names


def test_paired_contrast(spark):
    flow = "n10_future_signed_volume"
    stats = _stats(spark, [
        ("M1", flow, "trigger=B|state=B0S0", "a", 1, 6, 2), ("M1", flow, "trigger=B|state=B1S0", "a", 1, 6, 2), ("M1", flow, "trigger=S|state=B0S0", "a", 1, 2, 2),
        ("M1", flow, "trigger=B|state=B0S0", "a", 2, 8, 1), ("M1", flow, "trigger=S|state=B0S0", "a", 2, 4, 1),
        ("M1", flow, "trigger=B|state=B0S0", "b", 1, 10, 1), ("M1", flow, "trigger=S|state=B0S0", "b", 1, 1, 1),
        ("M1", flow, "trigger=B|state=B0S0", "b", 2, 10, 1),  # the other leg is missing
        ("M1", "teh20_" + flow, "trigger=B|state=B0S0", "a", 1, 1, 1)])
    made = C.state_contrasts()
    got = _rows(C.paired(C.leg_values(stats, made), made))
    r = got["buy_vs_sell_same_direction_persistence"]
    assert (r["stock_days"], r["symbols"], r["dates"]) == (3, 2, 2)
    # Stock-day differences: 3 - 1, 8 - 4, 10 - 1.
    assert math.isclose(r["left_mean"], 7.0) and math.isclose(r["right_mean"], 2.0) and math.isclose(r["difference"], 5.0)
    assert math.isclose(r["difference_t"], 5.0 / math.sqrt(13.0 / 3.0))
    assert math.isclose(r["symbol_mean_difference"], 6.0) and math.isclose(r["symbol_t"], 2.0)
    assert math.isclose(r["date_mean_difference"], 4.75)
    # One leg only: a row without stock-days.
    lone = got["trade_event_buy_vs_sell_same_direction_persistence"]
    assert lone["stock_days"] == 0 and lone["difference"] is None and lone["symbols"] == 0
    assert set(got) == {"buy_vs_sell_same_direction_persistence", "trade_event_buy_vs_sell_same_direction_persistence"}


def test_equal_differences_have_t_zero(spark):
    stats = _stats(spark, [("M3", "n10_delta_heat", g, "a", d, v, 1) for d in (1, 2) for g, v in (("buy_up", 3), ("buy_non_up", 1))])
    made = C.state_contrasts()
    r = _rows(C.paired(C.leg_values(stats, made), made))["buy_up_vs_buy_non_up_delta_heat"]
    assert (r["difference"], r["difference_t"], r["ci95_lower"], r["ci95_upper"]) == (2.0, 0.0, 2.0, 2.0)
    assert r["symbol_t"] is None and r["date_t"] == 0.0


def test_within_symbol_contrast(spark):
    depth = "mean_log_total_depth3"
    stats = _stats(spark, [
        ("M5", depth, "heat=high|state=all", "a", 1, 4, 1), ("M5", depth, "heat=high|state=all", "a", 2, 6, 1), ("M5", depth, "heat=low|state=all", "a", 3, 2, 1),
        ("M5", depth, "heat=high|state=all", "b", 1, 7, 1), ("M5", depth, "heat=low|state=all", "b", 2, 6, 1),
        ("M5", depth, "heat=high|state=all", "c", 1, 9, 1)])
    made = C.heat_contrasts()
    r = _rows(C.within_symbol(C.leg_values(stats, made), made))["high_vs_low_heat_depth_all"]
    assert (r["stock_days"], r["symbols"], r["dates"], r["date_t"]) == (2, 2, None, None)
    assert (r["left_mean"], r["right_mean"], r["difference"], r["left_group"], r["right_group"]) == (6.0, 4.0, 2.0, "high/all", "low/all")


def test_no_rows(spark):
    made = C.quote_contrasts()
    assert C.paired(C.leg_values(_stats(spark, []), made), made).count() == 0


def test_statistics_deal_a_row_once_to_each_group(spark, monkeypatch):
    monkeypatch.setattr(M, "SLOTS", 3)
    df = spark.createDataFrame(
        [("s", 1, "B", 1.0, 2.0), ("s", 1, "B", None, float("nan")), ("s", 1, "S", 3.0, float("inf")), ("s", 2, None, 5.0, 6.0)],
        "symbol string, date int, side string, a double, b double")
    a, b, side = F.col("a"), F.col("b"), F.col("side")
    stats = [M.Stat("M", f"a{i}", side, a) for i in range(7)] + [M.Stat("M", "b", side, b), M.Stat("M", "b", "all", b, a > 1)]
    for span in (None, 10):
        dealt = M._stat_moments(df, stats, span)
        got = {(r.date, r.variant, r.group_key): (r.observations, r.value_sum, r.value_sq_sum, r.weight_sum) for r in dealt.collect()}
        want = {(d, f"a{i}", g): (1, v, v * v, 1.0) for i in range(7) for d, g, v in ((1, "B", 1.0), (1, "S", 3.0), (2, None, 5.0))}
        assert got == want | {(1, "b", "B"): (1, 2.0, 4.0, 1.0), (2, "b", None): (1, 6.0, 36.0, 1.0), (2, "b", "all"): (1, 6.0, 36.0, 1.0)}
    lead = M._stat_moments(df, [M.Stat("M", "x", side, a)], None, lead=F.lit("n5_"))
    assert {r.variant for r in lead.collect()} == {"n5_x"}
