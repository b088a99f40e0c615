"""Hand-made event rows with known answers."""

import pytest
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators import lifecycle as L
from lobloom.plans import active_take, behavior, large_gap, primitives, retained, window_path
from lobloom.sources.readers import EVENT_SCHEMA

SCHEMA = "symbol string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA.fields)
NAMES = ["symbol", *EVENT_SCHEMA.names]


def events(spark, rows, symbol="SH600000", date=20260105):
    full = []
    for r in rows:
        d = dict.fromkeys(NAMES)
        d |= {"symbol": symbol, "date": date, **r}
        full.append(tuple(d[n] for n in NAMES))
    return spark.createDataFrame(full, SCHEMA)


def rows_of(names, raw):
    return [dict(zip(names.split(), x)) for x in raw]


def test_order_behavior_excludes_aggressor_remainders(spark):
    # Two resting orders; buyer 701 takes the seller and posts what is left; one trade row is repeated.
    raw = [
        (100500000, 11, "ORDER_ADD", 51, 700, None, "B", 600), (100600000, 12, "ORDER_ADD", 52, None, 800, "S", 250),
        (100700000, 13, "TRADE", 910, 701, 800, "B", 250), (100700000, 14, "ORDER_ADD", 53, 701, None, "B", 50),
        (100800000, 15, "TRADE", 911, 700, 801, "S", 100), (100800000, 16, "TRADE", 910, 701, 800, "B", 250)]
    names = "time row_id source_action source_recid source_buy_order_id source_sell_order_id source_side source_volume"
    r = behavior.order_behavior(events(spark, rows_of(names, raw))).first()
    assert (r.trade_qty, r.trade_count, r.aggr_order_count) == (350, 2, 2)
    assert (r.passive_submit_qty, r.passive_order_count) == (850, 2)
    assert (r.aggressive_order_add_qty_excluded, r.aggressive_order_add_count_excluded) == (50, 1)
    assert r.duplicate_trade_rows_excluded == 1
    assert r.is_valid and r.invalid_reason == ""
    assert r.single_size_ratio_log == pytest.approx(r.vr_log - r.cr_log)


def test_active_take_never_crosses_lunch(spark):
    # Mids 20.00, 19.97 (trade), 19.97 | 25.00, 25.02, 25.07 (trade): the step over lunch does not count.
    raw = [(94500000, 21, "ORDER_ADD", "S", [199900], [200100]), (95000000, 22, "TRADE", "S", [199500], [199900]),
           (111500000, 23, "CANCEL", "B", [199600], [199800]), (130500000, 24, "ORDER_ADD", "S", [249900], [250100]),
           (131000000, 25, "ORDER_ADD", "B", [250000], [250400]), (131500000, 26, "TRADE", "B", [250500], [250900])]
    ev = events(spark, rows_of("time row_id source_action source_side bid_px ask_px", raw), "SZ000333", 20260211)
    closes = spark.createDataFrame([("SZ000333", 20260211, 20.0, 1)], "symbol string, date int, close_1000 double, security_category int")
    r = active_take.active_take_daily(ev, closes).first()
    assert r.active_take_mid_gap == pytest.approx(0.08)
    assert r.active_take_mid_gap_over_1000_close == pytest.approx(0.004)
    assert r.active_take_mid_events == 2
    assert r.all_mid_gap == pytest.approx(0.10)
    assert (r.am_valid_lag_events, r.pm_valid_lag_events) == (2, 2)


def test_retained_impact_of_a_sell_episode(spark):
    # Order 9 sells twice and moves the mid from 50.10 to 49.90; it comes back to 49.95, then to 50.10.
    raw = [(94000000, 31, "ORDER_ADD", None, 9, "S", 500000, 800, "NA", [500000], [502000]),
           (94000100, 32, "TRADE", 71, 9, "S", 500000, 300, "FULL", [499000], [501000]),
           (94000300, 33, "TRADE", 72, 9, "S", 499000, 200, "FULL", [498000], [500000]),
           (94003000, 34, "ORDER_ADD", 73, None, "B", 498500, 400, "NA", [498500], [500500]),
           (94006500, 35, "ORDER_ADD", 74, None, "B", 500000, 400, "NA", [500000], [502000])]
    names = "time row_id source_action source_buy_order_id source_sell_order_id source_side source_price source_volume source_link_status bid_px ask_px"
    ev = events(spark, rows_of(names, raw), "SH601318", 20260119)
    cut = spark.createDataFrame([("SH601318", 20260119, 1200.0)], "symbol string, date int, mean_qty double")
    out = retained.retained_impact(ev, 1000.0, 5.0, thresholds=cut).filter(
        (F.col("window_name") == "daily_0930_close") & (F.col("threshold_version") == "mean_x05"))
    by = {(r.clock_type, r.horizon): r for r in out.collect()}
    one = by["event", 1]
    assert (one.episode_count, one.buy_episode_count, one.sell_episode_count) == (1, 0, 1)
    assert one.d07_permanent_ratio == pytest.approx(0.75)
    late = by["time", 5000]
    assert late.valid_retained_count == 1 and late.mean_elapsed_ms == pytest.approx(6200.0)
    assert late.d07_permanent_ratio == pytest.approx(0.0, abs=1e-9)


def test_trade_without_volume_keeps_an_episode_whole(spark):
    raw = [(100000000, 1, "ORDER_ADD", None, 5, "S", 700, [200000], [200200]), (100000100, 2, "TRADE", 61, 5, "S", 300, [199800], [200000]),
           (100000200, 3, "TRADE", 62, 5, "S", 0, [199800], [200000]), (100000300, 4, "TRADE", 63, 5, "S", 100, [199600], [199800])]
    names = "time row_id source_action source_buy_order_id source_sell_order_id source_side source_volume bid_px ask_px"
    rows = [r | {"source_price": 200000} for r in rows_of(names, raw)]
    cut = spark.createDataFrame([("SH600000", 20260105, 100.0)], "symbol string, date int, mean_qty double")
    out = retained.retained_impact(events(spark, rows), 1000.0, 5.0, thresholds=cut).filter(
        (F.col("window_name") == "daily_0930_close") & (F.col("threshold_version") == "mean_x05"))
    assert {r.episode_count for r in out.collect()} == {1}


SELLS = [(41, 100100000, "ORDER_ADD", "S", 20020, 800, 20000, 20020, None, None), (42, 100102000, "TRADE", "S", 20000, 150, 19980, 20020, 31, 45),
         (43, 100103000, "TRADE", "S", 19980, 250, 19960, 20020, 32, 45), (44, 100109000, "ORDER_ADD", "B", 19980, 120, 19980, 20020, None, None),
         (45, 100111000, "TRADE", "S", 19980, 120, 19960, 20020, 33, 46), (46, 100145000, "ORDER_ADD", "S", 20020, 90, 20000, 20020, None, None)]


def book_events(spark, rows=SELLS):
    out = []
    for rid, time, act, side, px, vol, bid, ask, buy, sell in rows:
        out.append(dict(
            row_id=rid, time=time, source_action=act, source_side=side, source_price=px, source_volume=vol, source_recid=rid,
            source_buy_order_id=buy, source_sell_order_id=sell, bid_px=[bid, bid - 20, bid - 40], ask_px=[ask, ask + 20, ask + 40],
            bid_vol=[700, 900, 1100], ask_vol=[800, 950, 1250], bid_cnt=[4, 6, 7], ask_cnt=[5, 5, 8]))
    return events(spark, out)


def test_chains_quotes_and_impacts(spark):
    p = primitives.primitives(book_events(spark))
    r = primitives.signal_row(p).first()
    assert r.active_sell_count == 3 and r.multi_trade_chain_count == 1 and r.chain_count == 2
    assert r.new_quote_count == 1 and r.missing_active_order_id == 0 and r.impact_observations_5s > 0
    chain = {c.order_id: c for c in p["chains"].collect()}
    assert (chain[45].trade_count, chain[45].volume, chain[46].trade_count) == (2, 400, 1)
    q = p["quotes"].first()
    assert (q.side, q.rehit) == ("B", 1)


def test_crossed_stretch_gives_one_impact(spark):
    # The first trade leaves a crossed book, the second one a valid book: one step from 3.001 to 2.9995.
    rows = [(51, 101000000, "ORDER_ADD", "S", 30020, 60, 30000, 30020, None, None), (52, 101002000, "TRADE", "S", 30000, 60, 30000, 29980, 61, 71),
            (53, 101002400, "TRADE", "S", 29980, 40, 29970, 30020, 62, 71)]
    p = primitives.primitives(book_events(spark, rows))
    a = p["atomic"].collect()
    assert len(a) == 1 and a[0].one_sided and abs(a[0].immediate) == pytest.approx(15.0)
    assert p["trades"].filter("atomic").count() == 2


def test_theta_is_the_median_of_five_market_days(spark):
    days = [20260302, 20260303, 20260304, 20260305, 20260306, 20260309]
    rows = [("SZ300750", d, v, 40) for d, v in zip(days, (4.0, 8.0, 6.0, 2.0, 15.0, 12.0))] + [("SH600519", 20260309, 7.0, 40)]
    sp = spark.createDataFrame(rows, "symbol string, date int, daily_typical_spread_raw double, valid_spread_snapshots long")
    t = {(r.symbol, r.date): (r.theta_5d_raw, r.theta_history_days) for r in large_gap.theta(sp).collect()}
    assert t["SZ300750", 20260309] == (6.0, 5)
    assert t["SZ300750", 20260306] == (None, 4)
    assert t["SH600519", 20260309] == (None, 0)


def test_nesting_is_checked_on_each_side(spark):
    # Flow of one minute exceeds that of five on the buy side; the sell side hides it in the total.
    cols = {"symbol": "'SZ000001'", "date": "20260105", "signal_time": "1030L", "book30m_coverage_ratio": "1.0D", "book5m_coverage_ratio": "0.5D", "invalid_chain_seconds": "0.0D"}
    for m, buy, sell in ((1, 50, 0), (5, 10, 90), (30, 60, 90)):
        cols |= {f"flow{m}m_buy_volume": f"{buy}L", f"flow{m}m_sell_volume": f"{sell}L"}
    for m in (1, 5, 10):
        cols |= {f"future{m}m_{k}": f"{m}L" for k in ("buy_volume", "sell_volume", "event_count")}
    r = window_path.quality_report(spark.range(1).selectExpr(*[f"{v} AS {k}" for k, v in cols.items()])).first()
    assert (r.bad_signal_nesting, r.bad_target_nesting, r.incomplete_5m_coverage, r.sz_rows, r.dates) == (1, 0, 1, 1, 1)


@pytest.mark.parametrize("cap,price,symbol,want", [
    (1.0, 3.5, "SZ002415", "low_lt10"), (700000.0, 25.0, "SH601318", "mid_ge10"), (9000000.0, 4.0, "SH601398", "high_lt10"),
    (6000000.0, 80.0, "SH688981", "high_star"), (6000000.0, 8.0, "SH688981", None)])
def test_domains(spark, cap, price, symbol, want):
    df = spark.createDataFrame([(cap, price, symbol)], "cap double, price double, symbol string")
    assert df.select(X.domain_of("cap", "price").alias("d")).first().d == want


def test_identity_is_side_and_number(spark):
    rows = [dict(row_id=1, time=93000000, source_action="ORDER_ADD", source_side="B", source_buy_order_id=7, source_volume=100, source_price=1),
            dict(row_id=2, time=93000001, source_action="TRADE", source_side="S", source_buy_order_id=9, source_sell_order_id=7, source_volume=50, source_price=1)]
    o = {(r.side, r.order_id): (r.original_qty, r.is_active) for r in L.reconstruct_orders(events(spark, rows)).collect()}
    assert o == {("B", 7): (100.0, False), ("S", 7): (50.0, True)}


def test_remainder_published_after_its_trades(spark):
    rows = [dict(row_id=1, time=93000000, source_action="TRADE", source_side="B", source_buy_order_id=7, source_sell_order_id=1, source_volume=300, source_price=1),
            dict(row_id=2, time=93000000, source_action="ORDER_ADD", source_side="B", source_buy_order_id=7, source_volume=200, source_price=1),
            dict(row_id=3, time=93000001, source_action="TRADE", source_side="B", source_buy_order_id=7, source_sell_order_id=1, source_volume=50, source_price=1)]
    r = L.reconstruct_orders(events(spark, rows)).first()
    assert r.original_qty == 500.0 and r.trade_before_add


def test_book_path_weights_by_duration(spark):
    def row(rid, time, bid_vol, ask_vol):
        return dict(row_id=rid, time=time, source_action="ORDER_ADD", source_side="B", source_volume=1, source_price=1,
                    bid_px=[100 - i for i in range(10)], ask_px=[101 + i for i in range(10)], bid_vol=[bid_vol] * 10, ask_vol=[ask_vol] * 10,
                    bid_cnt=[1] * 10, ask_cnt=[1] * 10)
    ev = events(spark, [row(1, 95900000, 300, 100), row(2, 101500000, 100, 300), row(3, 103100000, 100, 100)])
    b = {r.window: r for r in window_path.book_path(window_path.path_rows(ev)).collect()}
    assert b["book30m"].coverage_ratio == pytest.approx(1.0)
    assert b["book30m"].bi3_twap == pytest.approx(0.0)
    assert b["book5m"].bi3_twap == pytest.approx(-0.5)
    runs = window_path.imbalance_runs(window_path.path_rows(ev)).first()
    assert (runs.book_sign_flips, runs.longest_positive_seconds, runs.longest_negative_seconds) == (1, 900.0, 900.0)


def test_same_result_for_any_partitioning(spark):
    ev = book_events(spark)
    a = active_take.active_take_ratio(ev.repartition(1)).collect()
    b = active_take.active_take_ratio(ev.repartition(9)).collect()
    assert a == b
