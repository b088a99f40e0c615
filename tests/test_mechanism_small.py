"""Mechanism states: symbols of counted size in plain windows give the rows of the chunked form."""

import pytest

from lobloom.plans import mechanism as M
from lobloom.sources.derived import lob, sessions

WARM = 20240116


@pytest.fixture(scope="module")
def events(spark):
    return lob(spark, "/root/testdata/sf0.001", 500)


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def test_small_symbols_give_the_states_of_the_chunked_form(spark, events, monkeypatch):
    def run():
        r = M.run_mechanisms(events, WARM, "hl300", "teh20", 5, 1, 600)
        cols = ["symbol", "row_id", "seq", "trade_no", "is_trade", "mean_B", "mean_S", "hl300_B", "hl300_S", "teh20_B", "teh20_S", "mid", "pre"]
        return [rows(r["rows"].select(cols)), rows(r["states"].select("symbol", "row_id", "state_hl300", "state_teh20")),
                rows(r["cuts"].select(sorted(r["cuts"].columns))), rows(r["prices"].select("symbol", "row_id", "price_state")), rows(r["heat"])]

    small = run()
    monkeypatch.setattr(M, "bounds", lambda *_: (True, False))
    assert run() == small  # lists in blocks
    monkeypatch.setattr(M, "bounds", lambda *_: (False, False))
    monkeypatch.setattr(M, "span_of", lambda df, keys=(), span=16: 16)
    assert run() == small and all(small)


def test_bounds_count_symbols_and_trades(spark, events, monkeypatch):
    e, trade = sessions(events), events.source_action == "TRADE"
    most = max(r["count"] for r in e.groupBy("symbol").count().collect())
    trades = max(r["count"] for r in e.filter(trade).groupBy(*M.S).count().collect())
    for name, at, found in (("SPAN", most, 0), ("NEAR", trades, 1)):
        for less in (0, 1):
            monkeypatch.setattr(M, name, at - less)
            assert M.bounds(e, trade)[found] is (less == 0)


def test_rows_and_intensities_of_small_symbols_share_one_shuffle(spark, events):
    r = M._small_means(M.base_rows(events, small=True), 5)
    assert r._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_statistics_without_prices_leave_them_out(spark, events):
    assert "prices" not in M.run_mechanisms(events, WARM, "hl300", "teh20", 5, 1, 600, prices=False)
