"""Roll-ups of quotes by relative depth, of the price x cap grid and of chains."""

from __future__ import annotations

from lobloom.catalog.base_queries import _CD, CONTROLS, SG, _features
from lobloom.catalog.book_queries import CH, PW, QT, RT
from lobloom.catalog.registry import query, rounded
from lobloom.catalog.sqlgen import fin
from lobloom.catalog.views import lob_views, sql
from lobloom.plans import primitives, summaries
from lobloom.session import stage
from lobloom.sources.derived import lob

V = lob_views()

# Stock-days of a bin: all quotes, and what is known of the closed ones.
_BIN = "CASE WHEN relative_depth<=0.1 THEN '01_<=0.10' WHEN relative_depth<=0.25 THEN '02_0.10-0.25' WHEN relative_depth<=0.5 THEN '03_0.25-0.50' WHEN relative_depth<=1 THEN '04_0.50-1.00' ELSE '05_>1.00' END"
QB = f"""qbn AS (SELECT symbol, date, {_BIN} AS depth_bin, rehit, censored_at_signal AS cs, lifetime_seconds AS life, restored_pre_event_book AS rs, removal_action='TRADE' AS rt FROM qlf WHERE relative_depth>=0),
qbd AS (SELECT symbol, date, depth_bin, count(*) AS n, avg(rehit) AS rehit_share, avg(rs) FILTER (cs=0) AS restored_share_closed, avg(rt::INTEGER) FILTER (cs=0) AS trade_removal_share_closed, avg(cs) AS censored_share, median(life) FILTER (cs=0)::DOUBLE AS median_lifetime_seconds FROM qbn GROUP BY ALL)"""
_BM = list(summaries.BIN_MEANS)


def _twice(src: str, keys: str, means: list[str], by: str, count: str = "", extra: str = "") -> str:
    """Means of a date first, then of dates."""
    part = "left(symbol,2)" if by == "exchange" else "NULL"
    avg = ", ".join(f"avg({m}) AS {m}" for m in means)
    label = "exchange" if by == "exchange" else "unnest([(date//100)::VARCHAR, 'ALL'])"
    inner = f"SELECT date, {part} AS exchange, {keys}, count(*) AS k{f', sum({count}) AS q' if count else ''}, {avg} FROM {src} GROUP BY ALL"
    total = ", sum(q)::BIGINT AS quote_events" if count else ""
    return f"SELECT lab AS {by}, {keys}, count(*) AS dates, sum(k)::BIGINT AS stock_days{total}, {avg}{extra} FROM (SELECT *, {label} AS lab FROM ({inner})) GROUP BY ALL"


def _bins(spark, sf):
    return stage(summaries.quote_day_bin(primitives.primitives(lob(spark, sf))["quotes"]), "quote-bins")


@query("f37_depth_bins", sql(V, PW, QT, QB, fin(_twice("qbd", "depth_bin", _BM, "month", "n", ", stddev_samp(rehit_share)/sqrt(count(*)) AS rehit_se"), " ".join([*_BM, "rehit_se"]))))
def f37_bins(spark, sf):
    return rounded(summaries.depth_bin_summary(_bins(spark, sf)))


@query("f37_depth_bins_by_exchange", sql(V, PW, QT, QB, fin(_twice("qbd", "depth_bin", _BM, "exchange", "n"), " ".join(_BM))))
def f37_bins_exchange(spark, sf):
    return rounded(summaries.depth_bin_summary(_bins(spark, sf), "exchange"))


_GM = list(summaries.GRID_MEANS)
_GRID = "(SELECT symbol, date, price_tercile, cap_tercile, " + ", ".join(f"{v} AS {n}" for n, v in summaries.GRID_MEANS.items()) + " FROM enr)"
_ALL = (V, CONTROLS, PW, CH, RT, QT, SG)


@query("f37_liquidity_grid", sql(*_ALL, fin(_twice(_GRID, "price_tercile, cap_tercile", _GM, "month"), " ".join(_GM))))
def f37_grid(spark, sf):
    return rounded(summaries.liquidity_grid(_features(spark, sf)[2]))


@query("f37_liquidity_grid_by_exchange", sql(*_ALL, fin(_twice(_GRID, "price_tercile, cap_tercile", _GM, "exchange"), " ".join(_GM))))
def f37_grid_exchange(spark, sf):
    return rounded(summaries.liquidity_grid(_features(spark, sf)[2], "exchange"))


_CS = {
    "mean_chain_count": "chain_count", "mean_multi_chain_count": "multi_trade_chain_count", "mean_multi_chain_volume_share": "multi_trade_chain_volume_share",
    "mean_chain_volume_hhi": "chain_volume_hhi", "mean_chain_volume_entropy": "chain_volume_entropy", "mean_largest_chain_volume_share": "largest_chain_volume_share",
    "mean_chain_fragments": "mean_fragments", "mean_stock_day_p90_fragments": "p90_fragments", "mean_multi_chain_duration_seconds": "mean_multi_duration",
    "mean_stock_day_p90_duration_seconds": "p90_multi_duration", "mean_acceleration_seconds": "mean_acceleration"}


@query("f37_chain_structure", sql(*_ALL, f"cds AS ({_CD})", "csm AS (SELECT unnest([(date//100)::VARCHAR, 'ALL']) AS month, * FROM sgr LEFT JOIN (SELECT * EXCLUDE (chain_volume) FROM cds) USING (symbol, date))",
    fin("SELECT month, count(*) AS stock_days, count(DISTINCT date) AS dates, " + ", ".join(f"avg({v}) AS {n}" for n, v in _CS.items()) + " FROM csm GROUP BY 1", " ".join(_CS))))
def f37_chains(spark, sf):
    p = primitives.primitives(lob(spark, sf))
    signals = stage(primitives.signal_row(p), "signals")
    return rounded(summaries.chain_structure(signals, summaries.chain_day(p["chains"])))
