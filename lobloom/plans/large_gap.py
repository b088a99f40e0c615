"""Typical spreads, lagged thresholds and fills of orders placed far from the touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.lifecycle import (
    DAY, calendar, entry_gaps, match_passive, prebook, previous_row_book, trades_once,
)
from lobloom.sources.derived import sessions

DAILY = (X.AM_OPEN, X.PM_CLOSE)
INTRADAY = (100000000, 103000000)
COLUMNS = [
    "symbol", "date", "time", "row_id", "source_action", "source_recid", "source_side",
    "source_price", "source_volume", "source_buy_order_id", "source_sell_order_id",
    "bid_px", "ask_px",
]


def typical_spread(events: DataFrame) -> DataFrame:
    """Median best spread of strictly valid books per stock-day (raw price units)."""
    rows = events.filter(X.in_session() & X.book_ok("strict")).select(
        *DAY, (X.best("ask") - X.best("bid")).cast("double").alias("spread")
    )
    return rows.groupBy(*DAY).agg(
        F.median("spread").alias("daily_typical_spread_raw"),
        F.count(F.lit(1)).alias("valid_spread_snapshots"),
    )


def theta(spreads: DataFrame, days: int = 5, market: DataFrame | None = None) -> DataFrame:
    """Median of exactly the previous ``days`` market days, else NULL.

    ``market`` gives the trading dates; by default those present in ``spreads``.
    """
    ok = spreads.filter(F.col("daily_typical_spread_raw") > 0)
    cal = calendar(market if market is not None else ok)
    w = Window.partitionBy("symbol").orderBy("day_seq").rangeBetween(-days, -1)
    hist = ok.join(cal, "date").withColumns({
        "theta_history_days": F.count("daily_typical_spread_raw").over(w),
        # At most `days` values, so the ordered list stays tiny.
        "_v": F.sort_array(F.collect_list("daily_typical_spread_raw").over(w)),
    })
    middle = (F.col("_v")[(days - 1) // 2] + F.col("_v")[days // 2]) / 2.0
    return hist.select(
        *DAY, "daily_typical_spread_raw", "valid_spread_snapshots", "theta_history_days",
        F.when(F.col("theta_history_days") == days, middle).alias("theta_5d_raw"),
    )


def matched_trades(events: DataFrame, mode: str = "last_valid") -> DataFrame:
    """De-duplicated session trades with the entry gap of the order they hit.

    ``last_valid`` measures the gap from the last valid book, ``previous_row``
    from the best prices of the row before.
    """
    rows = sessions(events.select(*COLUMNS))
    pre = prebook(rows, "strict") if mode == "last_valid" else previous_row_book(rows)
    trades = trades_once(rows.drop("bid_px", "ask_px"))
    return match_passive(trades, entry_gaps(pre))


def gap_totals(window: Column, minimum_match: float) -> dict[str, Column]:
    vol, hit = F.col("source_volume"), window & F.col("is_matched")
    far = hit & (F.col("initial_gap") > F.col("theta_5d_raw"))
    total = F.sum(F.when(window, vol))
    out = {
        "total_trade_volume": total,
        "matched_trade_volume": X.sum0("source_volume", hit),
        "match_rate": X.ratio(X.sum0("source_volume", hit), total),
        "valid_trade_count": X.count_if(window),
        "matched_trade_count": X.count_if(hit),
    }
    for side, name in (("B", "buy"), ("S", "sell")):
        mine = far & (F.col("source_side") == side)
        out[f"large_gap_{name}_volume"] = X.sum0("source_volume", mine)
        out[f"large_gap_{name}_ratio"] = X.ratio(X.sum0("source_volume", mine), total)
        out[f"large_gap_{name}_trade_count"] = X.count_if(mine)
    out["passes_match_rate"] = out["match_rate"] >= minimum_match
    return out


def large_gap(
    events: DataFrame, thetas: DataFrame, window: tuple[int, int] = DAILY,
    mode: str = "last_valid", minimum_match: float = 0.95,
) -> DataFrame:
    """Share of traded volume whose resting order was placed beyond theta, by side."""
    upto = events.filter(F.col("time") < window[1])
    trades = matched_trades(upto, mode).filter(X.in_window(*window))
    known = thetas.select(*DAY, "theta_5d_raw").filter(F.col("theta_5d_raw").isNotNull())
    t = gap_totals(F.lit(True), minimum_match)
    return trades.join(known, DAY).groupBy(*DAY).agg(
        F.any_value("theta_5d_raw", True).alias("theta_5d_raw"), *[e.alias(n) for n, e in t.items()]
    )


def joint_gap(events: DataFrame, thetas: DataFrame, minimum_match: float = 0.95) -> DataFrame:
    """Daily and intraday gap totals from one match; NULL ratios without theta."""
    trades = matched_trades(events).join(thetas.select(*DAY, "theta_5d_raw"), DAY, "left")
    aggs = {}
    for prefix, win in (("daily", DAILY), ("intraday", INTRADAY)):
        has = F.any_value("theta_5d_raw", True).isNotNull()
        for n, e in gap_totals(X.in_window(*win), minimum_match).items():
            needs = n.endswith("_ratio") or n.endswith("_trade_count") and n.startswith("large")
            aggs[f"{prefix}_{n}"] = F.when(has, e) if needs else e
    return trades.groupBy(*DAY).agg(*[e.alias(n) for n, e in aggs.items()])
