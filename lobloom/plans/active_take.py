"""How much of the mid-price path aggressive trades cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.lifecycle import DAY, prebook, previous_row_book
from lobloom.sources.derived import sessions

EVENT_COLUMNS = ["symbol", "date", "time", "row_id", "source_action", "source_side", "bid_px", "ask_px"]


def _moves(rows: DataFrame) -> DataFrame:
    """Mid moves between the known previous book and this one."""
    d = F.col("book.mid") - F.col("pre.mid")
    take = (F.col("source_action") == "TRADE") & (
        ((F.col("source_side") == "B") & (F.col("book.ask") > F.col("pre.ask")) & (d > 0))
        | ((F.col("source_side") == "S") & (F.col("book.bid") < F.col("pre.bid")) & (d < 0))
    )
    return rows.filter(F.col("pre").isNotNull() & F.col("book").isNotNull()).withColumns({
        "move": d, "path": F.abs(d), "is_take": F.coalesce(take, F.lit(False)),
    })


def _totals() -> dict:
    take = F.coalesce(X.sum_if("path", F.col("is_take")), F.lit(0.0))
    signed = F.coalesce(X.sum_if("move", F.col("is_take")), F.lit(0.0))
    return {
        "active_take_mid_gap": take / X.PRICE_SCALE,
        "active_take_mid_gap_signed": signed / X.PRICE_SCALE,
        "all_mid_gap": F.sum("path") / X.PRICE_SCALE,
        "active_take_mid_gap_ratio": F.coalesce(X.ratio(take, F.sum("path")), F.lit(0.0)),
        "active_take_mid_events": X.count_if(F.col("is_take")),
        "all_mid_move_events": X.count_if(F.col("path") > 0),
        "valid_lag_events": F.count(F.lit(1)),
    }


def _nonempty(events: DataFrame) -> DataFrame:
    return sessions(events.select(*EVENT_COLUMNS)).filter(X.book_ok("nonempty"))


def active_take_ratio(events: DataFrame) -> DataFrame:
    """Stock-day share of the absolute mid path, with move counts by action."""
    moved = F.col("path") > 0
    t = _totals()
    t.pop("active_take_mid_gap_signed")
    for action in ("TRADE", "CANCEL", "ORDER_ADD"):
        t[f"{action.lower()}_mid_move_events"] = X.count_if(moved & (F.col("source_action") == action))
    # One uncounted opening row per session: the published count assumes two sessions.
    t["continuous_events"] = F.count(F.lit(1)) + 2
    return _moves(previous_row_book(_nonempty(events))).groupBy(*DAY).agg(
        *[e.alias(n) for n, e in t.items()]
    )


def active_take_daily(events: DataFrame, closes: DataFrame) -> DataFrame:
    """The same totals, signed and divided by the 10:00 close of the stock-day."""
    refs = closes.filter((F.col("security_category") == 1) & (F.col("close_1000") > 0)).select(
        *DAY, "close_1000"
    )
    t = _totals()
    for s in ("AM", "PM"):
        t[f"{s.lower()}_valid_lag_events"] = X.count_if(F.col("session") == s)
    days = _moves(previous_row_book(_nonempty(events))).groupBy(*DAY).agg(
        *[e.alias(n) for n, e in t.items()]
    )
    # The panel has one row per stock-day, so it joins after the aggregation.
    return days.join(refs, DAY).withColumns({
        "active_take_mid_gap_over_1000_close": F.col("active_take_mid_gap") / F.col("close_1000"),
        "active_take_mid_gap_signed_over_1000_close":
            F.col("active_take_mid_gap_signed") / F.col("close_1000"),
        "normalizer_time": F.lit(100000000).cast("long"),
    })


def active_take_window(events: DataFrame, start: int = 100000000, end: int = 103000000) -> DataFrame:
    """Inside one clock window, against the last valid book, over the first mid."""
    rows = prebook(events.select(*EVENT_COLUMNS).filter(X.in_window(start, end)), "strict", DAY)
    t = _totals()
    # The first valid book is the first one that later rows see as "pre".
    t["_first"] = F.min_by("pre.mid", "pre.row_id")
    days = _moves(rows).groupBy(*DAY).agg(*[e.alias(n) for n, e in t.items()])
    first = F.col("_first")
    return days.select(
        *DAY,
        F.lit(start).cast("long").alias("window_start"), F.lit(end).cast("long").alias("window_end"),
        (first / X.PRICE_SCALE).alias("start_mid"),
        *[n for n in t if n != "_first"],
        (F.col("active_take_mid_gap") * X.PRICE_SCALE / first).alias("active_take_mid_gap_over_start_mid"),
        (F.col("active_take_mid_gap_signed") * X.PRICE_SCALE / first)
        .alias("active_take_mid_gap_signed_over_start_mid"),
    )
