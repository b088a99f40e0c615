"""Mid-price impact by event class, and the factors built on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.crosssection import winsorise, zscore
from lobloom.operators.history import lagged_z_and_rank
from lobloom.operators.lifecycle import DAY, explode_windows, prebook
from lobloom.session import stage
from lobloom.sources.derived import sessions

COLUMNS = [
    "symbol", "date", "time", "row_id", "source_action", "source_side",
    "source_buy_order_id", "source_sell_order_id", "bid_px", "ask_px",
]
CLASSES = ("genuine_passive", "aggressive_remainder", "unclassified")


def classify_adds(rows: DataFrame) -> DataFrame:
    """Add ``add_class``: was the same (side, order) an aggressor earlier that day?

    Shenzhen adds stay unclassified.  Rows without a usable key join on their own
    negative row id, so they spread instead of meeting in one NULL group.
    """
    own = X.own_side_id()
    first = (
        rows.filter((F.col("source_action") == "TRADE") & F.col("source_side").isin("B", "S"))
        .select(*DAY, F.col("source_side").alias("_side"), own.alias("_key"), "row_id")
        .filter(F.col("_key").isNotNull())
        .groupBy(*DAY, "_side", "_key").agg(F.min("row_id").alias("_first_trade"))
    )
    is_add = F.col("source_action") == "ORDER_ADD"
    usable = is_add & own.isNotNull() & ~F.col("symbol").startswith("SZ")
    keyed = rows.withColumns({
        "_usable": F.coalesce(usable, F.lit(False)),
        "_side": F.col("source_side"),
    }).withColumn("_key", F.when(F.col("_usable"), own).otherwise(-1 - F.col("row_id")))
    return keyed.join(first, [*DAY, "_side", "_key"], "left").withColumn(
        "add_class",
        F.when(is_add & ~F.col("_usable"), "unclassified")
        .when(is_add & (F.col("_first_trade") < F.col("row_id")), "aggressive_remainder")
        .when(is_add, "genuine_passive"),
    ).drop("_usable", "_side", "_key", "_first_trade")


def impact_primitives(events: DataFrame, refs: DataFrame, windows=None) -> DataFrame:
    """Signed and absolute mid moves by action in each window, over the 10:00 close."""
    windows = windows or X.WINDOWS
    rows = classify_adds(prebook(sessions(events.select(*COLUMNS)), "strict"))
    d = F.col("book.mid") - F.col("pre.mid")
    rows = rows.withColumns({
        "mid": F.col("book.mid"), "d": d,
        "take": F.coalesce(
            (F.col("source_action") == "TRADE")
            & (
                ((F.col("source_side") == "B") & (F.col("book.ask") > F.col("pre.ask")) & (d > 0))
                | ((F.col("source_side") == "S") & (F.col("book.bid") < F.col("pre.bid")) & (d < 0))
            ), F.lit(False)),
    }).drop("book", "pre", "bid_px", "ask_px")
    c = F.col
    scaled = lambda v, cond: F.coalesce(X.sum_if(v, cond), F.lit(0.0)) / X.PRICE_SCALE
    aggs = {
        "start_mid": F.min_by("mid", F.when(c("mid").isNotNull(), c("row_id"))) / X.PRICE_SCALE,
        "end_mid": F.max_by("mid", F.when(c("mid").isNotNull(), c("row_id"))) / X.PRICE_SCALE,
        "total_mid_impact_signed": F.coalesce(F.sum("d"), F.lit(0.0)) / X.PRICE_SCALE,
        "legacy_active_take_impact_signed": scaled("d", c("take")),
        "window_events": F.count(F.lit(1)),
        "valid_impact_events": F.count("d"),
        "invalid_book_events": X.count_if(c("mid").isNull()),
        "invalid_lag_events": X.count_if(c("d").isNull()),
        "positive_mid_move_events": X.count_if(c("d") > 0),
        "negative_mid_move_events": X.count_if(c("d") < 0),
    }
    for action, name in (("ORDER_ADD", "order"), ("CANCEL", "cancel"), ("TRADE", "trade")):
        mine = c("source_action") == action
        aggs[f"{name}_impact_signed"] = scaled("d", mine)
        aggs[f"{name}_impact_abs"] = scaled(F.abs("d"), mine)
        aggs[f"{name}_events"] = X.count_if(mine)
        aggs[f"{name}_mid_move_events"] = X.count_if(mine & (c("d") != 0))
    for side, name in (("B", "buy"), ("S", "sell")):
        aggs[f"trade_{name}_impact_signed"] = scaled(
            "d", (c("source_action") == "TRADE") & (c("source_side") == side))
    other = c("source_action").isNull() | ~c("source_action").isin("ORDER_ADD", "CANCEL", "TRADE")
    aggs["unclassified_mid_impact_signed"] = scaled("d", other)
    for name in CLASSES:
        mine = c("add_class") == name
        label = {"genuine_passive": "genuine_passive_add", "unclassified": "unclassified_add"}.get(name, name)
        aggs[f"{label}_impact_signed"] = scaled("d", mine)
        aggs[f"{label}_events"] = X.count_if(mine)
    keys = [*DAY, "window_name", "window_start", "window_end"]
    days = explode_windows(rows, windows).groupBy(*keys).agg(*[e.alias(n) for n, e in aggs.items()])
    panel = refs.filter((c("security_category") == 1) & (c("close_1000") > 0)).select(
        *DAY, c("close_1000").alias("normalizer_price"))
    return days.join(panel, DAY).withColumns(
        {f"{n}_impact_over_normalizer": c(f"{n}_impact_signed") / c("normalizer_price")
         for n in ("order", "cancel", "trade")}
        | {"frequency": F.when(c("window_name").startswith("intraday"), "intraday").otherwise("daily")}
    )


def impact_factors(primitives: DataFrame, lookback: int = 60, minimum: int = 20) -> DataFrame:
    """Trade reversal and momentum scores, and order-impact extremes against own history."""
    group = ["date", "window_name"]
    o, t = "order_impact_over_normalizer", "trade_impact_over_normalizer"
    base = primitives.select("symbol", *group, "frequency", "normalizer_price", o, t)
    hist = lagged_z_and_rank(base, ["symbol", "window_name"], o, lookback, minimum, prefix="order_impact_history")
    clipped = winsorise(
        stage(hist, "impact-history"), group, {"order_impact_winsorized": o, "trade_impact_winsorized": t}, count="cross_section_n")
    z = zscore(stage(clipped, "impact-clipped"), group, {"order_impact_z": "order_impact_winsorized", "trade_impact_z": "trade_impact_winsorized"})
    hz, hr = F.col("order_impact_history_z"), F.col("order_impact_history_rank")
    cols = {"d01_trade_reversal": -F.col("trade_impact_z"), "d02_trade_momentum": F.col("trade_impact_z")}
    for cut in (90, 95):
        cols[f"d03_positive_order_ts_extreme{cut}"] = F.coalesce(
            F.when((F.col(o) > 0) & (hr > cut / 100.0), -hz), F.lit(0.0))
    return z.withColumns(cols)
