"""Large-order flow: lagged size thresholds, imbalance, residuals and persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.crosssection import percentile_ranks, quintile, residualise, winsorise
from lobloom.operators.history import persistence, recursive_ewma, surprise
from lobloom.operators.lifecycle import DAY, explode_windows, reconstruct_orders
from lobloom.plans.evaluation import fits
from lobloom.session import stage
from lobloom.sources.derived import sessions

VERSIONS = ("mean_x05", "mean_x10", "p80", "p90", "fixed_notional")
DAILY_WINDOWS = {k: X.WINDOWS[k] for k in ("daily_0930_close", "daily_1000_close")}
INTRADAY_WINDOW = {"intraday_1000_1030": X.WINDOWS["intraday_1000_1030"]}
COLUMNS = [
    "symbol", "date", "time", "row_id", "source_action", "source_side", "source_price",
    "source_volume", "source_buy_order_id", "source_sell_order_id", "source_link_status",
    "bid_px", "ask_px",
]


def eligible_days(controls: DataFrame) -> DataFrame:
    """Tradable stock-days with their own observation number per symbol."""
    w = Window.partitionBy("symbol").orderBy("date")
    return controls.filter(X.tradable()).select(*DAY).withColumn("day_seq", F.row_number().over(w))


def size_thresholds(orders: DataFrame, days: DataFrame, history: int = 20) -> DataFrame:
    """Mean, 80 % and 90 % points of order sizes over the previous ``history`` observations.

    Sizes are counted per day first; each day's counts are then sent to the days
    that look back on them, an equi join instead of a range join.
    """
    hist = (
        orders.groupBy(*DAY, "original_qty").agg(F.count(F.lit(1)).alias("c"))
        .join(days, DAY)
        .select("symbol", "original_qty", "c", "date", F.explode(
            F.sequence(F.col("day_seq") + 1, F.col("day_seq") + history)).alias("day_seq"))
    )
    looked = hist.join(days.withColumnRenamed("date", "target"), ["symbol", "day_seq"])
    seen = looked.groupBy("symbol", F.col("target")).agg(
        F.count_distinct("date").alias("history_days"))
    sizes = looked.groupBy("symbol", "target", "original_qty").agg(F.sum("c").alias("c"))
    # One row per distinct order size: the window is bounded by the lot grid.
    by = Window.partitionBy("symbol", "target")
    cum = sizes.withColumns({
        "n": F.sum("c").over(by),
        "upto": F.sum("c").over(by.orderBy("original_qty").rowsBetween(Window.unboundedPreceding, 0)),
    })
    points = cum.groupBy("symbol", "target").agg(
        (F.sum(F.col("original_qty") * F.col("c")) / F.max("n")).alias("mean_qty"),
        F.min(F.when(F.col("upto") >= F.col("n") * 0.8, F.col("original_qty"))).alias("p80_qty"),
        F.min(F.when(F.col("upto") >= F.col("n") * 0.9, F.col("original_qty"))).alias("p90_qty"),
        F.max("n").alias("history_order_count"),
        F.count(F.lit(1)).alias("size_bins"),
    )
    return points.join(seen, ["symbol", "target"]).withColumnRenamed("target", "date")


def _large(version: str, qty: str, notional: str, fixed: float) -> Column:
    cut = {"mean_x05": F.col("mean_qty") * 0.5, "mean_x10": F.col("mean_qty"),
           "p80": F.col("p80_qty"), "p90": F.col("p90_qty")}
    if version == "fixed_notional":
        return F.col(notional) >= fixed
    return F.col(qty) >= cut[version]


def _flow_aggs(fixed: float) -> dict[str, Column]:
    out = {}
    for v in VERSIONS:
        big = F.coalesce(_large(v, "original_qty", "w_notional", fixed), F.lit(False))
        for s, name in (("B", "buy"), ("S", "sell")):
            mine = big & (F.col("side") == s)
            out[f"{v}_{name}_exec_qty"] = F.coalesce(X.sum_if("w_qty", mine), F.lit(0.0))
            out[f"{v}_{name}_order_count"] = X.count_if(mine & (F.col("w_qty") > 0))
    return out


def _imbalances() -> dict[str, Column]:
    out = {}
    for v in VERSIONS:
        b, s = F.col(f"{v}_buy_exec_qty"), F.col(f"{v}_sell_exec_qty")
        out[f"{v}_alf"] = X.ratio(b - s, b + s)
    return out


def active_large_flow(
    events: DataFrame, controls: DataFrame, history: int = 20, fixed_notional: float = 1_000_000.0,
    windows=None,
) -> DataFrame:
    """Executed quantity of large aggressive orders by side for five size rules."""
    windows = windows or DAILY_WINDOWS
    days = eligible_days(controls)
    rows = sessions(events.select(*COLUMNS)).join(days.select(*DAY), DAY, "left_semi")
    orders = stage(reconstruct_orders(rows, windows), "orders")
    points = size_thresholds(orders, days, history)
    per_window = F.explode(F.array(*[
        F.struct(F.lit(n).alias("window_name"), F.col(f"exec_qty_{n}").alias("w_qty"),
                 F.col(f"exec_notional_{n}").alias("w_notional")) for n in windows]))
    active = orders.filter("is_active").select(*DAY, "side", "original_qty", per_window.alias("_w")).select(
        *DAY, "side", "original_qty", "_w.*")
    flows = active.join(points.select(*DAY, "mean_qty", "p80_qty", "p90_qty"), DAY).groupBy(
        *DAY, "window_name").agg(*[e.alias(n) for n, e in _flow_aggs(fixed_notional).items()])
    ok = X.book_ok("locked_ok")
    mid = F.when(ok, (X.best("bid").cast("double") + X.best("ask")) / 20000.0)
    flat = rows.select(
        *DAY, "time", "row_id", "source_action", "source_volume", "source_link_status",
        X.own_side_id().alias("oid"), mid.alias("mid"))
    known = F.when(F.col("mid").isNotNull(), F.col("row_id"))
    trade = F.col("source_action") == "TRADE"
    stats = explode_windows(flat, windows).groupBy(*DAY, "window_name", "window_start", "window_end").agg(
        F.min_by("mid", known).alias("start_mid"), F.max_by("mid", known).alias("end_mid"),
        F.count(F.lit(1)).alias("window_events"), X.count_if(trade).alias("trade_events"),
        X.count_if(F.col("source_action") == "ORDER_ADD").alias("order_add_events"),
        X.count_if(F.col("source_action") == "CANCEL").alias("cancel_events"),
        F.count("mid").alias("valid_book_events"),
        X.count_if(F.col("mid").isNull()).alias("invalid_book_events"),
        X.count_if(F.col("source_volume").isNull() | (F.col("source_volume") <= 0)).alias("invalid_volume_count"),
        X.count_if(trade & F.col("oid").isNull()).alias("missing_aggressor_id_count"),
        X.count_if(trade & (F.col("source_link_status") == "FULL")).alias("full_link_trade_count"),
        X.count_if(trade & (F.col("source_link_status") == "PARTIAL")).alias("partial_link_trade_count"),
    )
    quality = orders.groupBy(*DAY).agg(
        X.count_if(F.col("is_active")).alias("active_order_count"),
        X.count_if(F.col("is_active") & (F.col("trade_rows") > 1)).alias("split_active_order_count"),
        X.count_if(F.col("trade_before_add")).alias("trade_before_add_count"),
        X.count_if(F.col("is_active") & (F.col("add_rows") == 0)).alias("fully_immediate_order_count"),
    )
    wide = stats.join(points, DAY).join(flows, [*DAY, "window_name"], "left").join(quality, DAY, "left")
    qty = [f"{v}_{s}_exec_qty" for v in VERSIONS for s in ("buy", "sell")]
    cnt = [f"{v}_{s}_order_count" for v in VERSIONS for s in ("buy", "sell")]
    cnt += ["active_order_count", "split_active_order_count", "trade_before_add_count", "fully_immediate_order_count"]
    wide = wide.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in qty} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in cnt})
    bad_price = F.col("start_mid").isNull() | F.col("end_mid").isNull()
    short = F.col("history_days") < history
    miss = F.col("missing_aggressor_id_count") > 0
    return wide.withColumns(_imbalances() | {
        "window_return": F.when(F.col("start_mid") > 0, F.col("end_mid") / F.col("start_mid") - 1),
        "is_valid": ~short & (F.col("history_order_count") > 0) & ~bad_price & ~miss,
        "invalid_reason": X.reasons(
            (short, "insufficient_threshold_history"), (F.col("history_order_count") == 0, "zero_threshold_orders"),
            (bad_price, "invalid_window_price"), (miss, "missing_aggressor_id")),
    }).drop("size_bins")


def intraday_large_flow(
    events: DataFrame, controls: DataFrame, history: int = 20, fixed_notional: float = 1_000_000.0,
) -> DataFrame:
    """The same flow for 10:00-10:30 using only what is known at 10:30.

    Thresholds come from complete earlier days; today's orders are rebuilt from
    events before the cut-off alone.
    """
    start, end = X.WINDOWS["intraday_1000_1030"]
    days = eligible_days(controls)
    rows = sessions(events.select(*COLUMNS).drop("bid_px", "ask_px")).join(days.select(*DAY), DAY, "left_semi")
    points = size_thresholds(stage(reconstruct_orders(rows), "orders"), days, history)
    known = reconstruct_orders(rows.filter(F.col("time") < end), {"w": (start, end)})
    active = known.filter(F.col("exec_qty_w") > 0).select(
        *DAY, "side", "original_qty", "trade_before_add", "add_rows",
        F.col("exec_qty_w").alias("w_qty"), F.col("exec_notional_w").alias("w_notional"))
    flows = active.join(points, DAY).groupBy(*DAY).agg(
        *[e.alias(n) for n, e in _flow_aggs(fixed_notional).items()],
        F.count(F.lit(1)).alias("active_order_count"),
        X.count_if(F.col("trade_before_add")).alias("trade_before_add_count"),
        X.count_if(F.col("add_rows") == 0).alias("no_add_count"),
    )
    trade = F.col("source_action") == "TRADE"
    stats = rows.filter(X.in_window(start, end)).groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("window_events"), X.count_if(trade).alias("trade_events"),
        X.count_if(trade & X.own_side_id().isNull()).alias("missing_aggressor_id_count"),
    )
    wide = stats.join(points.drop("size_bins"), DAY).join(flows, DAY, "left")
    qty = [f"{v}_{s}_exec_qty" for v in VERSIONS for s in ("buy", "sell")]
    cnt = [f"{v}_{s}_order_count" for v in VERSIONS for s in ("buy", "sell")]
    cnt += ["active_order_count", "trade_before_add_count", "no_add_count"]
    wide = wide.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) for c in qty} | {c: F.coalesce(c, F.lit(0).cast("long")) for c in cnt})
    short, miss = F.col("history_days") < history, F.col("missing_aggressor_id_count") > 0
    return wide.withColumns(_imbalances() | {
        "window_name": F.lit("intraday_1000_1030"),
        "is_valid": ~short & (F.col("history_order_count") > 0) & ~miss,
        "invalid_reason": X.reasons((short, "insufficient_threshold_history"),
                                    (F.col("history_order_count") == 0, "zero_threshold_orders"),
                                    (miss, "missing_aggressor_id")),
    })


def long_versions(primitives: DataFrame, keep: list[str]) -> DataFrame:
    """One row per size rule with its imbalance and executed quantities."""
    items = F.array(*[
        F.struct(F.lit(v).alias("threshold_version"), F.col(f"{v}_alf").alias("alf_raw"),
                 F.col(f"{v}_buy_exec_qty").alias("buy_qty"), F.col(f"{v}_sell_exec_qty").alias("sell_qty"))
        for v in VERSIONS])
    return primitives.withColumn("_v", F.explode(items)).select(*keep, "_v.*").filter(
        F.col("alf_raw").isNotNull())


GROUP = ["date", "window_name", "threshold_version"]
STYLES = ["ret5_lagged", "turnover20", "amihud20", "residual_volatility", "log_price"]


def flow_residuals(
    primitives: DataFrame, controls: DataFrame, boards: list[str], minimum: int = 100,
) -> DataFrame:
    """Winsorised imbalance without window return, styles and board; rank, R2 and
    the response of the price to flow (underreaction events and gaps)."""
    cols = ["symbol", "date", "window_name", "window_return"]
    rows = long_versions(primitives.filter("is_valid"), cols)
    style = controls.filter(F.col("close_1000") > 0).select(
        *DAY, "board", "ret5_lagged", "turnover20", "amihud20", "residual_volatility",
        F.ln("close_1000").alias("log_price"))
    rows = rows.join(style, DAY).filter(F.col("window_return").isNotNull())
    dummies = [f"_board_{b}" for b in boards[1:]]
    rows = rows.withColumns({f"_board_{b}": (F.col("board") == b).cast("double") for b in boards[1:]})
    rows = stage(rows, "flow-long")
    whole = fits(rows)
    rows = winsorise(rows, GROUP, {"alf_winsorized": "alf_raw"}, count="d04_cross_section_n", minimum=minimum, whole=whole)
    # Both residuals come from one pass over the moments.
    rows = residualise(stage(rows, "flow-clipped"), GROUP, {
        "d04_residual": ("alf_winsorized", ["window_return", *STYLES, *dummies]),
        "response": ("window_return", [*STYLES, *dummies]),
    }, r2=True, sd=True).withColumnRenamed("d04_residual_r2", "d04_regression_r2")
    rows = stage(rows.drop(*dummies, "board", *STYLES, "response_r2"), "flow-residual")

    def z(c):
        return F.when(F.col(f"{c}_sd") > 1e-12, F.col(c) / F.col(f"{c}_sd")).otherwise(0.0)

    rows = rows.withColumns({
        "d04_z": z("d04_residual"), "response_z": z("response"),
        # Equal residuals are told apart only by rounding noise, so ranks use 10 digits.
        "_fr": F.round("d04_residual", 10), "_rr": F.round("response", 10),
    }).drop("d04_residual_sd", "response_sd")
    xy = rows.groupBy(*GROUP).agg(
        F.sum(F.col("d04_residual") * F.col("response")).alias("_xy"),
        F.sum(F.col("d04_residual") * F.col("d04_residual")).alias("_xx"))
    rows = percentile_ranks(rows, GROUP, {"d04_rank_pct": "_fr", "response_rank_pct": "_rr"}, whole=whole).join(xy, GROUP)
    fb, rb = quintile("d04_rank_pct"), quintile("response_rank_pct")
    beta = F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")).otherwise(0.0)
    return rows.withColumns({
        "d06_flow_bucket": fb, "d06_response_bucket": rb,
        "d06_underreaction_event": F.when((fb == 5) & (rb <= 2), 1).when((fb == 1) & (rb >= 4), -1).otherwise(0),
        "d06_diff": F.col("d04_z") - F.col("response_z"),
        "d06_daily_beta": beta,
        "d06_expected_response": beta * F.col("d04_residual"),
        "d06_response_gap": beta * F.col("d04_residual") - F.col("response"),
    }).drop("_fr", "_rr", "_xx", "_xy")


def flow_persistence(residuals: DataFrame, length: int = 60) -> DataFrame:
    """Surprise, acceleration and same-sign persistence of each symbol's own series."""
    keys = ["symbol", "window_name", "threshold_version"]
    s = residuals.withColumns({"_b": F.log1p("buy_qty"), "_s2": F.log1p("sell_qty")})
    s = surprise(s, keys, {f"d05_surprise_{length}": "d04_residual", f"d05_buy_surprise_{length}": "_b",
                           f"d05_sell_surprise_{length}": "_s2"}, length)
    s = recursive_ewma(s, keys, "d04_residual", 3, "_e3")
    s = recursive_ewma(s, keys, "d04_residual", 20, "_e20")
    s = persistence(s, keys, "d04_residual", "d05")
    n = F.row_number().over(Window.partitionBy(*keys).orderBy("date")) - 1
    return s.withColumns({
        "d05_acceleration_3_20": F.col("_e3") - F.col("_e20"), "d05_history_observations": n,
    }).drop("_b", "_s2", "_e3", "_e20")


def intraday_residuals(primitives: DataFrame, controls: DataFrame, styles: list[str], minimum: int = 100) -> DataFrame:
    """Intraday imbalance residualised on the previous market day's styles."""
    from lobloom.operators.lifecycle import calendar

    cal = calendar(controls)
    prior = controls.join(cal, "date").select(
        "symbol", (F.col("day_seq") + 1).alias("day_seq"), F.col("date").alias("control_date"),
        *[F.col(s) for s in styles])
    today = controls.filter((F.col("security_category") == 1) & (F.col("is_st") == 0) & (F.col("is_suspended") == 0))
    rows = long_versions(primitives.filter("is_valid"), ["symbol", "date", "window_name"])
    rows = rows.join(today.select(*DAY), DAY, "left_semi").join(cal, "date").join(prior, ["symbol", "day_seq"])
    rows = stage(rows, "flow-long")
    whole = fits(rows)
    rows = winsorise(rows, GROUP, {"alf_winsorized": "alf_raw"}, count="d04_cross_section_n", minimum=minimum, whole=whole)
    rows = residualise(stage(rows, "flow-clipped"), GROUP, {"d04_residual": ("alf_winsorized", styles)}, r2=True, sd=True)
    rows = stage(rows.withColumnRenamed("d04_residual_r2", "d04_regression_r2").drop("day_seq", *styles), "flow-intraday")
    sd = F.col("d04_residual_sd")
    rows = rows.withColumns({
        "d04_z": F.when(sd > 1e-12, F.col("d04_residual") / sd).otherwise(0.0),
        "_fr": F.round("d04_residual", 10),
    }).drop("d04_residual_sd")
    return percentile_ranks(rows, GROUP, {"d04_rank_pct": "_fr"}, whole=whole).drop("_fr")
