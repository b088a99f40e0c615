"""Execution episodes: how much of their immediate impact remains later."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.asof import TIME_SPAN, asof
from lobloom.operators.lifecycle import DAY, ORDER, explode_values, explode_windows, islands, prebook, reconstruct_orders
from lobloom.operators.ordered import SESSION, SPAN, dense_order, shift_dense, span_of
from lobloom.session import stage
from lobloom.sources.derived import sessions

EVENT_HORIZONS = (1, 5, 10, 20, 50)
TIME_HORIZONS_MS = (5000, 30000, 60000, 300000)
WINDOWS = X.WINDOWS
S = list(SESSION)


def _rows(events: DataFrame, span: int | None = SPAN) -> DataFrame:
    cols = ["symbol", "date", "time", "row_id", "source_action", "source_side", "source_price",
            "source_volume", "source_buy_order_id", "source_sell_order_id", "source_link_status",
            "bid_px", "ask_px"]
    r = prebook(sessions(events.select(*cols)), "strict", span=span)
    return r.withColumns({
        "ms": X.clock_ms(), "oid": X.own_side_id(),
        "mid": F.col("book.mid") / X.PRICE_SCALE, "pre_mid": F.col("pre.mid") / X.PRICE_SCALE,
        "notional": F.col("source_price").cast("double") * F.col("source_volume") / X.PRICE_SCALE,
    }).drop("book", "pre", "bid_px", "ask_px")


def episodes(rows: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Runs of consecutive trade rows of one aggressor.

    Only another action, side or order ends a run; a trade row without volume does not.
    """
    is_trade = F.col("source_action") == "TRADE"
    usable = is_trade & F.col("source_side").isin("B", "S") & F.col("oid").isNotNull()
    run = islands(rows, F.coalesce(usable, F.lit(False)), [F.col("source_side"), F.col("oid")], out="episode", span=span)
    e = run.filter(F.col("episode").isNotNull()).groupBy(
        *S, F.col("source_side").alias("side"), F.col("oid").alias("order_id"), "episode").agg(
        F.min("time").alias("start_time"), F.max_by("time", "row_id").alias("end_time"),
        F.max("row_id").alias("row_id"), F.max_by("ms", "row_id").alias("end_ms"),
        F.min_by("pre_mid", F.when(F.col("pre_mid").isNotNull(), F.col("row_id"))).alias("pre_mid"),
        F.max_by("mid", F.when(F.col("mid").isNotNull(), F.col("row_id"))).alias("post_mid"),
        F.bool_and(F.col("mid").isNotNull()).alias("whole"),
        F.sum("notional").alias("episode_notional"),
    )
    return e.filter(F.col("whole") & F.col("pre_mid").isNotNull()).drop("whole").withColumn(
        "immediate", F.col("post_mid") - F.col("pre_mid"))


def retained_impact(
    events: DataFrame, fixed_notional: float = 1_000_000.0, clip: float = 5.0, history: int = 20,
    thresholds: DataFrame | None = None,
) -> DataFrame:
    """Retained over immediate impact at event and clock horizons, on the full grid.

    ``thresholds`` (symbol, date, mean_qty) overrides the rolling mean order size.
    """
    # Scalars only, written once; every branch below reads this narrow table.
    span = span_of(sessions(events))
    rows = stage(_rows(events, span), "retained-rows")
    orders = reconstruct_orders(rows)
    days = orders.groupBy(*DAY).agg(F.sum("original_qty").alias("q"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(-history, -1)
    rolling = days.select(*DAY, (F.sum("q").over(w) / F.sum("n").over(w)).alias("mean_qty"))
    if thresholds is not None:
        rolling = rolling.join(thresholds.select(*DAY, F.col("mean_qty").alias("_given")), DAY, "full_outer").select(
            *DAY, F.coalesce("_given", "mean_qty").alias("mean_qty"))
    valid = dense_order(rows.filter(F.col("mid").isNotNull()).select(*S, "row_id", "ms", "mid", "source_action"), S, span=span)
    ahead = shift_dense(valid, S, "seq", {
        f"_h{h}": (F.struct(F.col("mid").alias("future_mid"), F.col("ms").alias("future_ms")), h)
        for h in EVENT_HORIZONS}, span=span).filter("source_action = 'TRADE'")  # an episode ends with a trade
    ep = episodes(rows, span).join(orders.select(*ORDER, "original_qty"), ORDER)
    at_events = ep.join(ahead.drop("ms", "mid", "seq", "source_action"), [*S, "row_id"])
    by_event = F.explode(F.array(*[
        F.struct(F.lit("event").alias("clock_type"), F.lit(h).cast("long").alias("horizon"),
                 F.col(f"_h{h}.future_mid").alias("future_mid"), F.col(f"_h{h}.future_ms").alias("future_ms"))
        for h in EVENT_HORIZONS]))
    base = [c for c in ep.columns]
    ev = at_events.select(*base, by_event.alias("_f")).select(*base, "_f.*")
    probes = explode_values(ep, list(TIME_HORIZONS_MS), "horizon").withColumns({
        "horizon": F.col("horizon").cast("long"), "clock_type": F.lit("time"),
    }).withColumn("target_ms", F.col("end_ms") + F.col("horizon"))
    tm = asof(probes, valid, S, "target_ms", "ms", {"future_mid": F.col("mid")}, span=span and TIME_SPAN).withColumnRenamed(
        "target_ms_hit", "future_ms").drop("target_ms")
    both = ev.unionByName(tm.select(*ev.columns))

    traded = rows.filter((F.col("source_action") == "TRADE") & F.col("source_side").isin("B", "S")
                         & F.col("oid").isNotNull() & (F.col("source_volume") > 0))
    order_window = explode_windows(traded, WINDOWS).groupBy(
        *DAY, F.col("source_side").alias("side"), F.col("oid").alias("order_id"), "window_name", "window_start", "window_end").agg(
        F.sum("notional").alias("window_notional"))
    inside = both.join(order_window, ORDER).filter(
        (F.col("start_time") >= F.col("window_start")) & (F.col("end_time") < F.col("window_end")))
    inside = inside.join(rolling, DAY, "left")
    rules = F.filter(F.array(
        F.when(F.col("original_qty") >= F.col("mean_qty") * 0.5, F.lit("mean_x05")),
        F.when(F.col("window_notional") >= fixed_notional, F.lit("fixed_notional"))), lambda x: x.isNotNull())
    picked = inside.withColumn("threshold_version", F.explode(rules))
    imm, later = F.col("immediate"), F.col("future_mid") - F.col("pre_mid")
    moved = F.abs(imm) > 1e-12
    picked = picked.withColumns({
        "retained": later,
        "r": F.when(moved & F.col("future_mid").isNotNull(),
                    F.greatest(F.lit(-clip), F.least(F.lit(clip), later / F.when(moved, imm)))),
        "gap": F.col("future_ms") - F.col("end_ms"),
    })
    has = F.col("r").isNotNull()

    def weighted(extra=None):
        cond = has if extra is None else has & extra
        return X.ratio(X.sum_if(F.abs(imm) * F.col("r"), cond), X.sum_if(F.abs(imm), cond))

    key = [*DAY, "window_name", "threshold_version", "clock_type", "horizon"]
    agg = picked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("episode_count"),
        X.count_if(F.col("side") == "B").alias("buy_episode_count"),
        X.count_if(F.col("side") == "S").alias("sell_episode_count"),
        X.count_if(moved).alias("nonzero_immediate_count"),
        X.count_if(has).alias("valid_retained_count"),
        X.count_if(F.col("future_mid").isNull()).alias("missing_retained_count"),
        F.sum(imm).alias("immediate_impact_sum"), F.sum(F.abs(imm)).alias("immediate_impact_abs_sum"),
        X.sum_if("retained", has).alias("retained_impact_sum"),
        X.sum_if(F.abs("retained"), has).alias("retained_impact_abs_sum"),
        X.ratio(X.sum_if(imm * F.col("r"), has), X.sum_if(F.abs(imm), has)).alias("d07_directional"),
        weighted().alias("d07_permanent_ratio"),
        weighted(F.col("side") == "B").alias("d07_buy_permanent_ratio"),
        weighted(F.col("side") == "S").alias("d07_sell_permanent_ratio"),
        F.avg("gap").alias("mean_elapsed_ms"), F.median("gap").alias("median_elapsed_ms"),
    )
    trade = F.col("source_action") == "TRADE"
    quality = explode_windows(rows, WINDOWS).groupBy(*DAY, "window_name").agg(
        F.count(F.lit(1)).alias("window_event_count"), F.count("mid").alias("valid_book_event_count"),
        X.count_if(trade).alias("trade_event_count"),
        X.count_if(trade & F.col("oid").isNull()).alias("missing_aggressor_id_count"),
        X.count_if(trade & (F.col("source_link_status") == "FULL")).alias("full_link_trade_count"),
        X.count_if(trade & (F.col("source_link_status") == "PARTIAL")).alias("partial_link_trade_count"),
    )
    grid = rows.select(*DAY).distinct().join(rolling, DAY, "left")
    grid = explode_values(explode_values(grid, list(WINDOWS), "window_name"), ["mean_x05", "fixed_notional"], "threshold_version")
    clocks = F.explode(F.array(
        *[F.struct(F.lit("event").alias("clock_type"), F.lit(h).cast("long").alias("horizon")) for h in EVENT_HORIZONS],
        *[F.struct(F.lit("time").alias("clock_type"), F.lit(h).cast("long").alias("horizon")) for h in TIME_HORIZONS_MS]))
    grid = grid.withColumn("_c", clocks).select(*DAY, "mean_qty", "window_name", "threshold_version", "_c.*")
    out = grid.join(agg, key, "left").join(quality, [*DAY, "window_name"], "left")
    counts = ["episode_count", "buy_episode_count", "sell_episode_count", "nonzero_immediate_count",
              "valid_retained_count", "missing_retained_count"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in counts})
    no_cut = (F.col("threshold_version") == "mean_x05") & F.col("mean_qty").isNull()
    still, gone = F.col("nonzero_immediate_count") == 0, F.col("valid_retained_count") == 0
    return out.withColumns({
        "is_valid": ~no_cut & ~still & ~gone,
        "invalid_reason": X.reasons((no_cut, "missing_mean_threshold"), (still, "zero_immediate_impact"),
                                    (gone, "missing_retained_price")),
    })
