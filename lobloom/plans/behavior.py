"""Traded against passively submitted volume, and aggressors against submitters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.lifecycle import DAY, aggressor_ids, trades_once
from lobloom.operators.ordered import first_per_key
from lobloom.plans.large_gap import DAILY, INTRADAY, joint_gap, theta, typical_spread

ADDITIVE = (
    "trade_qty", "trade_count", "aggr_order_count", "passive_submit_qty", "passive_order_count",
    "aggressive_order_add_qty_excluded", "aggressive_order_add_count_excluded",
    "unidentified_aggr_trade_qty", "unidentified_aggr_trade_count",
    "duplicate_trade_rows_excluded", "invalid_order_add_count",
)


def _with_logs(df: DataFrame) -> DataFrame:
    logs = df.withColumns({
        "vr_log": X.log_ratio("trade_qty", "passive_submit_qty"),
        "cr_log": X.log_ratio("aggr_order_count", "passive_order_count"),
    })
    return logs.withColumn("single_size_ratio_log", F.col("vr_log") - F.col("cr_log"))


def _with_validity(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns({
        "is_valid": (c("trade_qty") > 0) & (c("aggr_order_count") > 0) & (c("passive_submit_qty") > 0)
        & (c("passive_order_count") > 0) & (c("unidentified_aggr_trade_count") == 0)
        & (c("invalid_order_add_count") == 0),
        "invalid_reason": X.reasons(
            (c("trade_qty") == 0, "zero_trade_qty"),
            (c("aggr_order_count") == 0, "zero_aggr_order_count"),
            (c("passive_submit_qty") == 0, "zero_passive_submit_qty"),
            (c("passive_order_count") == 0, "zero_passive_order_count"),
            (c("unidentified_aggr_trade_count") > 0, "unidentified_aggressor"),
            (c("invalid_order_add_count") > 0, "invalid_order_adds_present"),
        ),
    })


def order_behavior(
    events: DataFrame, start: int = INTRADAY[0], end: int = INTRADAY[1],
    known_from: int | None = None,
) -> DataFrame:
    """Log ratios for one window; aggressors are known from the session start."""
    if known_from is None:
        known_from = X.AM_OPEN if start < X.AM_CLOSE else X.PM_OPEN
    rows = events.filter(X.in_window(known_from, end) & X.in_session()).select(
        *DAY, "time", "row_id", "source_action", "source_recid", "source_side", "source_volume",
        "source_buy_order_id", "source_sell_order_id",
    )
    trades = trades_once(rows, known_side=False)
    here = X.in_window(start, end)
    raw = rows.filter(here & (F.col("source_action") == "TRADE") & (F.col("source_volume") > 0))
    own = X.own_side_id()
    trade_agg = trades.filter(here).groupBy(*DAY).agg(
        F.sum("source_volume").alias("trade_qty"),
        F.count(F.lit(1)).alias("trade_count"),
        F.count_distinct(F.struct("source_side", own)).alias("aggr_order_count"),
        X.sum0("source_volume", own.isNull()).alias("unidentified_aggr_trade_qty"),
        X.count_if(own.isNull()).alias("unidentified_aggr_trade_count"),
    )
    raw_agg = raw.groupBy(*DAY).agg(F.count(F.lit(1)).alias("_raw_trades"))
    adds = rows.filter(here & (F.col("source_action") == "ORDER_ADD")).select(
        *DAY, F.col("source_side").alias("side"), own.alias("order_id"), "row_id", "source_volume"
    )
    bad = F.col("order_id").isNull() | F.col("source_volume").isNull() | (F.col("source_volume") <= 0)
    invalid = adds.groupBy(*DAY).agg(X.count_if(bad).alias("invalid_order_add_count"))
    firsts = first_per_key(
        adds.filter(F.col("order_id").isNotNull()), [*DAY, "side", "order_id"], "row_id",
        ["source_volume"],
    ).filter(F.col("source_volume") > 0)
    marked = firsts.join(
        aggressor_ids(trades).withColumn("_aggr", F.lit(True)), [*DAY, "side", "order_id"], "left"
    )
    aggr, passive = F.col("_aggr").isNotNull(), F.col("_aggr").isNull()
    order_agg = marked.groupBy(*DAY).agg(
        X.sum0("source_volume", passive).alias("passive_submit_qty"),
        X.count_if(passive).alias("passive_order_count"),
        X.sum0("source_volume", aggr).alias("aggressive_order_add_qty_excluded"),
        X.count_if(aggr).alias("aggressive_order_add_count_excluded"),
    )
    parts = [trade_agg, order_agg, invalid]
    # A stock-day is reported for a kept trade or any add, not for repeated trades alone.
    wide = reduce(lambda a, b: a.join(b, DAY, "full_outer"), parts[:3]).join(raw_agg, DAY, "left")
    zero = F.lit(0).cast("long")
    filled = wide.withColumn(
        "duplicate_trade_rows_excluded",
        F.coalesce("_raw_trades", zero) - F.coalesce("trade_count", zero),
    ).withColumns({n: F.coalesce(n, zero) for n in ADDITIVE})
    return _with_validity(_with_logs(filled.select(
        *DAY, F.lit(start).cast("long").alias("window_start"),
        F.lit(end).cast("long").alias("window_end"), *ADDITIVE,
    )))


def combine_sessions(sessions: list[DataFrame]) -> DataFrame:
    """Add the additive fields of the sessions and recompute the ratios."""
    tagged = [
        s.select(*DAY, *ADDITIVE, "is_valid", "invalid_reason", F.lit(i + 1).alias("_s"))
        for i, s in enumerate(sessions)
    ]
    rows = reduce(DataFrame.unionByName, tagged)
    note = F.when(
        F.col("invalid_reason") != "",
        F.struct("_s", F.concat(F.lit("session_"), F.col("_s").cast("string"), F.lit(":"), F.col("invalid_reason")).alias("t")),
    )
    # The list holds at most one entry per session of a stock-day.
    g = rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("session_count"),
        *[F.sum(n).alias(n) for n in ADDITIVE],
        F.bool_and("is_valid").alias("_ok"),
        F.transform(F.sort_array(F.collect_list(note)), lambda x: x["t"]).alias("_notes"),
    )
    whole = F.col("session_count") == len(sessions)
    missing = F.when(~whole, F.concat(
        F.lit("incomplete_sessions:"), F.col("session_count").cast("string"), F.lit(f"/{len(sessions)}")
    ))
    return _with_logs(g).withColumns({
        "is_valid": whole & F.col("_ok"),
        "invalid_reason": F.concat_ws(";", F.array_join("_notes", ";"), missing),
    }).withColumn(
        "invalid_reason", F.regexp_replace("invalid_reason", "^;|;$", "")
    ).drop("_ok", "_notes")


def joint_gap_behavior(events: DataFrame, market: DataFrame | None = None) -> DataFrame:
    """Spread, theta, gap totals and order behaviour, daily and intraday, one row per stock-day."""
    thetas = theta(typical_spread(events), market=market)
    out = thetas.withColumn("has_theta", F.col("theta_5d_raw").isNotNull())
    out = out.join(joint_gap(events, thetas), DAY, "left")
    for prefix, win in (("ob", INTRADAY), ("daily_ob", DAILY)):
        b = order_behavior(events, *win, known_from=X.AM_OPEN)
        keep = [*ADDITIVE, "is_valid", "invalid_reason"]
        if prefix == "ob":
            keep += ["vr_log", "cr_log", "single_size_ratio_log"]
        plain = {"vr_log", "cr_log", "single_size_ratio_log"}
        out = out.join(
            b.select(*DAY, *[F.col(n).alias(n if n in plain else f"{prefix}_{n}") for n in keep]),
            DAY, "left",
        )
    return out
