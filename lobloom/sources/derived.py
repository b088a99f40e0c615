"""Event and panel tables derived from the supplied parquet tables.

The supplied data holds no order-book events, so an event table is derived row
by row from ``events`` and a symbol x month panel from ``lineitem``.  Symbols
follow users and suppliers, so both grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobloom.functions.expr import clock_ms, in_session, session_of
from lobloom.session import stage_once


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def build_lob(spark: SparkSession, sf_dir: str, users_per_symbol: int = 25) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value"
    )
    eid = F.col("event_id")
    ms_day = (
        (F.hour("ts") * 3600 + F.minute("ts") * 60).cast("long") * 1000
        + F.expr("cast(floor(extract(second from ts) * 1000) as bigint)")
    )
    sno = F.expr(f"user_id div {users_per_symbol}")
    base = e.select(
        eid, "event_type", "value",
        F.concat(
            F.when(sno % 2 == 0, "SH").otherwise("SZ"), (F.lit(600000) + sno).cast("string")
        ).alias("symbol"),
        (F.year("ts") * 10000 + F.month("ts") * 100 + F.dayofmonth("ts")).cast("int").alias("date"),
        ms_day.alias("ms_day"),
    ).withColumn(
        "c",
        F.when(F.col("ms_day") < 43200000, F.expr("34200000 + ms_day div 6"))
        .otherwise(F.expr("46800000 + ((ms_day - 43200000) * 13) div 80")),
    )
    base = base.withColumns({
        "time": F.expr(
            "(c div 3600000) * 10000000 + (c div 60000 % 60) * 100000"
            " + (c div 1000 % 60) * 1000 + c % 1000"
        ),
        "action": F.when(F.col("event_type").isin("view", "click"), "ORDER_ADD")
        .when(F.col("event_type").isin("purchase", "error"), "TRADE").otherwise("CANCEL"),
        "side": F.when(F.expr("(event_id div 4) % 2") == 0, "B").otherwise("S"),
        "buy": F.expr("1 + (c div 600000) % 12"),
        "sell": F.expr("101 + (c div 480000) % 15"),
        "bid": 100000 + 100 * ((eid * 37) % 23),
    }).withColumn(
        "ask",
        F.col("bid") + F.when(eid % 17 == 0, 0).when(eid % 19 == 0, -100)
        .otherwise(100 * (1 + eid % 3)),
    )
    trade, buy_side = F.col("action") == "TRADE", F.col("side") == "B"
    off = 100 * (eid % 4)
    price = F.when(trade, F.when(buy_side, F.col("ask")).otherwise(F.col("bid"))).otherwise(
        F.when(buy_side, F.col("bid") - off).otherwise(F.col("ask") + off)
    )
    levels = F.when(eid % 13 == 0, 2).otherwise(10)

    def ladder(fn, gone):
        arr = F.transform(F.sequence(F.lit(1), levels), fn)
        return F.when(gone, F.array().cast("array<bigint>")).otherwise(arr.cast("array<bigint>"))

    no_bid, no_ask = eid % 29 == 0, (eid % 29 == 0) | (eid % 31 == 0)
    return base.select(
        "symbol", "date", F.col("time").cast("long").alias("time"), eid.alias("row_id"),
        F.col("action").alias("source_action"), F.col("side").alias("source_side"),
        F.when(eid % 41 == 0, None).when(eid % 5 == 0, F.expr("-1 - c div 1200000"))
        .otherwise(eid).cast("long").alias("source_recid"),
        F.when(trade | buy_side, F.when(eid % 47 != 0, F.col("buy"))).cast("long")
        .alias("source_buy_order_id"),
        F.when(trade | ~buy_side, F.col("sell")).cast("long").alias("source_sell_order_id"),
        price.cast("long").alias("source_price"),
        (100 * (1 + F.floor("value") % 20)).cast("long").alias("source_volume"),
        F.when(eid % 3 == 0, "FULL").when(eid % 3 == 1, "PARTIAL").otherwise("NA")
        .alias("source_link_status"),
        ladder(lambda l: F.col("bid") - 100 * (l - 1), no_bid).alias("bid_px"),
        ladder(lambda l: F.col("ask") + 100 * (l - 1), no_ask).alias("ask_px"),
        ladder(lambda l: 100 * (1 + (eid + l) % 9), no_bid).alias("bid_vol"),
        ladder(lambda l: 100 * (1 + (eid + 2 * l) % 9), no_ask).alias("ask_vol"),
        ladder(lambda l: 1 + (eid + l) % 5, no_bid).alias("bid_cnt"),
        ladder(lambda l: 1 + (eid + 3 * l) % 5, no_ask).alias("ask_cnt"),
    )


def lob(spark: SparkSession, sf_dir: str, users_per_symbol: int = 25) -> DataFrame:
    return stage_once(
        spark, f"lob|{sf_dir}|{users_per_symbol}",
        lambda: build_lob(spark, sf_dir, users_per_symbol),
    )


def sessions(events: DataFrame) -> DataFrame:
    """Continuous-session rows with their session tag."""
    return events.filter(in_session()).withColumn("session", session_of())


def build_controls(events: DataFrame) -> DataFrame:
    """Stock-day reference panel: fixed rules over the day's own event totals."""
    g = events.groupBy("symbol", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("source_volume").alias("v"),
        F.sum(F.col("source_price") % 1000).alias("p"), F.min("row_id").alias("r"),
    )
    sym = F.substring("symbol", 3, 6).cast("long")
    return g.select(
        "symbol", "date",
        (8.0 + (F.col("p") % 700) / 100.0).alias("close_1000"),
        F.lit(1).alias("security_category"),
        (F.col("r") % 53 == 0).cast("int").alias("is_st"),
        (F.col("r") % 59 == 0).cast("int").alias("is_suspended"),
        (F.col("r") % 97 + 8).cast("int").alias("listing_days"),
        (F.col("r") % 89 + 18).cast("int").alias("liquidity_history_days"),
        F.concat(F.lit("b"), (sym % 3).cast("string")).alias("board"),
        ((F.col("v") % 997) / 100.0 - 5.0).alias("ret5_lagged"),
        ((F.col("p") % 613) / 50.0).alias("turnover20"),
        ((F.col("v") * 7 % 401) / 40.0).alias("amihud20"),
        ((F.col("p") * 3 % 211) / 30.0).alias("residual_volatility"),
        (200000.0 + (F.col("v") * 131 % 8000000)).alias("cap"),
    )


def controls(spark: SparkSession, sf_dir: str, users_per_symbol: int = 25) -> DataFrame:
    return stage_once(
        spark, f"controls|{sf_dir}|{users_per_symbol}",
        lambda: build_controls(lob(spark, sf_dir, users_per_symbol)),
    )


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol x month panel with factors, styles, cap, price and forward returns."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    q, c = F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")
    g = li.groupBy(
        F.col("l_suppkey").alias("sid"),
        (F.year("l_shipdate") * 10000 + F.month("l_shipdate") * 100 + 1).cast("int").alias("date"),
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("qty"), F.sum(c).alias("cents"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("disc"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("tax"),
        F.max(q).alias("maxq"), F.min(c).alias("minc"),
    )
    sid, n, qty, cents = F.col("sid"), F.col("n"), F.col("qty"), F.col("cents")

    def r6(x):
        return F.round(x, 6)

    base = g.select(
        F.concat(
            F.when(sid % 7 == 0, "SH688").when(sid % 2 == 0, "SH600").otherwise("SZ000"),
            F.lpad(sid.cast("string"), 12, "0"),
        ).alias("symbol"),
        "date",
        F.when(sid % 7 == 0, "SH").when(sid % 2 == 0, "SH").otherwise("SZ").alias("exchange"),
        r6(cents / qty / 100000.0 * 5.0).alias("unit"),
        r6((cents % 9973) / 100.0 - 50.0).alias("factor"),
        r6((qty * 100.0) / n).alias("factor2"),
        r6((F.col("disc") * 1.0) / n).alias("vr"),
        r6((F.col("tax") * 1.0) / n - 4.0).alias("flow"),
        qty.cast("double").alias("depth"),
        n.alias("n_obs"),
        r6((cents % 7919) / 79.19).alias("style1"),
        r6((F.col("minc") % 6007) / 60.07).alias("style2"),
        F.col("maxq").cast("double").alias("style3"),
        r6(F.ln(cents.cast("double"))).alias("style4"),
        r6((qty % 31) * 1.0).alias("style5"),
        r6(4.0 + (F.col("minc") % 1300) / 100.0).alias("price"),
        (100000.0 + (cents * 3 % 9000000)).alias("cap"),
        r6((cents % 601) / 10000.0 - 0.03).alias("ret"),
        r6((F.col("minc") % 401) / 20000.0 - 0.01).alias("ret30"),
        (sid % 40 == 0).cast("int").alias("limit_hit"),
        "sid",
    )
    return base


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, f"panel|{sf_dir}", lambda: build_panel(spark, sf_dir))


def with_clock(events: DataFrame) -> DataFrame:
    return events.withColumn("ms", clock_ms())


def build_study(base: DataFrame) -> DataFrame:
    """Panel plus the columns the studies read, all simple rules over the panel."""
    from pyspark.sql import Window

    from lobloom.functions.expr import domain_of

    c = F.col
    w = Window.partitionBy("symbol").orderBy("date")

    s = base.withColumns({
        "prev_cap": F.lag("cap").over(w), "flow5": c("flow"),
        "flow1": (c("flow") * 0.5 + (c("style5") - 15) / 10.0), "flow30": ((c("style1") - 50) / 50.0),
        "buy5": c("depth") * 3 + c("n_obs") * 10, "sell5": c("depth") * 2 + c("style5") * 5,
        "ask5": (c("style1") * 10 + 50), "bid5": (c("style2") * 10 + 50),
        "ask30": c("style3") * 10 + 50, "bid30": (c("style1") * 5 + c("style2") * 5 + 50),
        "book5": ((c("style2") - c("style1")) / 100.0), "book30": ((c("style3") - 25) / 25.0),
        "fillability": (c("style2") / 100.0), "execution_pressure": ((c("style1") - c("style2")) / 100.0),
        "past_return": (c("ret30") / 2.0),
    })
    return s.withColumns({
        "domain": domain_of("prev_cap", "price"),
        "endpoint_book": ((c("bid5") - c("ask5")) / (c("bid5") + c("ask5"))),
        "flow_shift": (c("flow5") - c("flow30")), "book_shift": (c("book5") - c("book30")),
        "active_buy_volume": c("buy5"), "active_sell_volume": c("sell5"), "active_count": c("n_obs"),
        "near_cancel_buy": c("style5") * 10, "near_cancel_sell": c("style3") * 4,
        "aggressive_add_buy": c("style3") * 3, "aggressive_add_sell": c("style5") * 6,
        "active_net_share": (c("flow") / 5.0), "chain_net_share": (c("flow1") / 5.0),
        "multi_chain_share": (c("style2") / 100.0),
        "pred_fill_buy": (0.1 + c("style1") / 200.0), "pred_fill_sell": (0.1 + c("style2") / 200.0),
        "bid_depth3": c("bid5"), "ask_depth3": c("ask5"), "end_bid_depth3": c("bid30"), "end_ask_depth3": c("ask30"),
        "spread_bps": c("style2"), "end_spread_bps": c("style1"),
        "future_buy_volume": c("depth") * 2, "future_sell_volume": c("style5") * 30,
        "fill_history_buy": c("n_obs") * 3 + c("style3"), "fill_history_sell": c("depth") + c("style1") * 2,
        "future_event_count": c("n_obs").cast("double"), "future_realized_vol_bps": c("style3"),
    }).withColumn("book_imbalance3", c("endpoint_book")).filter(c("domain").isNotNull())


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_once(spark, f"study|{sf_dir}", lambda: build_study(panel(spark, sf_dir)))
