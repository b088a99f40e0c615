"""10:30 order state: rolling flow, chains, quotes, fill odds and 10-minute labels."""

from __future__ import annotations

from bisect import insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.lifecycle import DAY, islands
from lobloom.operators.ordered import carry_forward, first_per_key, flag_first
from lobloom.session import stage

# Fixed grid of sample times, the label end and the last order time, in ms.
GRID = (36_000_000, 36_600_000, 37_200_000, 37_800_000)
SIGNAL, LABEL_END, ORDER_CUTOFF = 37_800_000, 38_400_000, 38_400_000
LOOK = 60_000
NEAR_BPS = 10.0
SMOOTH = 20.0


def state_rows(events: DataFrame) -> DataFrame:
    """Morning rows with the last usable book before each and the trade validity flag.

    A usable book may be locked and needs three levels on both sides.
    """
    am = events.filter(X.in_window(X.AM_OPEN, X.AM_CLOSE))
    flat = am.select(
        *DAY, "row_id", X.clock_ms().alias("ms"), "time", "source_action", "source_side", "source_recid",
        "source_price", "source_volume", X.own_side_id().alias("oid"), X.other_side_id().alias("pid"),
        X.best("bid").alias("bid"), X.best("ask").alias("ask"),
        X.depth("bid_vol", 3).alias("bid3"), X.depth("ask_vol", 3).alias("ask3"))
    ok = X.book_ok("locked_ok", "bid", "ask") & F.col("bid3").isNotNull() & F.col("ask3").isNotNull()
    book = F.when(ok, F.struct("bid", "ask", "bid3", "ask3"))
    rows = carry_forward(flat.withColumn("book", book), DAY, last={"pre": F.col("book")})
    trade = (F.col("source_action") == "TRADE") & F.col("source_side").isin("B", "S") & (F.col("source_volume") > 0)
    # Duplicates are found among positive trades only; other rows keep their own key.
    rows = rows.withColumn("_rec", F.when(trade, F.col("source_recid")))
    rows = flag_first(rows, [*DAY, "_rec"], out="_one")
    return rows.withColumn(
        "is_trade", F.coalesce(trade & F.col("_one") & F.col("oid").isNotNull(), F.lit(False))).drop("_rec", "_one", "bid", "ask", "bid3", "ask3")


def quote_class(rows: DataFrame) -> DataFrame:
    """Aggressive adds (at or inside the touch, not marketable) and near-touch cancels.

    An add whose (side, id) already traded as aggressor that day is left out.
    """
    first = rows.filter("is_trade").groupBy(*DAY, F.col("source_side").alias("_side"), F.col("oid").alias("_key")).agg(
        F.min("row_id").alias("_first"))
    add = F.col("source_action") == "ORDER_ADD"
    keyed = rows.withColumns({
        "_side": F.col("source_side"),
        "_key": F.when(add & F.col("oid").isNotNull(), F.col("oid")).otherwise(-1 - F.col("row_id"))})
    r = keyed.join(first, [*DAY, "_side", "_key"], "left")
    p, b, a = F.col("source_price").cast("double"), F.col("pre.bid"), F.col("pre.ask")
    mid = (b + a) / 2.0
    buy = F.col("source_side") == "B"
    usable = F.col("pre").isNotNull() & F.col("source_side").isin("B", "S") & p.isNotNull() & (F.col("source_volume") > 0)
    market = F.when(buy, p >= a).otherwise(p <= b)
    touch = F.when(buy, p >= b).otherwise(p <= a)
    reach = mid * NEAR_BPS / 10000.0
    near = F.when(buy, p >= b - reach).otherwise(p <= a + reach)
    fresh = ~F.coalesce(F.col("_first") < F.col("row_id"), F.lit(False))
    dist_near = F.when(buy, p >= mid * (1 - NEAR_BPS / 10000.0)).otherwise(p <= mid * (1 + NEAR_BPS / 10000.0))
    return r.withColumns({
        "is_aggressive_add": F.coalesce(usable & add & fresh & ~market & touch, F.lit(False)),
        "is_near_cancel": F.coalesce(usable & (F.col("source_action") == "CANCEL") & near, F.lit(False)),
        "distance": F.when(usable & add & ~market, F.when(touch, "best").when(dist_near, "near")),
    }).drop("_side", "_key", "_first")


def trade_chains(rows: DataFrame) -> DataFrame:
    """Contiguous valid trades of one aggressor; any other row ends the chain.

    ``closed_ms`` is the time of that other row: a chain counts only once ended.
    """
    run = islands(rows, F.col("is_trade"), [F.col("source_side"), F.col("oid")], DAY, out="chain")
    run = carry_forward(run, DAY, last={"next_ms": F.col("ms")}, backward=True)
    return run.filter(F.col("chain").isNotNull()).groupBy(*DAY, "chain").agg(
        F.any_value("source_side").alias("side"), F.any_value("oid").alias("order_id"),
        F.sum("source_volume").alias("volume"), F.count(F.lit(1)).alias("children"),
        F.min("row_id").alias("first_row"), F.max("row_id").alias("last_row"),
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"),
        F.max_by(F.coalesce("next_ms", F.lit(41_400_000)), "row_id").alias("closed_ms"))


def grid_samples(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """60-second sums at each grid time, one row per stock-day and grid time."""
    c = F.col
    grid = F.array(*[F.lit(g) for g in GRID])
    near = F.filter(grid, lambda g: (c("ms") < g) & (c("ms") > g - LOOK))
    e = rows.filter(c("is_trade") | c("is_aggressive_add") | c("is_near_cancel")).withColumn("grid", F.explode(near))
    buy, v = c("source_side") == "B", "source_volume"
    sums = {}
    for flag, name in (("is_trade", "active_{}_volume"), ("is_aggressive_add", "aggressive_add_{}"), ("is_near_cancel", "near_cancel_{}")):
        sums[name.format("buy")] = X.sum0(v, c(flag) & buy)
        sums[name.format("sell")] = X.sum0(v, c(flag) & ~buy)
    sums["active_buy_count"] = X.count_if(c("is_trade") & buy)
    sums["active_sell_count"] = X.count_if(c("is_trade") & ~buy)
    ev = e.groupBy(*DAY, "grid").agg(*[x.alias(n) for n, x in sums.items()])
    live = F.filter(grid, lambda g: (c("closed_ms") < g) & (c("last_ms") > g - LOOK))
    ch = chains.withColumn("grid", F.explode(live)).groupBy(*DAY, "grid").agg(
        X.sum0("volume", c("side") == "B").alias("chain_buy_volume"), X.sum0("volume", c("side") == "S").alias("chain_sell_volume"),
        F.count(F.lit(1)).alias("chain_count"), X.count_if(c("children") > 1).alias("multi_chain_count"))
    # A day samples the grid times its session has reached.
    last = rows.groupBy(*DAY).agg(F.max("ms").alias("_last"))
    days = last.withColumn("grid", F.explode(F.filter(grid, lambda g: g <= c("_last")))).drop("_last")
    out = days.join(ev, [*DAY, "grid"], "left").join(ch, [*DAY, "grid"], "left")
    return out.withColumns({n: F.coalesce(c(n), F.lit(0).cast("long")) for n in out.columns if n not in (*DAY, "grid")})


def bucket_of(ms: Column) -> Column:
    return F.format_string("AM%02d", F.floor((ms - 34_200_000) / 1_800_000).cast("int"))


def history_thresholds(samples: DataFrame) -> DataFrame:
    """Median of the symbol's own samples on earlier days, per half-hour bucket.

    A series (one stock, one bucket) has a few numbers a day, so it is bounded by
    the calendar; it is walked once, with its values kept in order.
    """
    s = samples.select("symbol", "date", bucket_of(F.col("grid")).alias("bucket"), "active_buy_volume", "active_sell_volume")

    def so_far(key, samples):
        """Medians of all earlier days, for each day of one series."""
        samples = samples.sort_values("date")
        kept = {c: [] for c in ("active_buy_volume", "active_sell_volume")}
        out = []
        for date, day in samples.groupby("date"):
            middle = []
            for c, values in kept.items():
                n = len(values)
                middle.append((values[n // 2] + values[(n - 1) // 2]) / 2.0 if n else None)
                for v in day[c]:
                    insort(values, v)
            out.append((key[0], int(date), key[1], *middle))
        return pd.DataFrame(out, columns=["symbol", "date", "bucket", "buy_cut", "sell_cut"])

    return s.groupBy("symbol", "bucket").applyInPandas(
        so_far, "symbol string, date int, bucket string, buy_cut double, sell_cut double")


def state_name(buy, sell) -> Column:
    known = F.col("buy_cut").isNotNull() & F.col("sell_cut").isNotNull()
    return F.when(known, F.concat(
        F.lit("B"), (X.col(buy) > F.col("buy_cut")).cast("int").cast("string"),
        F.lit("S"), (X.col(sell) > F.col("sell_cut")).cast("int").cast("string"))).otherwise("unknown")


def passive_orders(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """First placement of each resting order before 10:40 with its state and 60-second fill.

    The state uses the flow since one minute before the last grid time.
    """
    c = F.col
    buy = c("is_trade") & (c("source_side") == "B")
    sell = c("is_trade") & (c("source_side") == "S")
    run = carry_forward(rows, DAY, sums={
        "cum_buy": F.when(buy, c("source_volume")).otherwise(0), "cum_sell": F.when(sell, c("source_volume")).otherwise(0)})
    grid_at = F.array_max(F.filter(F.array(*[F.lit(g) for g in GRID]), lambda g: g <= c("ms")))
    # Volume up to a minute before each grid time, one small row per stock-day.
    base = rows.groupBy(*DAY).agg(*[
        X.sum0("source_volume", cond & (c("ms") <= g - LOOK)).alias(f"_{s}{i}")
        for i, g in enumerate(GRID) for s, cond in (("b", buy), ("s", sell))])
    o = run.filter((c("source_action") == "ORDER_ADD") & c("distance").isNotNull() & c("oid").isNotNull() & (c("ms") < ORDER_CUTOFF))
    o = o.withColumns({"bucket": bucket_of(c("ms")), "grid": grid_at}).join(base, DAY)

    def before(s):
        e = F.lit(0).cast("long")
        for i, g in enumerate(GRID):
            e = F.when(c("grid") == g, c(f"_{s}{i}")).otherwise(e)
        return e

    o = o.withColumns({"_fb": c("cum_buy") - before("b"), "_fs": c("cum_sell") - before("s")})
    o = o.join(cuts, ["symbol", "date", "bucket"], "left").withColumn("state", state_name("_fb", "_fs"))
    firsts = first_per_key(
        o.withColumn("side", c("source_side")).withColumn("order_id", c("oid")), [*DAY, "side", "order_id"], "row_id",
        ["ms", "state", "distance", "source_volume"])
    trades = rows.filter("is_trade")
    hits = trades.select(*DAY, X.opposite().alias("side"), c("pid").alias("order_id"), c("row_id").alias("_tr"), c("ms").alias("_tm"), c("source_volume").alias("_tv"))
    filled = firsts.join(hits, [*DAY, "side", "order_id"]).filter((c("_tr") > c("row_id")) & (c("_tm") - c("ms") <= LOOK)).groupBy(
        *DAY, "side", "order_id").agg(F.sum("_tv").alias("filled_60s"))
    own = trades.select(*DAY, c("source_side").alias("side"), c("oid").alias("order_id")).distinct()
    out = firsts.join(own, [*DAY, "side", "order_id"], "left_anti").join(filled, [*DAY, "side", "order_id"], "left")
    return out.withColumn("filled_60s", F.coalesce("filled_60s", F.lit(0).cast("long")))


def fill_history(orders: DataFrame, days: DataFrame) -> DataFrame:
    """Orders and fills per (symbol, side, state, distance) strictly before each day."""
    c = F.col
    daily = orders.filter(c("state") != "unknown").groupBy("symbol", "date", "side", "state", "distance").agg(
        F.count(F.lit(1)).alias("n"), X.count_if(c("filled_60s") > 0).alias("f"))
    cells = F.explode(F.array(*[
        F.struct(F.lit(s).alias("side"), F.lit(st).alias("state"), F.lit(d).alias("distance"))
        for s in ("B", "S") for st in ("B0S0", "B0S1", "B1S0", "B1S1") for d in ("best", "near")]))
    grid = days.select(*DAY).distinct().withColumn("_c", cells).select(*DAY, "_c.*")
    dense = grid.join(daily, ["symbol", "date", "side", "state", "distance"], "left")
    w = Window.partitionBy("symbol", "side", "state", "distance").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    hist = dense.withColumns({"cell_n": F.coalesce(F.sum("n").over(w), F.lit(0)), "cell_f": F.coalesce(F.sum("f").over(w), F.lit(0))})
    g = Window.partitionBy("symbol", "date", "side", "distance")
    return hist.withColumns({"all_n": F.sum("cell_n").over(g), "all_f": F.sum("cell_f").over(g)}).drop("n", "f")


def fill_probability(history: DataFrame, minimum: int = 100) -> DataFrame:
    """(filled + 20 * prior) / (orders + 20), prior = side x distance rate."""
    prior = F.col("all_f") / F.col("all_n")
    return history.withColumn("pred_fill", F.when(
        F.col("all_n") >= minimum, (F.col("cell_f") + SMOOTH * prior) / (F.col("cell_n") + SMOOTH)))


def labels(rows: DataFrame) -> DataFrame:
    """What happens in [10:30, 10:40)."""
    c = F.col
    mid = (c("book.bid") + c("book.ask")) / 2.0
    m = carry_forward(rows.withColumn("mid", mid), DAY, last={"prev_mid": c("mid")})
    inside = (c("ms") >= SIGNAL) & (c("ms") < LABEL_END)
    trade = inside & c("is_trade")
    sq = F.when(inside & c("mid").isNotNull() & (c("prev_mid") > 0), F.pow(F.ln(c("mid") / c("prev_mid")), 2))
    last = lambda t: F.max_by("book", F.when(c("book").isNotNull() & (c("ms") < t), c("row_id")))
    return m.groupBy(*DAY).agg(
        X.sum0("source_volume", trade & (c("source_side") == "B")).alias("future_buy_volume"),
        X.sum0("source_volume", trade & (c("source_side") == "S")).alias("future_sell_volume"),
        X.count_if(trade & (c("source_side") == "B")).alias("future_buy_count"),
        X.count_if(trade & (c("source_side") == "S")).alias("future_sell_count"),
        X.count_if(inside).alias("future_event_count"),
        (F.sqrt(F.coalesce(F.sum(sq), F.lit(0.0))) * 10000.0).alias("future_realized_vol_bps"),
        F.count(sq).alias("future_mid_moves"), last(SIGNAL).alias("_now"), last(LABEL_END).alias("_end"),
        F.max("ms").alias("_last"))


def order_state_1030(events: DataFrame, minimum: int = 100) -> DataFrame:
    """One row per stock-day at 10:30 with state, rolling sums, fill odds and labels."""
    c = F.col
    rows = stage(quote_class(stage(state_rows(events), "state-rows")), "state-quotes")
    chains = trade_chains(rows)
    samples = stage(grid_samples(rows, chains), "state-grid")
    cuts = stage(history_thresholds(samples), "state-cuts")
    orders = passive_orders(rows, cuts)
    probs = fill_probability(fill_history(orders, rows.select(*DAY).distinct()), minimum).filter(c("distance") == "best")
    at = samples.filter(c("grid") == SIGNAL).withColumn("bucket", bucket_of(c("grid"))).join(cuts, ["symbol", "date", "bucket"], "left")
    at = at.withColumn("state", state_name("active_buy_volume", "active_sell_volume")).drop("buy_cut", "sell_cut", "bucket", "grid")
    p = probs.groupBy("symbol", "date", "state").agg(*[
        F.max(F.when(c("side") == s, c(x))).alias(n)
        for s, side in (("B", "buy"), ("S", "sell")) for x, n in (("pred_fill", f"pred_fill_{side}"), ("cell_n", f"fill_history_{side}"))])
    out = at.join(p, ["symbol", "date", "state"]).join(labels(rows), DAY)
    out = out.filter((c("state") != "unknown") & c("pred_fill_buy").isNotNull() & c("pred_fill_sell").isNotNull() & c("_now").isNotNull())

    def spread(s):
        return (c(f"{s}.ask") - c(f"{s}.bid")) / ((c(f"{s}.ask") + c(f"{s}.bid")) / 2.0) * 10000.0

    def share(a, b):
        return F.coalesce(X.ratio(a - b, a + b), F.lit(0.0))

    return out.withColumns({
        "active_net_share": share(c("active_buy_volume"), c("active_sell_volume")),
        "chain_net_share": share(c("chain_buy_volume"), c("chain_sell_volume")),
        "multi_chain_share": F.coalesce(X.ratio("multi_chain_count", "chain_count"), F.lit(0.0)),
        "single_chain_count": c("chain_count") - c("multi_chain_count"),
        "future_net_flow": c("future_buy_volume") - c("future_sell_volume"),
        "future_total_active_volume": c("future_buy_volume") + c("future_sell_volume"),
        "quote_aggressive_net": c("aggressive_add_buy") - c("aggressive_add_sell"),
        "quote_cancel_net": c("near_cancel_sell") - c("near_cancel_buy"),
        "spread_bps": spread("_now"), "bid_depth3": c("_now.bid3"), "ask_depth3": c("_now.ask3"),
        "book_imbalance3": share(c("_now.bid3"), c("_now.ask3")),
        "fill_opportunity_diff": c("pred_fill_buy") - c("pred_fill_sell"),
        "end_spread_bps": spread("_end"), "end_bid_depth3": c("_end.bid3"), "end_ask_depth3": c("_end.ask3"),
    }).drop("_now", "_end", "_last")
