"""Chains, quotes and impacts between 10:00 and 10:30."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.asof import asof
from lobloom.operators.lifecycle import DAY
from lobloom.operators.ordered import carry_forward, dense_order
from lobloom.session import stage

START, END = X.WINDOWS["intraday_1000_1030"]
END_MS = 37_800_000
HORIZONS = (5, 30, 60)
CHAIN = [*DAY, "side", "order_id"]


def window_rows(events: DataFrame, start: int = START, end: int = END) -> DataFrame:
    """Scalar rows of the window with the last valid book before each (``pre``).

    ``segment`` is that book's row: an invalid stretch and the valid row that ends
    it share a segment, so a stretch is settled by one grouping.
    """
    rows = events.filter(X.in_window(start, end))
    flat = rows.select(
        *DAY, "row_id", X.clock_ms().alias("ms"), "source_action", "source_side", "source_price",
        "source_volume", X.own_side_id().alias("order_id"),
        X.best("bid").alias("bid"), X.best("ask").alias("ask"),
        *[X.depth(f"{s}_vol", k).alias(f"{s}{k}") for s in ("bid", "ask") for k in (1, 3)],
        *[F.try_element_at(f"{s}_cnt", F.lit(1)).alias(f"{s}_n1") for s in ("bid", "ask")])
    flat = flat.withColumn("ok", X.book_ok("strict", "bid", "ask"))
    book = F.when(F.col("ok"), F.struct("row_id", "bid", "ask", "bid1", "ask1", "bid3", "ask3"))
    r = carry_forward(flat, DAY, last={"pre": book})
    return r.withColumns({
        "segment": F.col("pre.row_id"),
        "mid": F.when(F.col("ok"), (F.col("bid") + F.col("ask")) / 2.0),
        "pre_mid": (F.col("pre.bid") + F.col("pre.ask")) / 2.0})


def segments(rows: DataFrame) -> DataFrame:
    """One row per stretch between two valid books: who traded, and the book after."""
    trade = (F.col("source_action") == "TRADE") & F.col("source_side").isin("B", "S")
    at = F.when(trade, F.col("row_id"))
    return rows.filter(F.col("segment").isNotNull()).groupBy(*DAY, "segment").agg(
        X.count_if(~F.col("ok")).alias("invalid_rows"),
        F.min(F.when(trade, F.col("source_side"))).alias("lo_side"),
        F.max(F.when(trade, F.col("source_side"))).alias("hi_side"),
        F.max_by(F.when(F.col("source_volume") > 0, F.col("order_id")), at).alias("last_order"),
        F.max_by(F.struct("row_id", "ms", "mid", "bid3", "ask3"), F.when(F.col("ok"), F.col("row_id"))).alias("after"),
        F.any_value("pre_mid").alias("before_mid"), F.any_value("pre").alias("pre"))


def _effect(df: DataFrame, side: str, before: str, after: str) -> DataFrame:
    buy = F.col(side) == "B"
    move = F.col(f"{after}.mid") - F.col(before)
    loss = F.when(buy, F.col("pre.ask3") - F.col(f"{after}.ask3")).otherwise(F.col("pre.bid3") - F.col(f"{after}.bid3"))
    return df.withColumns({
        "immediate": F.when(buy, move).otherwise(-move),
        "impact_bps": F.when(buy, move).otherwise(-move) / F.col(before) * 10000.0,
        "depth_loss": F.when(loss > 0, loss)})


def trade_effects(rows: DataFrame, seg: DataFrame) -> DataFrame:
    """Every counted trade; those in an ordinary step carry their own book effect."""
    t = rows.filter(
        (F.col("source_action") == "TRADE") & F.col("source_side").isin("B", "S")
        & (F.col("source_volume") > 0) & F.col("segment").isNotNull())
    t = t.join(seg.select(*DAY, "segment", "invalid_rows"), [*DAY, "segment"])
    t = t.withColumn("after", F.when(F.col("invalid_rows") == 0, F.struct("mid", "bid3", "ask3")))
    return _effect(t, "source_side", "pre_mid", "after").select(
        *DAY, F.col("source_side").alias("side"), "order_id", "row_id", "ms", "source_price", "source_volume",
        F.col("pre_mid").alias("before_mid"), "immediate", "impact_bps", "depth_loss",
        (F.col("invalid_rows") > 0).alias("atomic"))


def atomic_effects(seg: DataFrame) -> DataFrame:
    """Invalid stretches closed by a valid book; one-sided ones give one impact."""
    a = seg.filter((F.col("invalid_rows") > 0) & F.col("after").isNotNull())
    one = F.coalesce(F.col("lo_side") == F.col("hi_side"), F.lit(False))
    a = _effect(a.withColumns({"one_sided": one, "side": F.col("lo_side")}), "side", "before_mid", "after")
    return a.select(
        *DAY, "segment", "one_sided", F.when(F.col("one_sided"), F.col("side")).alias("side"),
        F.col("last_order").alias("order_id"), F.col("after.row_id").alias("row_id"), F.col("after.ms").alias("ms"),
        "before_mid", *[F.when(F.col("one_sided"), F.col(c)).alias(c) for c in ("immediate", "impact_bps", "depth_loss")])


def order_chains(trades: DataFrame, atomic: DataFrame) -> DataFrame:
    """One row per (side, aggressor): size, duration, impact, depth loss, acceleration.

    The means of the first and last half of the gaps telescope to four trade
    times, so only positions inside the chain are needed.
    """
    known = dense_order(trades.filter(F.col("order_id").isNotNull()), CHAIN, out="k")
    base = known.groupBy(*CHAIN).agg(
        F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.count(F.lit(1)).alias("trade_count"),
        F.sum("source_volume").alias("volume"), F.sum(F.col("source_volume") * F.col("source_price")).alias("notional"),
        F.coalesce(F.sum("impact_bps"), F.lit(0.0)).alias("_i"), F.coalesce(F.sum("depth_loss"), F.lit(0)).alias("_d"))
    n = F.col("trade_count")
    half = F.greatest(F.lit(1), F.floor((n - 1) / 2))
    at = known.join(base.filter(n >= 4).select(*CHAIN, "trade_count"), CHAIN).groupBy(*CHAIN).agg(
        F.max(F.when(F.col("k") == half + 1, F.col("ms"))).alias("_a"),
        F.max(F.when(F.col("k") == n - half, F.col("ms"))).alias("_b"))
    extra = atomic.filter("one_sided").filter(F.col("order_id").isNotNull()).groupBy(*CHAIN).agg(
        F.sum("impact_bps").alias("_ai"), F.sum("depth_loss").alias("_ad"))
    out = base.join(at, CHAIN, "left").join(extra, CHAIN, "left")
    zero = F.lit(0.0)
    return out.select(
        *CHAIN, (F.col("first_ms") / 1000.0).alias("first_seconds"), (F.col("last_ms") / 1000.0).alias("last_seconds"),
        ((F.col("last_ms") - F.col("first_ms")) / 1000.0).alias("duration_seconds"), "trade_count", "volume", "notional",
        (F.col("_i") + F.coalesce("_ai", zero)).alias("directional_impact_bps_sum"),
        (F.col("_d") + F.coalesce("_ad", F.lit(0))).cast("long").alias("depth_loss"),
        (((F.col("_a") - F.col("first_ms")) - (F.col("last_ms") - F.col("_b"))) / 1000.0 / half).alias("acceleration_seconds"))


def impact_retention(rows: DataFrame, trades: DataFrame, atomic: DataFrame) -> DataFrame:
    """Each impact at 5, 30 and 60 s later; censored when the window ends first."""
    cols = [*DAY, "side", "row_id", "ms", "before_mid", "immediate"]
    shots = trades.filter(~F.col("atomic")).select(*cols).unionByName(atomic.filter("one_sided").select(*cols))
    probes = shots.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS]))).withColumn(
        "deadline", F.col("ms") + F.col("horizon") * 1000)
    hit = asof(probes, rows.filter("ok"), DAY, "deadline", "ms", {"later_mid": F.col("mid")})
    kept = F.when(F.col("side") == "B", F.col("later_mid") - F.col("before_mid")).otherwise(F.col("before_mid") - F.col("later_mid"))
    return hit.select(*cols, "horizon", kept.alias("retained"),
                      F.col("later_mid").isNull().alias("censored"),
                      F.when(F.col("later_mid").isNotNull(), ((F.col("immediate") != 0) & (kept * F.col("immediate") < 0)).cast("int")).alias("is_reversed"))


def quote_lifecycles(rows: DataFrame, seg: DataFrame, trades: DataFrame) -> DataFrame:
    """New best quotes inside the spread, until that best price changes.

    The end is the next valid row with another best price; a re-hit is the next
    trade at the quote's price if it comes no later than the end.
    """
    c = F.col
    valid = rows.filter("ok").select(*DAY, "row_id", "ms", "source_action", "bid", "ask", "pre")
    ends = {}
    for s in ("bid", "ask"):
        changed = ~c(s).eqNullSafe(c(f"pre.{s}"))
        ends[f"next_{s}"] = F.when(changed, F.struct("row_id", "ms", "bid", "ask", "source_action"))
    nxt = carry_forward(valid, DAY, last=ends, backward=True).select(*DAY, "row_id", *ends)
    first_hit = trades.filter(c("order_id").isNotNull()).groupBy(*CHAIN).agg(F.min("row_id").alias("_ft"))
    buy = c("source_side") == "B"
    inside = F.when(buy, (c("bid") > c("pre.bid")) & (c("bid") < c("pre.ask"))).otherwise(
        (c("ask") < c("pre.ask")) & (c("ask") > c("pre.bid")))
    q = rows.filter(c("ok") & (c("source_action") == "ORDER_ADD") & c("source_side").isin("B", "S") & c("segment").isNotNull() & inside)
    q = q.join(seg.filter("invalid_rows = 0").select(*DAY, "segment"), [*DAY, "segment"], "left_semi")
    q = q.withColumn("side", c("source_side")).withColumn("order_id", F.coalesce("order_id", -1 - c("row_id"))).join(first_hit, CHAIN, "left")
    q = q.filter(~(c("symbol").startswith("SH") & F.coalesce(c("_ft") < c("row_id"), F.lit(False))))
    q = q.select(
        *DAY, "side", "row_id", "ms", F.when(buy, c("bid")).otherwise(c("ask")).alias("quote_price"),
        F.when(buy, c("bid1")).otherwise(c("ask1")).alias("quote_quantity"),
        F.when(buy, c("bid_n1")).otherwise(c("ask_n1")).alias("quote_count"),
        F.when(buy, c("pre.bid1")).otherwise(c("pre.ask1")).alias("prior_side_quantity"),
        c("pre.bid").alias("prior_bid"), c("pre.ask").alias("prior_ask"))
    q = stage(q.join(nxt, [*DAY, "row_id"]).withColumn("end", F.when(c("side") == "B", c("next_bid")).otherwise(c("next_ask"))).drop(*ends), "quotes")
    hits = rows.filter(c("source_action") == "TRADE").select(*DAY, c("source_price").alias("quote_price"), "row_id", c("row_id").alias("trade_row"))
    line = hits.unionByName(q.select(*DAY, "quote_price", "row_id"), allowMissingColumns=True)
    re = carry_forward(line, [*DAY, "quote_price"], last={"next_trade": c("trade_row")}, backward=True).filter(c("trade_row").isNull())
    out = q.join(re.select(*DAY, "row_id", "next_trade"), [*DAY, "row_id"])
    gone = c("end").isNotNull()
    return out.select(
        *DAY, "side", c("row_id").alias("start_row_id"), c("end.row_id").alias("end_row_id"), "quote_price", "quote_quantity",
        "quote_count", "prior_side_quantity", F.when(c("prior_side_quantity") > 0, X.ratio("quote_quantity", "prior_side_quantity")).alias("relative_depth"),
        ((F.coalesce(c("end.ms"), F.lit(END_MS)) - c("ms")) / 1000.0).alias("lifetime_seconds"),
        F.coalesce(c("next_trade") <= F.coalesce(c("end.row_id"), c("next_trade")), F.lit(False)).cast("int").alias("rehit"),
        F.when(gone & (c("end.bid") == c("prior_bid")) & (c("end.ask") == c("prior_ask")), 1).otherwise(0).alias("restored_pre_event_book"),
        F.when(gone, 0).otherwise(1).alias("censored_at_signal"),
        F.coalesce(c("end.source_action"), F.lit("CENSORED")).alias("removal_action"))


def primitives(events: DataFrame) -> dict[str, DataFrame]:
    """All tables of the window from one staged row table."""
    rows = stage(window_rows(events), "prim-rows")
    seg = stage(segments(rows), "prim-segments")
    trades = stage(trade_effects(rows, seg), "prim-trades")
    atomic = atomic_effects(seg)
    return {
        "rows": rows, "segments": seg, "trades": trades, "atomic": atomic,
        "chains": order_chains(trades, atomic), "retention": impact_retention(rows, trades, atomic),
        "quotes": quote_lifecycles(rows, seg, trades)}


def concentration(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Sum of squared shares, entropy and largest share; from three plain sums.

    With total T: HHI = sum(v^2)/T^2 and entropy = ln T - sum(v ln v)/T.
    """
    v = F.col(value).cast("double")
    g = df.filter(v > 0).groupBy(*group).agg(
        F.sum(v).alias("_t"), F.sum(v * v).alias("_q"), F.sum(v * F.ln(v)).alias("_e"), F.max(v).alias("_x"))
    t = F.col("_t")
    return g.select(*group, (F.col("_q") / (t * t)).alias("hhi"), (F.ln(t) - F.col("_e") / t).alias("entropy"), (F.col("_x") / t).alias("largest_share"))


def signal_row(p: dict[str, DataFrame]) -> DataFrame:
    """Stock-day roll-up of chains, quotes, impacts and the mean book."""
    c = F.col
    rows, trades = p["rows"], p["trades"]
    chains, quotes, kept = stage(p["chains"], "chains"), stage(p["quotes"], "quote-rows"), stage(p["retention"], "retention")
    book = rows.groupBy(*DAY).agg(
        F.count("mid").alias("valid_books"), X.count_if(~c("ok")).alias("invalid_books"),
        F.avg(F.when(c("ok"), (c("ask") - c("bid")) / c("mid") * 10000.0)).alias("mean_spread_bps"),
        *[(F.sum(F.when(c("ok"), c(f"{s}{k}"))) / F.greatest(F.lit(1), F.count("mid"))).alias(f"mean_{s}_depth{k}") for s in ("bid", "ask") for k in (1, 3)],
        *[(F.sum(F.when(c("ok"), c(f"{s}_n1"))) / F.greatest(F.lit(1), F.count("mid"))).alias(f"mean_{s}_count1") for s in ("bid", "ask")])
    act = trades.groupBy(*DAY).agg(
        *[X.sum0("source_volume", c("side") == s).alias(f"active_{n}_volume") for s, n in (("B", "buy"), ("S", "sell"))],
        *[X.count_if(c("side") == s).alias(f"active_{n}_count") for s, n in (("B", "buy"), ("S", "sell"))],
        X.count_if(c("order_id").isNull()).alias("missing_active_order_id"))
    ch = chains.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("chain_count"), X.count_if(c("trade_count") > 1).alias("multi_trade_chain_count"),
        X.ratio(X.sum0("volume", c("trade_count") > 1), F.sum("volume")).alias("multi_trade_chain_volume_share"))
    conc = concentration(chains, DAY, "volume").select(
        *DAY, c("hhi").alias("chain_volume_hhi"), c("entropy").alias("chain_volume_entropy"), c("largest_share").alias("largest_chain_volume_share"))
    qt = quotes.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("new_quote_count"), F.avg("relative_depth").alias("new_quote_relative_depth_mean"),
        F.avg(F.when(c("relative_depth").isNotNull(), (c("relative_depth") < 0.5).cast("double"))).alias("new_quote_thin_share_lt_0_5"),
        F.avg(c("rehit").cast("double")).alias("new_quote_rehit_share"),
        F.avg(F.when(c("censored_at_signal") == 0, c("restored_pre_event_book").cast("double"))).alias("new_quote_restored_share"),
        F.sum("censored_at_signal").alias("new_quote_censored_count"),
        *[X.count_if(c("side") == s).alias(f"passive_improve_{n}_count") for s, n in (("B", "buy"), ("S", "sell"))])
    at = p["atomic"].groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("atomic_book_chains"), X.count_if(~c("one_sided")).alias("atomic_ambiguous_chains"))
    im = kept.groupBy(*DAY).agg(*[e for h in HORIZONS for e in (
        X.count_if((c("horizon") == h) & ~c("censored")).alias(f"impact_observations_{h}s"),
        X.count_if((c("horizon") == h) & c("censored")).alias(f"impact_censored_{h}s"),
        F.avg(F.when((c("horizon") == h) & ~c("censored"), c("immediate"))).alias(f"directional_immediate_impact_mean_{h}s"),
        F.avg(F.when((c("horizon") == h) & ~c("censored"), c("retained"))).alias(f"directional_retained_impact_mean_{h}s"),
        F.avg(F.when(c("horizon") == h, c("is_reversed").cast("double"))).alias(f"impact_reversal_share_{h}s"))])
    out = book
    for part in (act, ch, conc, qt, at, im):
        out = out.join(part, DAY, "left")
    counts = [x for x in out.columns if x.endswith(("_count", "_chains", "_volume", "_id")) or "impact_observations" in x or "impact_censored" in x]
    out = out.withColumns({x: F.coalesce(c(x), F.lit(0).cast("long")) for x in counts})
    return out.withColumn("active_net_share", X.ratio(c("active_buy_volume") - c("active_sell_volume"), c("active_buy_volume") + c("active_sell_volume")))
