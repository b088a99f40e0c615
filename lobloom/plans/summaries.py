"""Mechanism tables and their roll-ups, the order audit, sampling and FIFO takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.crosssection import position
from lobloom.operators.lifecycle import DAY, ORDER, order_facts
from lobloom.operators.ordered import carry_forward, span_of
from lobloom.sources.derived import sessions

HORIZONS = (5, 30, 60)


def depth_bin(c: str = "relative_depth") -> Column:
    v = F.col(c)
    return (F.when(v <= 0.10, "01_<=0.10").when(v <= 0.25, "02_0.10-0.25").when(v <= 0.50, "03_0.25-0.50")
            .when(v <= 1.00, "04_0.50-1.00").otherwise("05_>1.00"))


def chain_day(chains: DataFrame) -> DataFrame:
    """Fragment counts, durations and acceleration of chains per stock-day."""
    c = F.col
    multi = c("trade_count") > 1
    dur = F.when(multi, c("duration_seconds"))
    return chains.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("chain_rows"), X.count_if(multi).alias("multi_chain_rows"),
        F.sum("volume").cast("double").alias("chain_volume"),
        X.ratio(F.sum(F.when(multi, c("volume"))), F.sum("volume")).alias("multi_chain_volume_share"),
        F.avg("trade_count").alias("mean_fragments"), F.percentile("trade_count", F.lit(0.5)).alias("median_fragments"),
        F.percentile("trade_count", F.lit(0.9)).alias("p90_fragments"), F.avg(dur).alias("mean_multi_duration"),
        F.percentile(dur, F.lit(0.5)).alias("median_multi_duration"), F.percentile(dur, F.lit(0.9)).alias("p90_multi_duration"), F.avg("acceleration_seconds").alias("mean_acceleration"),
        F.count("acceleration_seconds").alias("acceleration_rows"))


def quote_day_bin(quotes: DataFrame) -> DataFrame:
    """Quote outcomes per stock-day and relative-depth bin."""
    c = F.col
    closed = c("censored_at_signal") == 0
    q = quotes.filter(c("relative_depth") >= 0).withColumn("depth_bin", depth_bin())
    return q.groupBy(*DAY, "depth_bin").agg(
        F.count(F.lit(1)).alias("quote_events"), F.avg("relative_depth").alias("mean_relative_depth"), F.avg("rehit").alias("rehit_share"),
        F.avg(F.when(closed, c("restored_pre_event_book"))).alias("restored_share_closed"),
        F.avg(F.when(closed, (c("removal_action") == "TRADE").cast("int"))).alias("trade_removal_share_closed"),
        F.avg("censored_at_signal").alias("censored_share"), F.avg(F.when(closed, c("lifetime_seconds"))).alias("mean_lifetime_closed"),
        F.percentile(F.when(closed, c("lifetime_seconds")), F.lit(0.5)).alias("median_lifetime_closed"))


def quote_day_features(quotes: DataFrame) -> DataFrame:
    """Thin-quote shares and outcomes per stock-day."""
    c = F.col
    q = quotes.filter(c("relative_depth") >= 0)
    thin, closed = c("relative_depth") < 0.5, c("censored_at_signal") == 0
    return q.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("quote_events"), X.count_if(thin).alias("thin_quote_events"),
        X.count_if(c("relative_depth") <= 0.1).alias("ultra_thin_quote_events"), F.avg(thin.cast("double")).alias("thin_quote_share"),
        F.avg("relative_depth").alias("relative_depth_mean"), F.avg(F.when(thin, c("rehit"))).alias("thin_rehit_share"),
        F.avg(F.when(thin & closed, c("restored_pre_event_book"))).alias("thin_restored_share_closed"),
        F.avg(F.when(thin, c("censored_at_signal"))).alias("thin_censored_share"))


def enriched_signals(signals: DataFrame, panel: DataFrame) -> DataFrame:
    """Signals with price and previous cap and their per-date terciles.

    Terciles follow ``ntile``: the first ``n mod 3`` tiles get one name more.
    """
    w = Window.partitionBy("symbol").orderBy("date")
    caps = panel.select(*DAY, F.col("close_1000").alias("price"), F.lag("cap").over(w).alias("lag_cap"))
    j = signals.join(caps, DAY).filter((F.col("price") > 0) & (F.col("lag_cap") > 0))
    for v, out in (("price", "price_tercile"), ("lag_cap", "cap_tercile")):
        j = position(j, ["date"], [F.col(v), F.col("symbol")], out="_p", total="_n").withColumn(out, ntile(F.col("_p"), F.col("_n"), 3)).drop("_p", "_n")
    return j


def ntile(pos: Column, n: Column, k: int) -> Column:
    """SQL ntile from a 1-based position and the group size."""
    size, extra = F.floor(n / k), n % k
    cut = extra * (size + 1)
    return F.when(pos <= cut, F.floor((pos - 1) / (size + 1)) + 1).otherwise(
        extra + F.floor((pos - 1 - cut) / F.greatest(size, F.lit(1))) + 1).cast("int")


def impact_features(enriched: DataFrame) -> DataFrame:
    """Impact, drift and reversal over price, and the low-price large-cap flag."""
    c = F.col
    out = {"low_price_large_cap": ((c("price_tercile") == 1) & (c("cap_tercile") == 3)).cast("int")}
    for h in HORIZONS:
        now, later = c(f"directional_immediate_impact_mean_{h}s") / c("price"), c(f"directional_retained_impact_mean_{h}s") / c("price")
        out |= {f"immediate_bps_{h}s": now, f"retained_bps_{h}s": later, f"drift_bps_{h}s": later - now, f"reversal_share_{h}s": c(f"impact_reversal_share_{h}s"),
                f"observations_{h}s": c(f"impact_observations_{h}s")}
    return enriched.select(*DAY, "price", "lag_cap", "price_tercile", "cap_tercile", *[e.alias(n) for n, e in out.items()])


def with_month_and_all(df: DataFrame) -> DataFrame:
    month = F.floor(F.col("date") / 100).cast("string")
    return df.withColumn("month", F.explode(F.array(month, F.lit("ALL"))))


def horizons_long(features: DataFrame) -> DataFrame:
    items = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"observations_{h}s").alias("observations"), F.col(f"immediate_bps_{h}s").alias("immediate_bps"),
                 F.col(f"retained_bps_{h}s").alias("retained_bps"), F.col(f"reversal_share_{h}s").alias("reversal_share")) for h in HORIZONS]))
    return features.withColumn("_h", items).select(*DAY, "_h.*").filter(F.col("observations") > 0)


def retention_summary(features: DataFrame) -> DataFrame:
    """Date-equal impact, drift and its t, by month and over all dates."""
    d = horizons_long(features).groupBy("date", "horizon").agg(
        F.count(F.lit(1)).alias("stocks"), F.sum("observations").alias("observations"),
        *[F.avg(x).alias(x) for x in ("immediate_bps", "retained_bps", "reversal_share")])
    drift = F.col("retained_bps") - F.col("immediate_bps")
    se = F.stddev_samp(drift) / F.sqrt(F.count(F.lit(1)).cast("double"))
    return with_month_and_all(d).groupBy("month", "horizon").agg(
        F.count(F.lit(1)).alias("dates"), F.sum("stocks").alias("stock_days"), F.sum("observations").alias("observations"),
        F.avg("immediate_bps").alias("date_equal_immediate_bps"), F.avg("retained_bps").alias("date_equal_retained_bps"),
        F.avg(drift).alias("date_equal_drift_bps"), F.avg("reversal_share").alias("date_equal_reversal_share"),
        se.alias("drift_se"), F.try_divide(F.avg(drift), se).alias("drift_t"))


def impact_by_exchange(features: DataFrame) -> DataFrame:
    """Stock-day-equal against event-weighted means per exchange and horizon."""
    c = F.col
    d = horizons_long(features).withColumn("exchange", F.substring("symbol", 1, 2)).groupBy("date", "exchange", "horizon").agg(
        F.count(F.lit(1)).alias("stocks"), F.sum("observations").alias("obs"), F.avg("immediate_bps").alias("eq_i"), F.avg("retained_bps").alias("eq_r"),
        F.sum(c("immediate_bps") * c("observations")).alias("sw_i"), F.sum(c("retained_bps") * c("observations")).alias("sw_r"))
    return d.groupBy("exchange", "horizon").agg(
        F.count(F.lit(1)).alias("dates"), F.sum("stocks").alias("stock_days"), F.sum("obs").alias("observations"),
        F.avg("eq_i").alias("stock_day_equal_immediate_bps"), F.avg("eq_r").alias("stock_day_equal_retained_bps"),
        (F.sum("sw_i") / F.sum("obs")).alias("event_weighted_immediate_bps"), (F.sum("sw_r") / F.sum("obs")).alias("event_weighted_retained_bps"))


def price_cap_grid(features: DataFrame) -> DataFrame:
    """Date-equal means on the price x cap tercile grid."""
    d = features.groupBy("date", "price_tercile", "cap_tercile").agg(
        F.count(F.lit(1)).alias("stocks"), F.avg("immediate_bps_5s").alias("i5"), F.avg("reversal_share_30s").alias("r30"))
    return d.groupBy("price_tercile", "cap_tercile").agg(
        F.count(F.lit(1)).alias("dates"), F.sum("stocks").alias("stock_days"), F.avg("i5").alias("immediate_bps_5s"), F.avg("r30").alias("reversal_share_30s"))


def date_equal(
    rows: DataFrame, keys: Sequence[str], means: dict[str, str], counts: dict[str, str] | None = None, by: str = "month", errors: dict[str, str] | None = None,
) -> DataFrame:
    """Means over the rows of a date, then over dates, per key and month (and ALL) or exchange.

    ``means``: output -> column; ``counts`` are summed; ``errors`` gives the standard
    error over dates of some output.  A date counts once however many rows it has.
    """
    if by == "exchange":
        rows = rows.withColumn("exchange", F.substring("symbol", 1, 2))
    g = ["exchange", *keys] if by == "exchange" else list(keys)
    d = rows.groupBy("date", *g).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(v).alias(n) for n, v in means.items()], *[F.sum(v).alias(n) for n, v in (counts or {}).items()])
    d = d if by == "exchange" else with_month_and_all(d)
    return d.groupBy(by, *keys).agg(
        F.count(F.lit(1)).alias("dates"), F.sum("_n").alias("stock_days"), *[F.sum(n).alias(n) for n in counts or {}],
        *[F.avg(n).alias(n) for n in means],
        *[(F.stddev_samp(v) / F.sqrt(F.count(F.lit(1)).cast("double"))).alias(n) for n, v in (errors or {}).items()])


# Fixed output names of the depth-bin and grid tables: output -> stock-day column.
BIN_MEANS = {
    "rehit_share": "rehit_share", "restored_share_closed": "restored_share_closed", "trade_removal_share_closed": "trade_removal_share_closed",
    "censored_share": "censored_share", "median_lifetime_seconds": "median_lifetime_closed"}
GRID_MEANS = {
    "thin_share": "new_quote_thin_share_lt_0_5", "rehit_share": "new_quote_rehit_share", "restored_share": "new_quote_restored_share",
    "reversal_30s": "impact_reversal_share_30s", "reversal_60s": "impact_reversal_share_60s",
    "multi_chain_volume_share": "multi_trade_chain_volume_share", "chain_hhi": "chain_volume_hhi"}


def depth_bin_summary(bins: DataFrame, by: str = "month") -> DataFrame:
    """Quote outcomes by relative depth, each date alike; by month with the re-hit error, or by exchange."""
    return date_equal(bins, ["depth_bin"], BIN_MEANS, {"quote_events": "quote_events"}, by, {"rehit_se": "rehit_share"} if by == "month" else None)


def liquidity_grid(enriched: DataFrame, by: str = "month") -> DataFrame:
    """Thin quotes, reversals and chains on the price x cap tercile grid, each date alike."""
    return date_equal(enriched, ["price_tercile", "cap_tercile"], GRID_MEANS, None, by)


def chain_structure(signals: DataFrame, days: DataFrame) -> DataFrame:
    """Chain counts, concentration, fragments and durations: stock-day means by month and over all."""
    j = signals.join(days.drop("chain_volume"), DAY, "left")
    means = {
        "mean_chain_count": "chain_count", "mean_multi_chain_count": "multi_trade_chain_count", "mean_multi_chain_volume_share": "multi_trade_chain_volume_share",
        "mean_chain_volume_hhi": "chain_volume_hhi", "mean_chain_volume_entropy": "chain_volume_entropy",
        "mean_largest_chain_volume_share": "largest_chain_volume_share", "mean_chain_fragments": "mean_fragments",
        "mean_stock_day_p90_fragments": "p90_fragments", "mean_multi_chain_duration_seconds": "mean_multi_duration",
        "mean_stock_day_p90_duration_seconds": "p90_multi_duration", "mean_acceleration_seconds": "mean_acceleration"}
    return with_month_and_all(j).groupBy("month").agg(
        F.count(F.lit(1)).alias("stock_days"), F.count_distinct("date").alias("dates"), *[F.avg(v).alias(n) for n, v in means.items()])


def quality_summary(signals: DataFrame) -> DataFrame:
    """Totals by month and over everything, from grouping sets."""
    s = signals.withColumn("m", F.floor(F.col("date") / 100).cast("string"))
    g = s.rollup("m").agg(
        F.grouping("m").alias("_all"), F.count(F.lit(1)).alias("stock_days"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"),
        F.sum("valid_books").alias("valid_books"), F.sum("invalid_books").alias("invalid_books"), F.sum("chain_count").alias("chains"))
    return g.withColumn("month", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("m"))).drop("m", "_all")


def join_coverage(signals: DataFrame, panel: DataFrame, enriched: DataFrame) -> DataFrame:
    """How many signal rows found a price and a previous cap; duplicate keys."""
    w = Window.partitionBy("symbol").orderBy("date")
    caps = panel.select(*DAY, "close_1000", F.lag("cap").over(w).alias("lag_cap"))
    a = signals.select(*DAY).join(caps, DAY, "left").agg(
        F.count(F.lit(1)).alias("signal_rows"), F.count_distinct("symbol").alias("symbols"), F.count_distinct("date").alias("dates"),
        F.count_distinct(*DAY).alias("_k"), F.count("close_1000").alias("price_covered"), F.count("lag_cap").alias("lag_cap_covered"))
    b = enriched.agg(F.count(F.lit(1)).alias("fully_enriched_rows"))
    return a.join(b).withColumn("duplicate_keys", F.col("signal_rows") - F.col("_k")).drop("_k")


# ---------------------------------------------------------------- order audit

def order_audit(events: DataFrame) -> DataFrame:
    """Lifecycle class and reconstructed quantity of every (side, order)."""
    rows = sessions(events)
    facts = order_facts(rows)
    totals = rows.filter(F.col("source_action").isin("ORDER_ADD") & (F.col("source_volume") > 0)).select(
        *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id"), "source_volume").filter(
        F.col("order_id").isNotNull()).groupBy(*ORDER).agg(F.sum("source_volume").alias("add_qty_total"))
    a, t = F.col("first_add_row"), F.col("first_trade_row")
    cls = (F.when(t.isNull(), "passive_only").when(a.isNull(), "trade_only_active").when(t < a, "posttrade_remainder")
           .when(a < t, "pretrade_active_add").otherwise("same_row_unresolved"))
    late = facts.filter(t < a).select(*ORDER, a.alias("_cut"))
    early = rows.filter((F.col("source_action") == "TRADE")).select(
        *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id"), "row_id", "source_volume").join(late, ORDER).filter(
        F.col("row_id") < F.col("_cut")).groupBy(*ORDER).agg(F.sum("source_volume").alias("immediate_trade_qty"))
    zero = F.lit(0).cast("long")
    j = facts.join(totals, ORDER, "left").join(early, ORDER, "left").withColumns({
        "classification": cls, "add_qty": F.coalesce("add_qty_total", zero), "active_trade_qty": F.coalesce(F.col("exec_qty_day").cast("long"), zero),
        "immediate_trade_qty": F.coalesce("immediate_trade_qty", zero)})
    submit = F.when(F.col("classification") == "posttrade_remainder", F.col("add_qty") + F.col("immediate_trade_qty")).when(
        F.col("classification") == "trade_only_active", F.col("active_trade_qty")).otherwise(F.col("add_qty"))
    return j.select(*ORDER, "classification", "first_add_row", "first_trade_row", "add_qty", "active_trade_qty", "immediate_trade_qty",
                    F.col("add_rows").alias("add_events"), F.col("trade_rows").alias("trade_events"), submit.alias("reconstructed_submit_qty"))


def audit_summary(audit: DataFrame) -> DataFrame:
    """Counts by exchange and class, with conservation violations."""
    over = (F.col("classification") == "pretrade_active_add") & (F.col("active_trade_qty") > F.col("add_qty"))
    return audit.groupBy(F.substring("symbol", 1, 2).alias("exchange"), "classification").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("reconstructed_submit_qty").alias("submitted"), X.count_if(over).alias("over_executed"))


def book_quality(events: DataFrame) -> DataFrame:
    """Missing, locked and crossed books and row-order breaks per stock-day."""
    b, a = X.best("bid"), X.best("ask")
    rows = events.select(*DAY, "row_id", "time", X.book_state(b, a).alias("state"))
    # Row ids order the scan, so a break shows as a clock that runs backwards.
    r = carry_forward(rows, DAY, last={"prev_time": F.col("time")})
    return r.groupBy(*DAY).agg(
        X.count_if(F.col("time") < F.col("prev_time")).alias("clock_breaks"),
        *[X.count_if(F.col("state") == s).alias(f"{s}_books") for s in ("missing", "locked", "crossed", "valid")])


# ---------------------------------------------------------------- sampling

def stratified_symbols(universe: DataFrame, n: int, domains: Sequence[str]) -> DataFrame:
    """Equal quotas per domain, balanced over exchanges, in SHA-256 order.

    STAR domains come from one exchange.  A shortfall on one exchange is filled
    from the rest of the domain.
    """
    base, extra = divmod(n, len(domains))
    quota = F.element_at(F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.lit(base + int(i < extra)))]), F.col("domain"))
    odd = F.conv(F.substring(F.sha2(F.col("domain"), 256), -1, 1), 16, 10).cast("int") % 2 == 0
    u = universe.filter(F.col("domain").isin(list(domains))).select("symbol", "domain", F.substring("symbol", 1, 2).alias("exchange")).withColumns({
        "quota": quota, "h": F.sha2(F.concat_ws("|", "domain", "symbol"), 256),
        "hf": F.sha2(F.concat_ws("|", "domain", F.lit("fill"), "symbol"), 256)})
    sh = F.floor(F.col("quota") / 2) + F.when((F.col("quota") % 2 == 1) & odd, 1).otherwise(0)
    star = F.col("domain").endswith("star")
    target = F.when(star, F.col("quota")).when(F.col("exchange") == "SH", sh).otherwise(F.col("quota") - sh)
    first = position(u, ["domain", "exchange"], [F.col("h"), F.col("symbol")], out="k").withColumn("picked", F.col("k") <= target)
    got = first.groupBy("domain").agg(X.count_if(F.col("picked")).alias("got"))
    rest = position(first.filter(~F.col("picked")), ["domain"], [F.col("hf"), F.col("symbol")], out="r").join(got, "domain").filter(
        F.col("r") <= F.col("quota") - F.col("got"))
    return first.filter("picked").select("domain", "symbol", "exchange").unionByName(rest.select("domain", "symbol", "exchange"))


# ---------------------------------------------------------------- FIFO takes

def _ends(side: str, row: str) -> Column:
    """Where each level's orders end in the flat queue."""
    return F.aggregate(F.col(f"{row}.{side}_cnt"), F.array().cast("array<bigint>"), lambda s, x: F.array_append(
        s, F.coalesce(F.element_at(F.when(F.size(s) > 0, s), -1), F.lit(0).cast("long")) + x))


def _queues(side: str, row: str) -> Column:
    """Per-level order queues of a ladder, cut from the flat queue by the counts.

    The ends stand as an argument, not inside the function of a level, so they are worked out once a ladder.
    """
    px, cnt, flat = F.col(f"{row}.{side}_px"), F.col(f"{row}.{side}_cnt"), F.col(f"{row}.{side}_ordvol")
    return F.zip_with(F.arrays_zip(px.alias("px"), cnt.alias("n")), _ends(side, row), lambda x, end: F.struct(
        x["px"].alias("px"), F.slice(flat, (end - x["n"] + 1).cast("int"), x["n"].cast("int")).alias("q")))


def _total(q: Column) -> Column:
    return F.aggregate(q, F.lit(0).cast("long"), lambda s, x: s + x)


def _with_swept(r: DataFrame, side: str, use: Column) -> DataFrame:
    """Quantity consumed from the front through the old best where ``use`` holds, NULL if it does not fit.

    Each step is a column of its own, as the next one reads it more than once.
    """
    z = F.lit(0).cast("long")
    ob, nb = F.col(f"pre.{side}_px")[0], F.col(f"cur.{side}_px")[0]
    inside = (lambda p: (p >= ob) & (p < nb)) if side == "ask" else (lambda p: (p <= ob) & (p > nb))
    c = lambda n: F.col(f"_{n}")
    at_best = lambda q: F.try_element_at(F.filter(q, lambda l: l["px"] == nb), F.lit(1))["q"]
    r = r.withColumn("_use", use)
    r = r.withColumns({"_old": F.when(c("use"), _queues(side, "pre")), "_new": F.when(c("use"), _queues(side, "cur"))})
    r = r.withColumns({"_gone": F.filter(c("old"), lambda l: inside(l["px"])), "_before": at_best(c("old")), "_after": at_best(c("new"))})
    r = r.withColumns({
        "_still": F.exists(c("gone"), lambda g: F.exists(c("new"), lambda l: l["px"] == g["px"])),
        "_full": F.aggregate(c("gone"), z, lambda s, l: s + _total(l["q"])), "_used": _total(c("before")) - _total(c("after"))})
    before, after, used = c("before"), c("after"), c("used")
    # Front-first consumption leaves a suffix of the old queue whose first order may shrink.
    n, m = F.size(before), F.size(after)
    tail = F.slice(before, F.greatest(n - m + 2, F.lit(1)), F.greatest(m - 1, F.lit(0)))
    kept = F.when(m == 0, F.lit(True)).otherwise(
        (m <= n) & tail.eqNullSafe(F.slice(after, 2, F.greatest(m - 1, F.lit(0))))
        & (F.try_element_at(after, F.lit(1)) <= F.try_element_at(before, F.greatest(n - m + 1, F.lit(1)))))
    part = F.when(before.isNotNull() & after.isNotNull() & (used > 0) & F.coalesce(kept, F.lit(False)), used).otherwise(F.lit(0))
    r = r.withColumn("_sum", F.when((F.size(c("gone")) > 0) & ~c("still"), c("full") + part))
    return r.withColumn(f"_{side}", F.when(c("sum") > 0, c("sum"))).drop(*[f"_{x}" for x in "use old new gone before after still full used sum".split()])


def fifo_active_take(snapshots: DataFrame) -> DataFrame:
    """Mid moves explained by levels consumed from the front of the queue."""
    names = [f"{s}_{k}" for s in ("bid", "ask") for k in ("px", "cnt", "ordvol")]
    rows = snapshots.select(*DAY, "row_id", "time", F.struct(*names, X.in_session().alias("live")).alias("cur"))
    # Each snapshot meets the one before it in one pass over its columns; long days are cut into chunks.
    r = carry_forward(rows, DAY, last={"pre": F.col("cur")}, span=span_of(snapshots.select(*DAY), DAY))
    mid = lambda s: (F.try_element_at(F.col(f"{s}.bid_px"), F.lit(1)) + F.try_element_at(F.col(f"{s}.ask_px"), F.lit(1))) / 2.0
    r = r.filter(F.col("pre").isNotNull()).withColumns({"both": F.col("cur.live") & F.col("pre.live"), "d": mid("cur") - mid("pre")})
    r = r.withColumn("moved", F.coalesce(F.expr("both AND d <> 0"), F.lit(False)))
    a_up = F.col("cur.ask_px")[0] > F.col("pre.ask_px")[0]
    b_dn = F.col("cur.bid_px")[0] < F.col("pre.bid_px")[0]
    up, down = F.col("moved") & (F.col("d") > 0) & a_up, F.col("moved") & (F.col("d") < 0) & b_dn
    r = _with_swept(_with_swept(r, "ask", up), "bid", down)
    taken = F.col("qty").isNotNull()
    t = r.select(*DAY, "both", "moved", "d", F.coalesce("_ask", "_bid").alias("qty")).groupBy(*DAY).agg(
        X.count_if(F.col("both")).alias("transitions"), X.count_if(F.col("moved")).alias("mid_moves"), X.count_if(taken).alias("active_take_events"),
        F.coalesce(F.sum("qty"), F.lit(0)).alias("active_take_qty"),
        *[F.coalesce(X.sum_if(v, cond), F.lit(0.0)).alias(n) for n, v, cond in (
            ("_all", F.abs("d"), F.col("moved")), ("_gap", F.abs("d"), taken), ("_signed", F.col("d"), taken))])
    return t.select(
        *DAY, "transitions", "mid_moves", "active_take_events", "active_take_qty",
        *[(F.col(c) / X.PRICE_SCALE).alias(n) for c, n in (("_gap", "active_take_mid_gap"), ("_signed", "active_take_mid_gap_signed"), ("_all", "all_mid_gap"))],
        F.coalesce(X.ratio("_gap", "_all"), F.lit(0.0)).alias("active_take_share"))
