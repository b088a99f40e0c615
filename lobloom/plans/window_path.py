"""Book and flow paths over the half hour before 10:30, and what follows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.lifecycle import DAY, trades_once
from lobloom.operators.ordered import carry_forward
from lobloom.session import stage

MIN = 60_000
START, SIGNAL = 36_000_000, 37_800_000
# Fixed windows in milliseconds since midnight.
BOOK_WINDOWS = {"book30m": (START, SIGNAL), "book5m": (SIGNAL - 5 * MIN, SIGNAL)} | {
    f"bin{i + 1}_book": (START + i * 5 * MIN, START + (i + 1) * 5 * MIN) for i in range(6)}
FLOW_WINDOWS = {"flow30m": (START, SIGNAL), "flow5m": (SIGNAL - 5 * MIN, SIGNAL), "flow1m": (SIGNAL - MIN, SIGNAL)} | {
    f"bin{i + 1}_flow": (START + i * 5 * MIN, START + (i + 1) * 5 * MIN) for i in range(6)} | {
    f"future{m}m": (SIGNAL, SIGNAL + m * MIN) for m in (1, 5, 10)}
DEPTHS = ("bid1", "bid3", "bid10", "ask1", "ask3", "ask10")


def _imbalance(k: int) -> Column:
    b, a = F.col(f"bid{k}"), F.col(f"ask{k}")
    return F.coalesce(X.ratio(b - a, b + a), F.lit(0.0))


def path_rows(events: DataFrame) -> DataFrame:
    """Morning rows with scalar book columns, the next row's and next valid book's time."""
    am = events.filter(X.in_window(X.AM_OPEN, X.AM_CLOSE))
    cols = {"bid": X.best("bid").cast("double"), "ask": X.best("ask").cast("double")}
    cols |= {f"{s}{k}": X.depth(f"{s}_vol", k).cast("double") for s in ("bid", "ask") for k in (1, 3, 10)}
    flat = am.select(
        *DAY, "row_id", "source_action", "source_side", "source_recid", "source_volume",
        "source_buy_order_id", "source_sell_order_id", "time", X.clock_ms().alias("ms"),
        *[e.alias(n) for n, e in cols.items()])
    has = F.lit(True)
    for d in DEPTHS:
        has = has & F.col(d).isNotNull()
    flat = flat.withColumn("ok", X.book_ok("strict", "bid", "ask") & has)
    return carry_forward(
        flat, DAY, last={"next_ms": F.col("ms"), "next_ok_ms": F.when(F.col("ok"), F.col("ms"))}, backward=True)


def _overlap(windows) -> Column:
    """Named windows that overlap [ms, next valid ms), with the shared seconds."""
    end = F.coalesce("next_ok_ms", F.lit(SIGNAL))
    parts = [
        F.struct(F.lit(n).alias("window"), F.lit((b - a) / 1000.0).alias("length"),
                 ((F.least(end, F.lit(b)) - F.greatest(F.col("ms"), F.lit(a))) / 1000.0).alias("dt"))
        for n, (a, b) in windows.items()]
    return F.filter(F.array(*parts), lambda p: p["dt"] > 0)


def book_path(rows: DataFrame) -> DataFrame:
    """Duration-weighted book measures per stock-day and window (long form)."""
    v = rows.filter("ok").withColumn("_w", F.explode(_overlap(BOOK_WINDOWS))).select(
        *DAY, "bid", "ask", *DEPTHS, "_w.*")
    dt = F.col("dt")
    v = v.withColumns({f"bi{k}": _imbalance(k) for k in (1, 3, 10)} | {
        "spread": (F.col("ask") - F.col("bid")) / ((F.col("bid") + F.col("ask")) / 2.0) * 10000.0})
    total = F.sum(dt)

    def twap(c):
        return F.sum(X.col(c) * dt) / total

    aggs = {"coverage_seconds": total, "coverage_ratio": total / F.max("length")}
    aggs |= {f"bi{k}_twap": twap(f"bi{k}") for k in (1, 3, 10)}
    aggs |= {
        "bi3_time_std": F.sqrt(F.greatest(F.lit(0.0), twap(F.col("bi3") * F.col("bi3")) - twap("bi3") * twap("bi3"))),
        "spread_bps_twap": twap("spread"),
        "positive_time_share": F.sum(F.when(F.col("bi3") > 0, dt).otherwise(0.0)) / total,
        "negative_time_share": F.sum(F.when(F.col("bi3") < 0, dt).otherwise(0.0)) / total,
    } | {f"{d}_twap": twap(d) for d in DEPTHS}
    g = v.groupBy(*DAY, "window").agg(*[e.alias(n) for n, e in aggs.items()])
    c = F.col
    return g.withColumns({
        f"depth{a}_to_depth{b}": F.coalesce(X.ratio(
            c(f"bid{a}_twap") + c(f"ask{a}_twap"), c(f"bid{b}_twap") + c(f"ask{b}_twap")), F.lit(0.0))
        for a, b in ((1, 3), (3, 10))})


def flow_path(rows: DataFrame) -> DataFrame:
    """Aggressive volume and distinct aggressors per stock-day and window (long form)."""
    t = trades_once(rows.select(
        *DAY, "row_id", "source_action", "source_side", "source_recid", "source_volume", "ms",
        X.own_side_id().alias("oid")))
    # A trade without an id counts as its own order.
    t = t.withColumn("oid", F.coalesce("oid", -1 - F.coalesce("source_recid", "row_id")))
    defs = F.array(*[F.struct(F.lit(n).alias("window"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in FLOW_WINDOWS.items()])
    w = t.withColumn("_w", F.explode(F.filter(defs, lambda x: (x["a"] <= F.col("ms")) & (F.col("ms") < x["b"])))).select(
        *DAY, "source_side", "source_volume", "oid", F.col("_w.window").alias("window"))
    # Orders first, then windows: a distinct count without expanding the rows.
    per_order = w.groupBy(*DAY, "window", "source_side", "oid").agg(F.sum("source_volume").alias("v"))
    buy, sell = F.col("source_side") == "B", F.col("source_side") == "S"
    g = per_order.groupBy(*DAY, "window").agg(
        X.sum0("v", buy).alias("buy_volume"), X.sum0("v", sell).alias("sell_volume"),
        X.count_if(buy).alias("buy_order_count"), X.count_if(sell).alias("sell_order_count"))
    return g.withColumns({
        "total_volume": F.col("buy_volume") + F.col("sell_volume"),
        "order_count": F.col("buy_order_count") + F.col("sell_order_count"),
        "net_share": F.coalesce(X.ratio(F.col("buy_volume") - F.col("sell_volume"), F.col("buy_volume") + F.col("sell_volume")), F.lit(0.0))})


def imbalance_runs(rows: DataFrame) -> DataFrame:
    """Longest same-sign stretch of the 3-level imbalance and the number of flips.

    A balanced book neither ends a stretch nor flips the sign.
    """
    end = F.least(F.coalesce("next_ok_ms", F.lit(SIGNAL)), F.lit(SIGNAL))
    begin = F.greatest(F.col("ms"), F.lit(START))
    v = rows.filter("ok").withColumns({"sgn": X.sign(_imbalance(3)), "begin": begin}).filter(
        (end > begin) & (F.col("sgn") != 0)).select(*DAY, "row_id", "sgn", "begin")
    v = carry_forward(v, DAY, last={"prev": F.col("sgn")})
    starts = v.filter(~F.col("sgn").eqNullSafe(F.col("prev")))
    runs = carry_forward(starts, DAY, last={"stop": F.col("begin")}, backward=True).withColumn(
        "seconds", (F.coalesce("stop", F.lit(SIGNAL)) - F.col("begin")) / 1000.0)
    return runs.groupBy(*DAY).agg(
        (F.count(F.lit(1)) - 1).alias("book_sign_flips"),
        F.coalesce(F.max(F.when(F.col("sgn") > 0, F.col("seconds"))), F.lit(0.0)).alias("longest_positive_seconds"),
        F.coalesce(F.max(F.when(F.col("sgn") < 0, F.col("seconds"))), F.lit(0.0)).alias("longest_negative_seconds"))


def _book_at(ms: int, name: str) -> Column:
    state = F.struct("bid", "ask", "bid3", "ask3")
    return F.max_by(state, F.when(F.col("ok") & (F.col("ms") < ms), F.col("row_id"))).alias(name)


def _bi3(s: str) -> Column:
    b, a = F.col(f"{s}.bid3"), F.col(f"{s}.ask3")
    return F.coalesce(X.ratio(b - a, b + a), F.lit(0.0))


def _spread(s: str) -> Column:
    return (F.col(f"{s}.ask") - F.col(f"{s}.bid")) / ((F.col(f"{s}.ask") + F.col(f"{s}.bid")) / 2.0) * 10000.0


def window_path(events: DataFrame) -> DataFrame:
    """One 10:30 row per stock-day: book and flow windows, end point, shifts and labels."""
    rows = stage(path_rows(events), "path-rows")
    c = F.col
    inside = (c("ms") >= START) & (c("ms") < SIGNAL)
    base = rows.groupBy(*DAY).agg(
        _book_at(SIGNAL, "_end"), *[_book_at(SIGNAL + m * MIN, f"_f{m}") for m in (1, 5, 10)],
        *[X.count_if((c("ms") >= SIGNAL) & (c("ms") < SIGNAL + m * MIN)).alias(f"future{m}m_event_count") for m in (1, 5, 10)],
        F.coalesce(F.sum(F.when(inside & ~c("ok"), (F.least(F.coalesce("next_ms", F.lit(SIGNAL)), F.lit(SIGNAL)) - c("ms")) / 1000.0)), F.lit(0.0))
        .alias("invalid_chain_seconds"),
    ).filter(c("_end").isNotNull())
    # Squared log moves of valid mids; the first one starts from the end point.
    later = rows.filter("ok").filter((c("ms") < SIGNAL + 10 * MIN)).select(*DAY, "row_id", "ms", ((c("bid") + c("ask")) / 2.0).alias("mid"))
    moves = carry_forward(later, DAY, last={"prev_mid": c("mid")}).filter(c("ms") >= SIGNAL).withColumn(
        "sq", F.pow(F.ln(c("mid") / c("prev_mid")), 2))
    vol = moves.groupBy(*DAY).agg(*[
        F.sum(F.when(c("ms") < SIGNAL + m * MIN, c("sq"))).alias(f"_v{m}") for m in (1, 5, 10)])
    out = base.join(vol, DAY, "left")
    books, flows = stage(book_path(rows), "book-path"), stage(flow_path(rows), "flow-path")
    for n in ("book30m", "book5m"):
        b = books.filter(c("window") == n).drop("window")
        out = out.join(b.select(*DAY, *[c(x).alias(f"{n}_{x}") for x in b.columns if x not in DAY]), DAY, "left")
    wide = [f for f in flows.columns if f not in (*DAY, "window")]
    fl = flows.groupBy(*DAY).agg(*[
        F.max(F.when(c("window") == n, c(f))).alias(f"{n}_{f}") for n in FLOW_WINDOWS for f in wide])
    bins = books.groupBy(*DAY).agg(*[
        F.max(F.when(c("window") == n, c(f))).alias(f"{n}_{f}")
        for n in BOOK_WINDOWS if n.startswith("bin") for f in ("bi3_twap", "spread_bps_twap", "coverage_ratio")])
    out = out.join(fl, DAY, "left").join(bins, DAY, "left").join(imbalance_runs(rows), DAY, "left")
    zeros = {f"{n}_{f}": F.coalesce(c(f"{n}_{f}"), F.lit(0.0) if f == "net_share" else F.lit(0).cast("long")) for n in FLOW_WINDOWS for f in wide}
    zeros |= {x: F.coalesce(c(x), F.lit(0.0)) for x in bins.columns if x not in DAY}
    zeros |= {f"{n}_{x}": F.coalesce(c(f"{n}_{x}"), F.lit(0.0)) for n in ("book30m", "book5m") for x in books.columns if x not in (*DAY, "window")}
    zeros |= {"book_sign_flips": F.coalesce("book_sign_flips", F.lit(0).cast("long")),
              "longest_positive_seconds": F.coalesce("longest_positive_seconds", F.lit(0.0)),
              "longest_negative_seconds": F.coalesce("longest_negative_seconds", F.lit(0.0))}
    out = out.withColumns(zeros)
    tail = {"endpoint_bi3": _bi3("_end"), "endpoint_spread_bps": _spread("_end"),
            "endpoint_bid_depth3": c("_end.bid3"), "endpoint_ask_depth3": c("_end.ask3"), "signal_time": F.lit(1030)}
    for m in (1, 5, 10):
        tail |= {f"future{m}m_end_bi3": _bi3(f"_f{m}"), f"future{m}m_end_spread_bps": _spread(f"_f{m}"),
                 f"future{m}m_realized_vol_bps": F.sqrt(F.coalesce(c(f"_v{m}"), F.lit(0.0))) * 10000.0}
    out = out.withColumns(tail).drop("_end", *[f"_{k}{m}" for k in "fv" for m in (1, 5, 10)])
    return out.withColumns({
        "book_shift_5m_minus_30m": c("book5m_bi3_twap") - c("book30m_bi3_twap"),
        "flow_shift_5m_minus_30m": c("flow5m_net_share") - c("flow30m_net_share"),
        "endpoint_minus_book5m": c("endpoint_bi3") - c("book5m_bi3_twap")})


def full_coverage(paths: DataFrame, windows: Sequence[str] = ("book30m", "book5m"), least: float = 0.999999) -> DataFrame:
    """Paths whose book was valid over (all but rounding of) each of ``windows``; a missing ratio does not pass."""
    return paths.filter(reduce(and_, [F.col(f"{w}_coverage_ratio") >= least for w in windows]))


def quality_report(paths: DataFrame) -> DataFrame:
    """Output checks in one pass: keys, coverage bounds and nested windows."""
    c = F.col
    # Each side must nest by itself: a surplus on one would hide a gap on the other.
    grows = lambda names: reduce(or_, [c(a) > c(b) for a, b in zip(names, names[1:])])
    nest = reduce(or_, [grows([f"flow{m}m_{s}_volume" for m in (1, 5, 30)]) for s in ("buy", "sell")])
    fut = reduce(or_, [grows([f"future{m}m_{s}" for m in (1, 5, 10)]) for s in ("buy_volume", "sell_volume", "event_count")])
    cover = lambda p: (c(f"{p}_coverage_ratio") < 0) | (c(f"{p}_coverage_ratio") > 1.000001)
    keys = paths.groupBy(*DAY, "signal_time").agg(F.count(F.lit(1)).alias("k")).agg(F.sum(c("k") - 1).alias("duplicate_keys"))
    return paths.agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("symbol").alias("symbols"),
        F.count_distinct("date").alias("dates"), F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        X.count_if(c("signal_time") != 1030).alias("bad_signal_time"),
        X.count_if(cover("book30m") | cover("book5m")).alias("bad_coverage"),
        X.count_if((c("invalid_chain_seconds") < 0) | (c("invalid_chain_seconds") > 1800.001)).alias("bad_invalid_seconds"),
        X.count_if(nest).alias("bad_signal_nesting"), X.count_if(fut).alias("bad_target_nesting"),
        X.count_if(c("symbol").startswith("SH")).alias("sh_rows"), X.count_if(c("symbol").startswith("SZ")).alias("sz_rows"),
        X.count_if(c("book5m_coverage_ratio") < 0.999999).alias("incomplete_5m_coverage"),
        X.count_if(c("book30m_coverage_ratio") < 0.999999).alias("incomplete_30m_coverage"),
    ).join(keys)
