"""Order and trade lifecycles inside a stock-day.

Order identity is (side, order id); trades are de-duplicated by record id.  All
"first" rows come from combinable aggregates and every join has one row per key
on one side, so a hot order or a hot stock-day stays splittable.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.ordered import SESSION, SPAN, carry_forward, first_per_key

DAY = ["symbol", "date"]
ORDER = ["symbol", "date", "side", "order_id"]


def explode_windows(df: DataFrame, windows: Mapping[str, tuple[int, int]], time="time") -> DataFrame:
    """One copy of each row per named clock window that contains it (no join)."""
    defs = F.array(*[
        F.struct(F.lit(n).alias("window_name"), F.lit(a).alias("window_start"), F.lit(b).alias("window_end"))
        for n, (a, b) in windows.items()
    ])
    t = X.col(time)
    inside = F.filter(defs, lambda w: (w["window_start"] <= t) & (t < w["window_end"]))
    return df.withColumn("_w", F.explode(inside)).select(*df.columns, "_w.*")


def explode_values(df: DataFrame, values: Sequence, name: str) -> DataFrame:
    """Cross with a short literal list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def trades_once(events: DataFrame, known_side: bool = True) -> DataFrame:
    """Positive-volume trades, first row per (symbol, date, record id)."""
    t = events.filter((F.col("source_action") == "TRADE") & (F.col("source_volume") > 0))
    if known_side:
        t = t.filter(F.col("source_side").isin("B", "S"))
    t = t.withColumn("_alone", F.when(F.col("source_recid").isNull(), F.col("row_id")))
    payload = [c for c in events.columns if c not in (*DAY, "source_recid", "row_id")]
    return first_per_key(t, [*DAY, "source_recid", "_alone"], "row_id", payload).drop("_alone")


def prebook(
    events: DataFrame, mode: str = "strict", keys: Sequence[str] = SESSION,
    span: int | None = SPAN,
) -> DataFrame:
    """Add ``pre`` = (bid, ask, mid, row) of the last valid book strictly before."""
    b, a = X.best("bid").cast("double"), X.best("ask").cast("double")
    book = F.when(
        X.book_ok(mode),
        F.struct(b.alias("bid"), a.alias("ask"), ((b + a) / 2.0).alias("mid"), F.col("row_id")),
    )
    return carry_forward(events.withColumn("book", book), keys, last={"pre": F.col("book")}, span=span)


def previous_row_book(events: DataFrame, keys: Sequence[str] = SESSION, span: int | None = SPAN) -> DataFrame:
    """Add ``pre`` = best prices of the previous row, whatever their validity."""
    b, a = X.best("bid").cast("double"), X.best("ask").cast("double")
    here = F.struct(b.alias("bid"), a.alias("ask"), ((b + a) / 2.0).alias("mid"))
    return carry_forward(events.withColumn("book", here), keys, last={"pre": F.col("book")}, span=span)


def entry_gaps(events_with_pre: DataFrame) -> DataFrame:
    """First placement of each resting order and its distance behind the touch."""
    buy = F.col("source_side") == "B"
    gap = F.when(buy & (F.col("pre.bid") > 0), F.col("pre.bid") - F.col("source_price")).when(
        (F.col("source_side") == "S") & (F.col("pre.ask") > 0),
        F.col("source_price") - F.col("pre.ask"),
    )
    adds = events_with_pre.filter(
        (F.col("source_action") == "ORDER_ADD") & (F.col("source_price") > 0)
        & F.col("source_side").isin("B", "S")
    ).select(
        *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id"),
        "row_id", gap.alias("initial_gap"),
    ).filter(F.col("order_id").isNotNull())
    return first_per_key(adds, ORDER, "row_id", ["initial_gap"]).withColumnRenamed(
        "row_id", "entry_row_id"
    )


def match_passive(trades: DataFrame, entries: DataFrame) -> DataFrame:
    """Left join each trade to the resting order it hit, if placed before it."""
    t = trades.withColumns({"side": X.opposite(), "order_id": X.other_side_id()})
    e = entries.withColumn("_hit", F.lit(True))
    joined = t.join(e, ORDER, "left")
    ok = F.coalesce(F.col("_hit") & (F.col("entry_row_id") < F.col("row_id")), F.lit(False))
    return joined.withColumns({
        "is_matched": ok, "initial_gap": F.when(ok, F.col("initial_gap"))
    }).drop("_hit", "side", "order_id", "entry_row_id")


def aggressor_ids(trades: DataFrame) -> DataFrame:
    """Distinct (symbol, date, side, order id) that ever traded as aggressor."""
    return trades.select(
        *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id")
    ).filter(F.col("order_id").isNotNull()).distinct()


def order_facts(events: DataFrame, windows: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row per (side, order): add and execution facts from a single grouping.

    Adds and trades meet in one conditional aggregate, which replaces a full
    outer join of two groupings.
    """
    own = events.filter(
        F.col("source_action").isin("ORDER_ADD", "TRADE") & (F.col("source_volume") > 0)
        & F.col("source_side").isin("B", "S")
    ).select(
        *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id"), "time",
        "row_id", "source_action", F.col("source_volume").cast("double").alias("qty"),
        (F.col("source_price").cast("double") * F.col("source_volume") / 10000.0).alias("notional"),
    ).filter(F.col("order_id").isNotNull())
    add, trade = F.col("source_action") == "ORDER_ADD", F.col("source_action") == "TRADE"
    aggs = {
        "add_qty": F.min_by(F.when(add, F.col("qty")), F.when(add, F.col("row_id"))),
        "first_add_row": F.min(F.when(add, F.col("row_id"))),
        "add_rows": X.count_if(add),
        "exec_qty_day": X.sum_if("qty", trade),
        "trade_rows": X.count_if(trade),
        "first_trade_row": F.min(F.when(trade, F.col("row_id"))),
    }
    for n, (a, b) in (windows or {}).items():
        hit = trade & X.in_window(a, b)
        aggs[f"exec_qty_{n}"] = X.sum_if("qty", hit)
        aggs[f"exec_notional_{n}"] = X.sum_if("notional", hit)
    return own.groupBy(*ORDER).agg(*[a.alias(n) for n, a in aggs.items()])


def reconstruct_orders(
    events: DataFrame, windows: Mapping[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Submitted quantity per order under both publication orders.

    Add first: the add quantity.  Trades first: executions before the first add
    plus the published remainder.  No add: everything executed.
    """
    facts = order_facts(events, windows)
    late = facts.filter(F.col("first_add_row") > F.col("first_trade_row")).select(
        *ORDER, F.col("first_add_row").alias("_cut")
    )
    early = (
        events.filter((F.col("source_action") == "TRADE") & (F.col("source_volume") > 0))
        .select(
            *DAY, F.col("source_side").alias("side"), X.own_side_id().alias("order_id"),
            "row_id", F.col("source_volume").cast("double").alias("qty"),
        )
        .join(late, ORDER)
        .filter(F.col("row_id") < F.col("_cut"))
        .groupBy(*ORDER).agg(F.sum("qty").alias("pre_add_exec_qty"))
    )
    o = facts.join(early, ORDER, "left")
    active = F.col("trade_rows") > 0
    original = (
        F.when(~active, F.col("add_qty"))
        .when(F.col("add_rows") == 0, F.col("exec_qty_day"))
        .when(F.col("first_add_row") < F.col("first_trade_row"), F.col("add_qty"))
        .otherwise(F.coalesce(F.col("pre_add_exec_qty"), F.lit(0.0)) + F.col("add_qty"))
    )
    return o.withColumns({
        "original_qty": original,
        "is_active": active,
        "trade_before_add": F.coalesce(F.col("first_trade_row") < F.col("first_add_row"), F.lit(False)),
    }).filter(F.col("original_qty") > 0)


def islands(
    events: DataFrame, is_member: Column, same: Sequence[Column], keys: Sequence[str] = SESSION,
    out: str = "island", span: int | None = SPAN, order: str = "row_id",
) -> DataFrame:
    """Running id of runs of consecutive member rows with equal ``same`` values.

    Any other row, or a change of value, starts a new run.  Non-members get NULL.
    """
    tagged = events.withColumn("_me", F.struct(is_member.alias("m"), *[c.alias(f"v{i}") for i, c in enumerate(same)]))
    prev = carry_forward(tagged, keys, order, last={"_prev": F.col("_me")}, span=span)
    starts = F.col("_me.m") & ~F.coalesce(F.col("_prev.m") & F.col("_me").eqNullSafe(F.col("_prev")), F.lit(False))
    numbered = carry_forward(
        prev.withColumn("_start", starts.cast("long")), keys, order,
        sums={out: F.col("_start")}, inclusive=True, span=span,
    )
    return numbered.withColumn(out, F.when(F.col("_me.m"), F.col(out))).drop("_me", "_prev", "_start")


def calendar(df: DataFrame, date: str = "date", out: str = "day_seq") -> DataFrame:
    """Distinct trading dates with their index; bounded by the calendar itself."""
    days = df.select(date).filter(F.col(date).isNotNull()).distinct()
    return days.withColumn(out, F.row_number().over(Window.orderBy(date)).cast("long"))
