"""Order-flow mechanisms: intensity states and what follows trades, depth and orders.

Results are sufficient statistics per (symbol, date, mechanism, variant, group):
count, weighted sum, weighted sum of squares and weight, which add up freely.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.asof import TIME_SPAN, asof
from lobloom.operators.crosssection import exact_quantiles
from lobloom.operators.decay import NEAR, decayed_sums_few, decayed_sums_near
from lobloom.operators.lifecycle import DAY, ORDER, islands
from lobloom.operators.ordered import SESSION, SPAN, carry_forward, dense_order, first_per_key, flag_first, rolling_dense, shift_dense, span_of
from lobloom.plans.evaluation import confidence
from lobloom.session import shuffle_tasks, stage
from lobloom.sources.derived import sessions

S = list(SESSION)
SIDES = ("B", "S")
# Horizons in events, half-lives in seconds and in trades.
HORIZONS = (5, 10, 20, 50)
HALF_LIVES = (1, 5, 30)
TRADE_HALF_LIVES = (5, 20, 50)
PRICE_WINDOWS = (10, 30, 60)
KEEP = 500
STRIDE = 10
SLOTS = 12
NEAR_MID_BPS = 10.0
NEAR_BPS = 10.0


def bounds(rows: DataFrame, trade: Column) -> tuple[bool, bool]:
    """Whether no symbol has more than ``SPAN`` rows, and no session more than ``NEAR`` trades."""
    days = rows.groupBy(*S).agg(F.count(F.lit(1)).alias("_n"), X.count_if(trade).alias("_t"))
    most = days.groupBy("symbol").agg(F.sum("_n").alias("_n"), F.max("_t").alias("_t")).agg(F.max("_n"), F.max("_t")).first()
    return (most[0] or 0) <= SPAN, (most[1] or 0) <= NEAR


def base_rows(events: DataFrame, strict: bool = False, small: bool | None = None) -> DataFrame:
    """Session rows: position, trade validity, scalar book and the last valid book before.

    ``small`` says that no symbol has more than ``SPAN`` rows (counted if not given): rows are then dealt by
    symbol once, and all that follows are plain windows without a further shuffle.
    """
    e = sessions(events)
    if small is None:
        small = span_of(e, ["symbol"]) is None
    flat = e.select(
        *S, "row_id", "time", X.clock_ms().alias("ms"), "source_action", "source_side", "source_recid", "source_price",
        "source_volume", X.own_side_id().alias("oid"), X.other_side_id().alias("pid"),
        X.best("bid").alias("bid"), X.best("ask").alias("ask"),
        *[X.depth(f"{s}_vol", k).alias(f"{s}{k}") for s in ("bid", "ask") for k in (1, 3, 10)])
    ok = X.book_ok("strict" if strict else "locked_ok", "bid", "ask")
    book = F.when(ok, F.struct("bid", "ask", *[f"{s}{k}" for s in ("bid", "ask") for k in (1, 3, 10)]))
    trade = (F.col("source_action") == "TRADE") & F.col("source_side").isin(*SIDES) & (F.col("source_volume") > 0)
    rows = flat.withColumns({
        "book": book, "mid": F.when(ok, (F.col("bid") + F.col("ask")) / 2.0), "_rec": F.when(trade, F.col("source_recid"))}).drop(
        "bid", "ask", *[f"{s}{k}" for s in ("bid", "ask") for k in (1, 3, 10)])
    if small:
        first = F.row_number().over(Window.partitionBy(*DAY, "_rec").orderBy("row_id")) == 1
        rows = rows.repartition(shuffle_tasks(rows), "symbol").withColumn("_one", F.col("_rec").isNull() | first)
    else:
        rows = flag_first(rows, [*DAY, "_rec"], out="_one")
    rows = rows.withColumn("is_trade", F.coalesce(trade & F.col("_one"), F.lit(False))).drop("_rec", "_one")
    span = None if small else span_of(e)
    return dense_order(carry_forward(rows, S, last={"pre": F.col("book")}, span=span).drop("book"), S, span=span)


def _vol(side: str) -> Column:
    return F.when(F.col("is_trade") & (F.col("source_side") == side), F.col("source_volume"))


def own_trade_mean(rows: DataFrame, keep: int = KEEP, span: int | None = SPAN) -> DataFrame:
    """Mean size of the last ``keep`` own-side trades before each row, across days.

    Ordered by (day, row id) as one number per symbol; nothing resets overnight.
    Row ids of a day must stay below 10^12; a larger one is an error.
    """
    day = F.unix_date(F.to_date(F.col("date").cast("string"), "yyyyMMdd")).cast("long")
    row = F.when(F.col("row_id") < F.lit(10**12), F.col("row_id")).otherwise(
        F.raise_error(F.lit("row id of 10^12 or more")).cast("long"))
    line = rows.withColumn("gid", day * F.lit(10**12) + row)
    t = dense_order(line.filter("is_trade").select("symbol", "source_side", "gid", "source_volume"),
                    ["symbol", "source_side"], "gid", out="k", span=span)
    t = rolling_dense(t, ["symbol", "source_side"], "k", keep, {"m": F.avg("source_volume")}, inclusive=True)
    joined = line.join(t.select("symbol", "gid", "m"), ["symbol", "gid"], "left")
    return carry_forward(joined, ["symbol"], "gid", last={
        f"mean_{s}": F.when(F.col("source_side") == s, F.col("m")) for s in SIDES}, span=span).drop("gid", "m")


def _small_means(rows: DataFrame, keep: int) -> DataFrame:
    """Trade numbers and :func:`own_trade_mean` by plain windows, on rows dealt by symbol."""
    c = F.col
    own = Window.partitionBy("symbol", "is_trade", "source_side").orderBy("date", "row_id")
    r = rows.withColumns({"_sum": F.sum("source_volume").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(own)})
    last = (c("_sum") - F.coalesce(F.lag("_sum", keep).over(own), F.lit(0))).cast("double")
    r = r.withColumn("_m", F.when(c("is_trade"), last / F.least(c("_k"), F.lit(keep))))
    before = Window.partitionBy("symbol").orderBy("date", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumns({f"mean_{s}": F.last(F.when(c("source_side") == s, c("_m")), ignorenulls=True).over(before) for s in SIDES})
    return carry_forward(r.drop("_sum", "_k", "_m"), S, sums={"trade_no": c("is_trade").cast("long")}, inclusive=True, span=None)


def intensities(
    rows: DataFrame, half_lives: Sequence[int] = (5,), trade_half_lives: Sequence[int] = (20,), keep: int = KEEP,
    counted: tuple[bool, bool] | None = None,
) -> DataFrame:
    """Decayed buy and sell volume over the mean own trade size, on both clocks.

    ``counted``: the :func:`bounds` where known; small symbols are then dealt already (:func:`base_rows`).
    """
    if counted is None:
        counted = bounds(rows, F.col("is_trade"))
        if counted[0]:
            rows = rows.repartition(shuffle_tasks(rows), "symbol")
    small, few = counted
    if small:
        r = _small_means(rows, keep)
    else:
        r = carry_forward(rows, S, sums={"trade_no": F.col("is_trade").cast("long")}, inclusive=True, span=span_of(rows))
        r = stage(own_trade_mean(r, keep, SPAN), "mech-means")
    decays = {f"hl{h}": ("ms", h * 1000.0, 60_000) for h in half_lives} | {f"teh{h}": ("trade_no", float(h), 200) for h in trade_half_lives}
    if decays and small and few:
        r = decayed_sums_few(r, S, "row_id", F.col("is_trade"), {s: F.col("source_side") == s for s in SIDES}, "source_volume", {n: d[:2] for n, d in decays.items()})
    elif decays:
        r = decayed_sums_near(stage(r, "mech-means") if small else r, S, "trade_no", F.col("is_trade"), {s: F.col("source_side") == s for s in SIDES}, "source_volume", decays)
    names = [(f"hl{h}", s) for h in half_lives for s in SIDES] + [(f"teh{h}", s) for h in trade_half_lives for s in SIDES]
    r = r.withColumns(
        {f"{n}_{s}": F.when(F.col(f"mean_{s}") > 0, F.col(f"{n}_{s}") / F.col(f"mean_{s}")) for n, s in names}
        | {"bucket": X.half_hour_bucket()})
    return stage(r, "mech-intensities") if decays or small else r


def state_cuts(rows: DataFrame, profiles: Sequence[str], warmup_until: int, quantile: float = 0.5, minimum: int = 1, small: bool = False) -> DataFrame:
    """Warm-up quantile per symbol and half hour from every tenth event.

    ``small``: no symbol has more than ``SPAN`` rows.
    """
    sample = rows.filter((F.col("date") < warmup_until) & ((F.col("seq") - 1) % STRIDE == 0))
    items = F.explode(F.array(*[
        F.struct(F.lit(f"{p}_{s}").alias("name"), F.col(f"{p}_{s}").alias("v")) for p in profiles for s in SIDES]))
    long = sample.withColumn("_i", items).select("symbol", "bucket", "_i.*").filter(F.col("v").isNotNull())
    key = ["symbol", "bucket", "name"]
    if small:
        known = long.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key))).filter(F.col("n") >= minimum)
        cuts = exact_quantiles(known, key, "v", {"cut": quantile}, whole=True)
    else:
        long = stage(long, "mech-sample")
        q = exact_quantiles(long, key, "v", {"cut": quantile})
        n = long.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= minimum)
        cuts = q.join(n, key)
    return cuts.groupBy("symbol", "bucket").agg(*[
        F.max(F.when(F.col("name") == f"{p}_{s}", F.col("cut"))).alias(f"cut_{p}_{s}") for p in profiles for s in SIDES])


def with_states(rows: DataFrame, cuts: DataFrame, profiles: Sequence[str], warmup_until: int) -> DataFrame:
    """States B{0,1}S{0,1} on the days after warm-up; NULL without history."""
    j = rows.filter(F.col("date") >= warmup_until).join(cuts, ["symbol", "bucket"], "left")
    out = {}
    for p in profiles:
        hi = {s: F.col(f"{p}_{s}") > F.col(f"cut_{p}_{s}") for s in SIDES}
        out[f"state_{p}"] = F.concat(
            F.lit("B"), hi["B"].cast("int").cast("string"), F.lit("S"), hi["S"].cast("int").cast("string"))
    return j.withColumns(out).drop(*[c for c in cuts.columns if c.startswith("cut_")])


def price_states(rows: DataFrame, warmup_until: int, window_s: int = 30, k: float = 1.5, minimum: int = 1) -> DataFrame:
    """Up / down / normal / unknown: log return against ``k`` warm-up deviations,
    and the mid against the day's open and the previous close.  A deviation from
    fewer than ``minimum`` warm-up samples is unknown."""
    c = F.col
    valid = rows.filter(c("mid").isNotNull() & (c("mid") > 0))
    if span_of(rows) is None:
        # The latest row up to the earlier time is the largest (time, row id) of a range frame.
        until = Window.partitionBy(*S).orderBy("ms").rangeBetween(Window.unboundedPreceding, -window_s * 1000)
        back = valid.select(*S, "row_id", "bucket", "seq", "mid", "ms").withColumn("old", F.max(F.struct("ms", "row_id", "mid")).over(until)["mid"]).drop("ms")
    else:
        probes = valid.select(*S, "row_id", "bucket", "seq", "mid", (c("ms") - window_s * 1000).alias("back"))
        back = asof(probes, valid, S, "back", "ms", {"old": c("mid")}, direction="backward", span=TIME_SPAN)
    back = back.withColumn("ret", F.ln(c("mid") / c("old")))
    back = stage(back, "mech-return")
    sig = back.filter((c("date") < warmup_until) & ((c("seq") - 1) % STRIDE == 0) & c("ret").isNotNull()).groupBy("symbol", "bucket").agg(
        F.when(F.count("ret") >= minimum, F.stddev_pop("ret")).alias("sigma"))
    days = rows.groupBy(*DAY).agg(
        F.min_by("mid", F.when(c("mid").isNotNull(), c("row_id"))).alias("open_mid"),
        F.max_by("mid", F.when(c("mid").isNotNull(), c("row_id"))).alias("last_mid"))
    w = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("prev_close", F.last("last_mid", ignorenulls=True).over(w)).drop("last_mid")
    s = back.filter(c("date") >= warmup_until).join(sig, ["symbol", "bucket"], "left").join(days, DAY)
    cut = F.lit(k) * c("sigma")
    known = c("ret").isNotNull() & (c("sigma") > 0) & c("prev_close").isNotNull()
    state = F.when(~F.coalesce(known, F.lit(False)), "unknown").when(
        (c("ret") > cut) & (c("mid") > c("open_mid")) & (c("mid") > c("prev_close")), "up").when(
        (c("ret") < -cut) & (c("mid") < c("open_mid")) & (c("mid") < c("prev_close")), "down").otherwise("normal")
    return s.select(*S, "row_id", state.alias("price_state"))


def price_window_states(
    rows: DataFrame, warmup_until: int, windows: Sequence[int] = PRICE_WINDOWS, k: float = 1.5, minimum: int = 1,
) -> dict[str, DataFrame]:
    """Price states of several return windows, by name (window and deviations)."""
    return {f"w{w}_k{k:g}": price_states(rows, warmup_until, w, k, minimum) for w in windows}


def moments(df: DataFrame, value: str = "value", keys: Sequence[str] = ("symbol", "date", "mechanism", "variant", "group_key"), weight: Column | None = None) -> DataFrame:
    """Sufficient statistics of finite values with positive weights."""
    v = F.col(value)
    w = F.lit(1.0) if weight is None else weight
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (w > 0)
    return df.filter(ok).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("observations"), F.sum(v * w).alias("value_sum"),
        F.sum(v * v * w).alias("value_sq_sum"), F.sum(w).alias("weight_sum"))


class Stat(NamedTuple):
    """A value whose moments are kept by group, on the rows where ``cond`` holds."""

    mechanism: str
    variant: str
    group: Column | str
    value: Column
    cond: Column | None = None


def _stat_moments(df: DataFrame, stats: Sequence[Stat], span: int | None = SPAN, lead: Column | None = None) -> DataFrame:
    """Moments of many statistics per stock-day: a row of ``df`` is dealt once to each group, not to each statistic.

    Statistics that share a group column stand side by side, ``SLOTS`` to a row, and become rows of their own
    only when they are summed.  Where stock-days are small (no ``span``), their rows are gathered before that.
    ``lead`` is put before the variants.
    """
    groups: dict[object, tuple[Column | str, list[Stat]]] = {}
    values: dict[tuple[int, int], tuple[str, Column]] = {}
    for t in stats:
        groups.setdefault(t.group if isinstance(t.group, str) else id(t.group), (t.group, []))[1].append(t)
        v = t.value.cast("double") if t.cond is None else F.when(t.cond, t.value.cast("double"))
        values.setdefault((id(t.value), id(t.cond)), (f"_v{len(values)}", v))
    keys = [*DAY] if lead is None else [*DAY, "_lead"]
    named = [(F.lit(g) if isinstance(g, str) else g).alias(f"_g{i}") for i, (g, _) in enumerate(groups.values())]
    rows = df.select(*DAY, *([] if lead is None else [lead.alias("_lead")]), *named, *[v.alias(n) for n, v in values.values()])
    if span is None:
        rows = rows.repartition(*DAY)
    rows = rows.withColumns({n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.col(n)) for n, _ in values.values()})
    parts = [(f"_g{i}", of[at : at + SLOTS]) for i, (_, of) in enumerate(groups.values()) for at in range(0, len(of), SLOTS)]
    width = max(len(of) for _, of in parts)
    dealt = F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col(g).alias("group_key"), *[
            (F.col(values[id(of[j].value), id(of[j].cond)][0]) if j < len(of) else F.lit(None).cast("double")).alias(f"x{j}") for j in range(width)])
        for i, (g, of) in enumerate(parts)]))
    long = rows.select(*keys, dealt.alias("_p")).select(*keys, "_p.*").filter(F.coalesce(*[f"x{j}" for j in range(width)]).isNotNull())
    sums = long.groupBy(*keys, "part", "group_key").agg(*[
        a for j in range(width) for x in [F.col(f"x{j}")] for a in (F.count(x).alias(f"n{j}"), F.sum(x).alias(f"s{j}"), F.sum(x * x).alias(f"q{j}"))])
    names = F.array(*[
        F.array(*[F.struct(F.lit(t.mechanism).alias("mechanism"), F.lit(t.variant).alias("variant")) for t in [*of, *of[:1] * (width - len(of))]])
        for _, of in parts])
    each = F.explode(F.array(*[
        F.struct(F.lit(j).alias("slot"), F.col(f"n{j}").alias("n"), F.col(f"s{j}").alias("s"), F.col(f"q{j}").alias("q")) for j in range(width)]))
    name = F.element_at(F.element_at(names, F.col("part") + 1), F.col("_e.slot") + 1)
    out = sums.select(*keys, "part", "group_key", each.alias("_e")).filter("_e.n > 0").withColumn("_n", name)
    variant = F.col("_n.variant") if lead is None else F.concat("_lead", "_n.variant")
    return out.select(
        *DAY, F.col("_n.mechanism").alias("mechanism"), variant.alias("variant"), "group_key", F.col("_e.n").alias("observations"),
        F.col("_e.s").alias("value_sum"), F.col("_e.q").alias("value_sq_sum"), F.col("_e.n").cast("double").alias("weight_sum"))


def trigger_labels(
    states: DataFrame, prices: DataFrame, profile: str = "hl5", horizons: Sequence[int] = HORIZONS, prefix: str = "",
    trade_profile: str | None = None, price_windows: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """Future signed volume, count and heat change k events after a trade, by state.

    A label that would pass the session end is dropped (its lead is NULL).
    ``trade_profile`` adds the labels by the state of the trade clock, for triggers
    with a state on both clocks; ``price_windows`` adds heat changes by further
    price states, each under the name of its window.
    """
    c = F.col
    heat = c(f"{profile}_B") + c(f"{profile}_S")
    second = c(f"{trade_profile}_B") + c(f"{trade_profile}_S") if trade_profile else F.lit(None).cast("double")
    span = span_of(states)
    run = carry_forward(states.withColumns({"heat": heat, "trade_heat": second}), S, inclusive=True, span=span, sums={
        "cb": F.coalesce(_vol("B"), F.lit(0)), "cs": F.coalesce(_vol("S"), F.lit(0)),
        "nb": _vol("B").isNotNull().cast("long"), "ns": _vol("S").isNotNull().cast("long")})
    now = F.struct("cb", "cs", "nb", "ns", "heat", "trade_heat")
    ahead = shift_dense(run.withColumn("now", now), S, "seq", {f"f{h}": (c("now"), h) for h in horizons}, span=span)
    trig = ahead.filter(c("is_trade") & c(f"state_{profile}").isNotNull()).join(prices, [*S, "row_id"], "left").withColumn(
        "price_state", F.coalesce("price_state", F.lit("unknown")))
    for i, table in enumerate((price_windows or {}).values()):
        trig = trig.join(table.select(*S, "row_id", c("price_state").alias(f"_price{i}")), [*S, "row_id"], "left")
    sgn = F.when(c("source_side") == "B", 1.0).otherwise(-1.0)
    side, st, pr = c("source_side"), c(f"state_{profile}"), c("price_state")
    g1 = F.concat(F.lit("trigger="), side, F.lit("|state="), st)
    g2 = F.concat(F.lit("price="), pr, F.lit("|"), g1)
    up_buy = F.when(pr == "up", "buy_up").otherwise("buy_non_up")
    by_window = {n: F.concat(F.lit("price="), F.coalesce(f"_price{i}", F.lit("unknown")), F.lit("|"), g1) for i, n in enumerate(price_windows or {})}
    if trade_profile:
        tst = c(f"state_{trade_profile}")
        t1 = F.concat(F.lit("trigger="), side, F.lit("|state="), tst)
        t2 = F.concat(F.lit("price="), pr, F.lit("|"), t1)
    stats = []
    for h in horizons:
        f = c(f"f{h}")
        has = f.isNotNull()
        volume = sgn * ((f["cb"] - c("cb")) - (f["cs"] - c("cs")))
        count = sgn * ((f["nb"] - c("nb")) - (f["ns"] - c("ns")))
        d = f["heat"] - c("heat")
        hot = has & d.isNotNull()
        stats += [
            Stat("M1", f"{prefix}n{h}_future_signed_volume", g1, volume, has),
            Stat("M1", f"{prefix}n{h}_future_signed_count", g1, count, has),
            Stat("M2", f"{prefix}n{h}_delta_heat", g2, d, hot),
            Stat("M3", f"{prefix}n{h}_positive_heat", "all", F.greatest(d, F.lit(0.0)), hot),
            Stat("M3", f"{prefix}n{h}_positive_heat", "up_buy", F.greatest(d, F.lit(0.0)), hot & (pr == "up") & (side == "B")),
            Stat("M3", f"{prefix}n{h}_delta_heat", up_buy, d, hot & (side == "B"))]
        stats += [Stat("M2", f"{prefix}{name}_n{h}_delta_heat", g, d, hot) for name, g in by_window.items()]
        if trade_profile:
            td = f["trade_heat"] - c("trade_heat")
            on, thot = has & tst.isNotNull(), has & tst.isNotNull() & td.isNotNull()
            stats += [
                Stat("M1", f"{trade_profile}_n{h}_future_signed_volume", t1, volume, on),
                Stat("M1", f"{trade_profile}_n{h}_future_signed_count", t1, count, on),
                Stat("M2", f"{trade_profile}_n{h}_delta_heat", t2, td, thot),
                Stat("M3", f"{trade_profile}_n{h}_delta_heat", up_buy, td, thot & (side == "B"))]
    return _stat_moments(trig, stats, span)


def depth_stats(
    states: DataFrame, profiles: Sequence[str], primary: str, heat_cut: DataFrame, trade_profile: str | None = None,
) -> DataFrame:
    """Log depth before every tenth event by state, and daily means split by daily heat.

    ``trade_profile`` adds the daily means by the state of the trade clock.
    """
    c = F.col
    sample = states.filter(((c("seq") - 1) % STRIDE == 0) & c("pre").isNotNull())
    by_state = {p: F.concat(F.lit("state="), c(f"state_{p}")) for p in profiles}
    stats = [
        Stat("M4", f"{p}_log_depth{k}_{s}", by_state[p], F.log1p(c(f"pre.{s}{k}")),
              c(f"state_{p}").isNotNull() & c(f"pre.{s}{k}").isNotNull())
        for p in profiles for k in (1, 3, 10) for s in ("bid", "ask")]
    m4 = _stat_moments(sample, stats, span_of(states, DAY))
    total = c("pre.bid3") + c("pre.ask3")
    kinds = [(c(f"state_{primary}"), "mean_log_total_depth3")]
    if trade_profile:
        kinds.append((c(f"state_{trade_profile}"), f"{trade_profile}_mean_log_total_depth3"))
    picks = [F.when(st.isNotNull(), F.struct(F.lit(n).alias("variant"), label.alias("st"))) for st, n in kinds for label in (st, F.lit("all"))]
    day = sample.filter(total.isNotNull()).withColumn("_k", F.explode(F.array_compact(F.array(*picks)))).groupBy(
        *DAY, "_k.variant", "_k.st").agg(F.avg(F.log1p(total)).alias("value"))
    heat = states.groupBy(*DAY).agg(F.coalesce(F.sum(F.when(c("is_trade"), c("source_volume"))), F.lit(0)).alias("daily_heat"))
    heat = heat.join(heat_cut, "symbol", "left").withColumn("heat", F.when(c("daily_heat") > c("heat_cut"), "high").otherwise("low"))
    m5 = day.join(heat, DAY).select(
        *DAY, F.lit("M5").alias("mechanism"), "variant",
        F.concat(F.lit("heat="), c("heat"), F.lit("|state="), c("st")).alias("group_key"), "value")
    vol = heat.select(*DAY, F.lit("M5").alias("mechanism"), F.lit("daily_active_volume").alias("variant"),
                      F.concat(F.lit("heat="), c("heat")).alias("group_key"), c("daily_heat").cast("double").alias("value"))
    return m4.unionByName(moments(m5.unionByName(vol)))


def daily_heat_cut(rows: DataFrame, warmup_until: int) -> DataFrame:
    """Median daily aggressive volume of the warm-up days (one row per day and symbol)."""
    d = rows.filter(F.col("date") < warmup_until).groupBy(*DAY).agg(
        F.coalesce(F.sum(F.when(F.col("is_trade"), F.col("source_volume"))), F.lit(0)).alias("v"))
    return d.groupBy("symbol").agg(F.median("v").alias("heat_cut"))


def distance_bucket() -> Column:
    """best / near_mid / outside, from the last valid book and the order price."""
    p, b, a = F.col("source_price"), F.col("pre.bid"), F.col("pre.ask")
    mid = (b + a) / 2.0
    buy = F.col("source_side") == "B"
    bps = F.when(buy, (mid - p) / mid * 10000.0).otherwise((p - mid) / mid * 10000.0)
    market = F.when(buy, p >= a).otherwise(p <= b)
    at = F.when(buy, p == b).otherwise(p == a)
    out = p.isNull() | (p <= 0) | (mid <= 0) | market | (bps < 0) | (bps > NEAR_MID_BPS)
    return F.when(out, "outside").when(at, "best").otherwise("near_mid")


def passive_outcomes(states: DataFrame, profile: str = "hl5", trade_profile: str | None = None) -> DataFrame:
    """Fills within 10 / 60 / 300 s and at all, and cancels, of resting orders.

    Orders whose id ever traded as aggressor that day are left out.
    ``trade_profile`` adds every outcome by the state of the trade clock.
    """
    c = F.col
    adds = states.filter((c("source_action") == "ORDER_ADD") & c("source_side").isin(*SIDES) & (c("source_volume") > 0)
                         & c("oid").isNotNull() & c("pre").isNotNull()).withColumn("distance", distance_bucket()).filter(c("distance") != "outside")
    first = first_per_key(
        adds.select(*DAY, c("source_side").alias("side"), c("oid").alias("order_id"), "row_id", "ms", "source_volume", "distance",
                    F.coalesce(f"state_{profile}", F.lit("unknown")).alias("state"),
                    F.coalesce(f"state_{trade_profile or profile}", F.lit("unknown")).alias("trade_state")), ORDER, "row_id",
        ["ms", "source_volume", "distance", "state", "trade_state"])
    trades = states.filter("is_trade")
    own = trades.select(*DAY, c("source_side").alias("side"), c("oid").alias("order_id")).filter(c("order_id").isNotNull()).distinct()
    first = first.join(own, ORDER, "left_anti")
    hits = trades.select(*DAY, X.opposite().alias("side"), c("pid").alias("order_id"), c("row_id").alias("_r"), c("ms").alias("_m"), c("source_volume").alias("_v"), F.lit(1).alias("_t"))
    gone = states.filter((c("source_action") == "CANCEL") & c("source_side").isin(*SIDES) & (c("source_volume") > 0)).select(
        *DAY, c("source_side").alias("side"), c("oid").alias("order_id"), c("row_id").alias("_r"), c("ms").alias("_m"), c("source_volume").alias("_v"), F.lit(0).alias("_t"))
    later = first.join(hits.unionByName(gone), ORDER).filter(c("_r") > c("row_id"))
    age = c("_m") - c("ms")
    fill = c("_t") == 1
    agg = later.groupBy(*ORDER).agg(
        *[X.sum0("_v", fill & (age <= s * 1000)).alias(f"v{s}") for s in (10, 60, 300)],
        X.sum0("_v", fill).alias("vall"), X.sum0("_v", ~fill).alias("cancelled"))
    o = first.join(agg, ORDER, "left").withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in ("v10", "v60", "v300", "vall", "cancelled")})
    stats = []
    for pre, state in [("", "state")] + ([(f"{trade_profile}_", "trade_state")] if trade_profile else []):
        g = F.concat(F.lit("side="), c("side"), F.lit("|state="), c(state), F.lit("|distance="), c("distance"))
        stats += [Stat("M6", f"{pre}submitted_orders", g, F.lit(1)), Stat("M6", f"{pre}submitted_volume", g, c("source_volume")),
                  Stat("M6", f"{pre}cancel_volume", g, c("cancelled"))]
        for n, col in (("10s", "v10"), ("60s", "v60"), ("300s", "v300"), ("continuous", "vall")):
            stats += [Stat("M6", f"{pre}filled_orders_{n}", g, (c(col) > 0).cast("int")), Stat("M6", f"{pre}filled_volume_{n}", g, c(col))]
    return _stat_moments(o, stats, span_of(states, DAY))


def chains_of(rows: DataFrame) -> DataFrame:
    """Contiguous trades of one aggressor, with the first row after them (same session)."""
    oid = F.coalesce("oid", -1 - F.coalesce("source_recid", "row_id"))
    run = islands(rows, F.col("is_trade"), [F.col("source_side"), oid], S, out="chain", span=span_of(rows))
    return run


def quote_counters(rows: DataFrame, span: int | None = SPAN) -> DataFrame:
    """Running volumes on both sides: trades, adds, aggressive adds and near cancels."""
    c = F.col
    first = rows.filter(c("is_trade") & c("oid").isNotNull()).groupBy(*DAY, c("source_side").alias("_side"), c("oid").alias("_key")).agg(F.min("row_id").alias("_first"))
    add = c("source_action") == "ORDER_ADD"
    keyed = rows.withColumns({"_side": c("source_side"), "_key": F.when(add & c("oid").isNotNull(), c("oid")).otherwise(-1 - c("row_id"))})
    r = keyed.join(first, [*DAY, "_side", "_key"], "left")
    p, b, a = c("source_price").cast("double"), c("pre.bid"), c("pre.ask")
    buy, reach = c("source_side") == "B", (b + a) / 2.0 * NEAR_BPS / 10000.0
    usable = c("pre").isNotNull() & c("source_side").isin(*SIDES) & (p > 0) & (c("source_volume") > 0)
    passive = usable & add & ~F.coalesce(c("_first") < c("row_id"), F.lit(False)) & F.when(buy, p < a).otherwise(p > b)
    aggressive = passive & F.when(buy, p >= b).otherwise(p <= a)
    near = usable & (c("source_action") == "CANCEL") & F.when(buy, p >= b - reach).otherwise(p <= a + reach)
    sums = {}
    for s in SIDES:
        mine = c("source_side") == s
        sums[f"vol_{s}"] = F.coalesce(_vol(s), F.lit(0))
        for n, cond in (("add", passive), ("agg", aggressive), ("can", near)):
            sums[f"{n}_{s}"] = F.when(F.coalesce(cond & mine, F.lit(False)), c("source_volume")).otherwise(0)
    sums["trade_no"] = c("is_trade").cast("long")
    # With the latest mid up to and including the row.
    return carry_forward(r, S, last={"last_mid": c("mid")}, sums=sums, inclusive=True, span=span).drop("_side", "_key", "_first")


COUNTERS = ["vol_B", "vol_S", "add_B", "add_S", "agg_B", "agg_S", "can_B", "can_S", "last_mid"]


def trigger_responses(events: DataFrame, lob_horizons: Sequence[int] = (20, 50), trade_horizons: Sequence[int] = (5, 10)) -> DataFrame:
    """What follows single trades and whole aggressor chains on two clocks.

    A chain is judged from the row that ends it: its label starts with the
    counters before that row and ends ``h`` rows (or trades) later.
    """
    c = F.col
    rows = stage(base_rows(events), "m1q-rows")
    span = span_of(rows)
    r = stage(quote_counters(chains_of(rows), span), "m1q-counters")
    snap = F.struct(*COUNTERS)
    look = {f"l{h}": (snap, h) for h in lob_horizons} | {f"e{h}": (snap, h - 1) for h in lob_horizons if h > 1} | {"before": (snap, -1)}
    ahead = shift_dense(r, S, "seq", look, span)
    trades = r.filter("is_trade").select(*S, "row_id", c("trade_no").alias("seq"), *COUNTERS)
    tl = shift_dense(trades, S, "seq", {f"t{h}": (snap, h) for h in trade_horizons}, span)
    raw = ahead.filter("is_trade").join(tl.select(*S, "row_id", *[f"t{h}" for h in trade_horizons]), [*S, "row_id"])
    mid0 = (c("pre.bid") + c("pre.ask")) / 2.0
    sgn = F.when(c("source_side") == "B", 1.0).otherwise(-1.0)
    raw_group = F.concat(F.lit("trigger="), c("source_side"))
    stats = []
    for clock, h, f in [("lob", h, c(f"l{h}")) for h in lob_horizons] + [("trade", h, c(f"t{h}")) for h in trade_horizons]:
        has = f.isNotNull()
        flow = sgn * ((f["vol_B"] - c("vol_B")) - (f["vol_S"] - c("vol_S")))
        stats.append(Stat("M1Q", f"{clock}{h}_raw_future_signed_volume", raw_group, flow, has))
        stats.append(Stat("M1Q", f"{clock}{h}_raw_directional_mid_bps", raw_group, sgn * F.ln(f["last_mid"] / mid0) * 10000.0,
                           has & (mid0 > 0) & f["last_mid"].isNotNull()))
    raw_stats = _stat_moments(raw, stats, span)

    per = r.filter(c("chain").isNotNull()).groupBy(*S, "chain").agg(
        F.any_value("source_side").alias("side"), F.count(F.lit(1)).alias("children"), F.max("seq").alias("last_seq"),
        F.max("trade_no").alias("last_trade"), F.min_by(F.struct(mid0.alias("mid"), c("pre.ask3").alias("a3"), c("pre.bid3").alias("b3")), "row_id").alias("at"))
    # The ending row is the next one; a chain at the session end has none.
    ends = ahead.select(*S, c("seq").alias("end_seq"), "before", *[f"e{h}" for h in lob_horizons if h > 1], snap.alias("self"))
    ch = per.withColumn("end_seq", c("last_seq") + 1).join(ends, [*S, "end_seq"])
    tt = trades.select(*S, c("seq").alias("_k"), snap.alias("_snap"))
    for h in trade_horizons:
        ch = ch.withColumn("_k", c("last_trade") + h).join(tt.withColumnRenamed("_snap", f"t{h}"), [*S, "_k"], "left").drop("_k")
    sg = F.when(c("side") == "B", 1.0).otherwise(-1.0)
    kinds = [F.concat(F.lit("trigger="), c("side"), F.lit("|chain="), k) for k in (F.lit("all"), F.when(c("children") == 1, "single").otherwise("multi"))]
    stats = []
    for clock, h in [("lob", h) for h in lob_horizons] + [("trade", h) for h in trade_horizons]:
        f = (c(f"e{h}") if h > 1 else c("self")) if clock == "lob" else c(f"t{h}")
        has, b = f.isNotNull(), c("before")
        flow = sg * ((f["vol_B"] - b["vol_B"]) - (f["vol_S"] - b["vol_S"]))
        same = lambda n: F.when(c("side") == "B", f[f"{n}_B"] - b[f"{n}_B"]).otherwise(f[f"{n}_S"] - b[f"{n}_S"])  # noqa: B023, E731
        other = lambda n: F.when(c("side") == "B", f[f"{n}_S"] - b[f"{n}_S"]).otherwise(f[f"{n}_B"] - b[f"{n}_B"])  # noqa: B023, E731
        mid_ok = has & (c("at.mid") > 0) & f["last_mid"].isNotNull()
        bps = sg * F.ln(f["last_mid"] / c("at.mid")) * 10000.0
        depth = F.when(c("side") == "B", c("at.a3")).otherwise(c("at.b3"))
        n = f"{clock}{h}"
        metrics = [
            (f"{n}_chain_future_signed_volume", flow, has),
            (f"{n}_chain_directional_mid_bps", bps, mid_ok),
            (f"{n}_same_aggressive_add_share", X.ratio(same("agg"), same("add")), has & (same("add") > 0)),
            (f"{n}_opposite_aggressive_add_share", X.ratio(other("agg"), other("add")), has & (other("add") > 0)),
            (f"{n}_opposite_replenish_depth3", X.ratio(other("agg"), depth), has & (depth > 0)),
            (f"{n}_opposite_near_cancel_depth3", X.ratio(other("can"), depth), has & (depth > 0))]
        stats += [Stat("M1Q", name, g, v, cond) for g in kinds for name, v, cond in metrics]
        joint = F.concat(F.lit("trigger="), c("side"), F.lit("|chase="), (same("agg") > 0).cast("int").cast("string"),
                         F.lit("|replenish="), (other("agg") > 0).cast("int").cast("string"), F.lit("|chain=all"))
        stats += [Stat("M1Q", f"{clock}{h}_chain_future_signed_by_quote_state", joint, flow, has),
                  Stat("M1Q", f"{clock}{h}_chain_mid_bps_by_quote_state", joint, bps, mid_ok)]
    return raw_stats.unionByName(_stat_moments(ch, stats, span))


def pre_post_flow(events: DataFrame, lob_horizons: Sequence[int] = (20, 50), trade_horizons: Sequence[int] = (5, 10)) -> DataFrame:
    """Flow in the k rows (trades) before a chain and in the k after, own volume excluded."""
    c = F.col
    rows = stage(base_rows(events), "m1pp-rows")
    span = span_of(rows)
    r = carry_forward(chains_of(rows), S, inclusive=True, span=span, sums={
        "vol_B": F.coalesce(_vol("B"), F.lit(0)), "vol_S": F.coalesce(_vol("S"), F.lit(0)), "trade_no": c("is_trade").cast("long")})
    r = stage(r, "m1pp-run")
    per = r.filter(c("chain").isNotNull()).groupBy(*S, "chain").agg(
        F.any_value("source_side").alias("side"), F.count(F.lit(1)).alias("children"), F.min("seq").alias("s0"), F.max("seq").alias("s1"),
        F.min("trade_no").alias("n0"), F.max("trade_no").alias("n1"))
    has_end = rows.groupBy(*S).agg(F.max("seq").alias("_len"))
    per = per.join(has_end, S).filter(c("s1") < c("_len")).drop("_len")
    # Cumulative volumes at four positions around the chain, fetched in one join.
    wanted = []
    for h in lob_horizons:
        wanted += [("lob", h, "a", c("s0") - 1 - h), ("lob", h, "b", c("s0") - 1), ("lob", h, "c", c("s1")), ("lob", h, "d", c("s1") + h)]
    for h in trade_horizons:
        wanted += [("trade", h, "a", c("n0") - 1 - h), ("trade", h, "b", c("n0") - 1), ("trade", h, "c", c("n1")), ("trade", h, "d", c("n1") + h)]
    asks = F.explode(F.array(*[F.struct(F.lit(k).alias("clock"), F.lit(h).alias("h"), F.lit(n).alias("at"), p.cast("long").alias("idx")) for k, h, n, p in wanted]))
    ask = per.withColumn("_a", asks).select(*S, "chain", "side", "children", "_a.*")
    zero = rows.select(*S).distinct().select(*S, F.explode(F.array(F.lit("lob"), F.lit("trade"))).alias("clock"), F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("vb"), F.lit(0).cast("long").alias("vs"))
    table = r.select(*S, F.lit("lob").alias("clock"), c("seq").alias("idx"), c("vol_B").alias("vb"), c("vol_S").alias("vs")).unionByName(
        r.filter("is_trade").select(*S, F.lit("trade").alias("clock"), c("trade_no").alias("idx"), c("vol_B").alias("vb"), c("vol_S").alias("vs"))).unionByName(zero)
    got = ask.join(table, [*S, "clock", "idx"])
    val = F.struct("vb", "vs")
    wide = got.groupBy(*S, "chain", "side", "children", "clock", "h").agg(
        *[F.max(F.when(c("at") == n, val)).alias(n) for n in "abcd"]).filter(c("a").isNotNull() & c("d").isNotNull())
    sg = F.when(c("side") == "B", 1.0).otherwise(-1.0)
    wide = wide.withColumns({
        "pre_s": sg * ((c("b.vb") - c("a.vb")) - (c("b.vs") - c("a.vs"))), "post_s": sg * ((c("d.vb") - c("c.vb")) - (c("d.vs") - c("c.vs"))),
        "pre_t": ((c("b.vb") - c("a.vb")) + (c("b.vs") - c("a.vs"))).cast("double"), "post_t": ((c("d.vb") - c("c.vb")) + (c("d.vs") - c("c.vs"))).cast("double")})
    both = (c("pre_t") > 0) & (c("post_t") > 0)
    pre_h, post_h = X.ratio("pre_s", "pre_t"), X.ratio("post_s", "post_t")
    stem = F.concat(c("clock"), c("h").cast("string"), F.lit("_chain_"))
    metrics = [
        ("pre_signed_volume", c("pre_s"), None), ("post_signed_volume", c("post_s"), None), ("post_minus_pre_signed_volume", c("post_s") - c("pre_s"), None),
        ("pre_total_volume", c("pre_t"), None), ("post_total_volume", c("post_t"), None), ("post_minus_pre_total_volume", c("post_t") - c("pre_t"), None),
        ("pre_signed_share", pre_h, both), ("post_signed_share", post_h, both), ("post_minus_pre_signed_share", post_h - pre_h, both)]
    kinds = [F.concat(F.lit("trigger="), c("side"), F.lit("|chain="), k) for k in (F.lit("all"), F.when(c("children") == 1, "single").otherwise("multi"))]
    stats = [Stat("M1PP", n, g, v, cond) for g in kinds for n, v, cond in metrics]
    return _stat_moments(wide, stats, span, lead=stem)


def run_mechanisms(
    events: DataFrame, warmup_until: int, profile: str = "hl5", trade_profile: str = "teh20",
    keep: int = KEEP, minimum: int = 100, window_s: int = 30, prices: bool = True,
) -> dict[str, DataFrame]:
    """States and all that the statistics of the mechanism study need, from one staged row table.

    ``prices``: also the price states, for the statistics that read them.
    """
    counted = bounds(sessions(events), F.col("source_action") == "TRADE")
    small = counted[0]
    rows = base_rows(events, small=small)
    dense = intensities(rows if small else stage(rows, "mech-rows"), [int(profile[2:])], [int(trade_profile[3:])], keep, counted)
    cuts = stage(state_cuts(dense, [profile, trade_profile], warmup_until, minimum=minimum, small=small), "mech-cuts")
    states = stage(with_states(dense, cuts, [profile, trade_profile], warmup_until), "mech-states")
    out = {"rows": dense, "states": states, "cuts": cuts, "heat": daily_heat_cut(dense, warmup_until)}
    if prices:
        out["prices"] = stage(price_states(dense, warmup_until, window_s, minimum=minimum), "mech-prices")
    return out


# ---------------------------------------------------------------- summaries

STAT_KEYS = ["mechanism", "variant", "group_key"]


def with_domains(stats: DataFrame, domains: DataFrame | None = None) -> DataFrame:
    """Each row once for its domain and once for the whole market."""
    if domains is None:
        return stats.withColumn("domain", F.lit("all/all"))
    j = stats.join(domains.select(*DAY, "domain"), DAY)
    return j.withColumn("domain", F.explode(F.array(F.col("domain"), F.lit("all/all"))))


def group_summary(stats: DataFrame) -> DataFrame:
    """Weighted mean and stock-day mean with t and interval per group."""
    d = stats.filter(F.col("weight_sum") > 0).withColumn("m", F.col("value_sum") / F.col("weight_sum"))
    ci = confidence("m")
    return d.groupBy("domain", *STAT_KEYS).agg(
        F.count("m").alias("stock_days"), F.sum("observations").alias("observations"),
        (F.sum("value_sum") / F.sum("weight_sum")).alias("weighted_mean"), ci["mean"].alias("stock_day_mean"),
        F.when((F.count("m") > 1) & (F.stddev_samp("m") > 0), ci["mean"] / ci["se"]).alias("stock_day_t"),
        ci["low"].alias("ci95_lower"), ci["high"].alias("ci95_upper"))


def contrast_values(stats: DataFrame, contrasts: Sequence[Mapping[str, str]]) -> DataFrame:
    """Stock-day means of the left and right side of each contrast.

    A contrast names a mechanism, a variant and two text patterns of the group.
    """
    picks = [
        F.when((F.col("mechanism") == k["mechanism"]) & (F.col("variant") == k["variant"]) & F.col("group_key").contains(k[s]),
               F.struct(F.lit(k["name"]).alias("contrast"), F.lit(s).alias("leg")))
        for k in contrasts for s in ("left", "right")]
    long = stats.withColumn("_p", F.explode(F.array_compact(F.array(*picks)))).select("domain", "mechanism", *DAY, "value_sum", "weight_sum", "_p.*")
    return long.groupBy("domain", "mechanism", "contrast", "leg", *DAY).agg(
        (F.sum("value_sum") / F.sum("weight_sum")).alias("v"))


def _t(v: str) -> Column:
    sd = F.stddev_samp(v)
    return F.when((F.count(v) > 1) & (sd > 0), F.avg(v) / (sd / F.sqrt(F.count(v).cast("double"))))


def paired_contrasts(values: DataFrame) -> DataFrame:
    """Left minus right on the same stock-day, with symbol- and date-clustered t."""
    c = F.col
    key = ["domain", "mechanism", "contrast"]
    pair = values.groupBy(*key, *DAY).agg(
        F.max(F.when(c("leg") == "left", c("v"))).alias("l"), F.max(F.when(c("leg") == "right", c("v"))).alias("r")).filter(
        c("l").isNotNull() & c("r").isNotNull()).withColumn("d", c("l") - c("r"))
    ci = confidence("d")
    out = pair.groupBy(*key).agg(
        F.count("d").alias("stock_days"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), ci["mean"].alias("difference"),
        _t("d").alias("difference_t"), ci["low"].alias("ci95_lower"), ci["high"].alias("ci95_upper"))
    for unit, n in (("symbol", "symbols"), ("date", "dates")):
        g = pair.groupBy(*key, unit).agg(F.avg("d").alias("m")).groupBy(*key).agg(
            F.count("m").alias(n), F.avg("m").alias(f"{unit}_mean_difference"), _t("m").alias(f"{unit}_t"))
        out = out.join(g, key)
    return out


def within_symbol_contrasts(values: DataFrame) -> DataFrame:
    """Averages of two kinds of days within a symbol, then left minus right over symbols."""
    c = F.col
    key = ["domain", "mechanism", "contrast"]
    sym = values.groupBy(*key, "symbol").agg(
        F.avg(F.when(c("leg") == "left", c("v"))).alias("l"), F.avg(F.when(c("leg") == "right", c("v"))).alias("r")).filter(
        c("l").isNotNull() & c("r").isNotNull()).withColumn("d", c("l") - c("r"))
    ci = confidence("d")
    return sym.groupBy(*key).agg(
        F.count("d").alias("symbols"), F.avg("l").alias("left_mean"), F.avg("r").alias("right_mean"), ci["mean"].alias("difference"),
        _t("d").alias("difference_t"), ci["low"].alias("ci95_lower"), ci["high"].alias("ci95_upper"))


def quality_totals(rows: DataFrame) -> DataFrame:
    """Counts over the whole run: stock-days, duplicates, books and trades."""
    return rows.agg(
        F.count_distinct("symbol").alias("symbols"), F.count_distinct("symbol", "date").alias("stock_days"), F.count(F.lit(1)).alias("total_events"),
        X.count_if(F.col("is_trade")).alias("valid_trades"), X.count_if(F.col("mid").isNull()).alias("invalid_books"),
        X.count_if((F.col("source_action") == "TRADE") & ~F.col("is_trade")).alias("dropped_trades"))
