"""Scoring factors against forward returns: coefficients, spreads, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.operators.crosssection import (
    pearson, percentile_ranks, position, rank_ic, residualise, slice_deciles,
    tail_spread, tied_rank, value_ranks,
)
from lobloom.operators.lifecycle import calendar
from lobloom.operators.ordered import span_of
from lobloom.session import shuffle_tasks, stage


# Autocorrelation lags by return horizon in days.
HAC_LAGS = {"d1": 0, "d2": 1, "d3": 2, "d5": 4}
# Rows of a date up to which its cross-sections are sorted whole (they spill, a task holds one at a time).
WHOLE = 1_000_000


def forward_returns(panel: DataFrame, ret: str = "ret", horizons: Sequence[int] = (1, 2, 3, 5), lag: int = 1) -> DataFrame:
    """Compounded returns over the next market dates, entered ``lag`` dates later.

    A horizon is NULL unless the symbol has a return on each of its dates.  Every
    row is sent once to each signal date it serves, one shuffle for all horizons.
    """
    longest = max(horizons)
    cal = calendar(panel)
    keyed = panel.select("symbol", "date", ret).join(cal, "date")
    steps = F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))
    served = keyed.withColumn("step", steps).select(
        "symbol", (F.col("day_seq") - lag - F.col("step")).alias("day_seq"), "step", ret)
    wide = served.groupBy("symbol", "day_seq").agg(
        *[F.max(F.when(F.col("step") == k, F.col(ret))).alias(f"_r{k}") for k in range(longest)])
    out = {}
    for h in horizons:
        growth: Column = F.lit(1.0)
        for k in range(h):
            growth = growth * (1.0 + F.col(f"_r{k}"))
        out[f"ret_d{h}"] = growth - 1.0
    base = keyed.select("symbol", "date", "day_seq")
    return base.join(wide, ["symbol", "day_seq"], "left").select(
        "symbol", "date", *[e.alias(n) for n, e in out.items()])


def fixed_minute_returns(bars: DataFrame, entry: str, exits: Sequence[str]) -> DataFrame:
    """Returns from the close of one minute to those of later ones, signed and absolute.

    ``bars(symbol, date, stamp, close)``; a stock-day without a positive entry close is left out, a missing exit is NULL.
    """
    close = {t: F.max(F.when(F.col("stamp") == t, F.col("close"))).alias(f"_c{t}") for t in (entry, *exits)}
    g = bars.filter(F.col("stamp").isin(list(close))).groupBy("symbol", "date").agg(*close.values()).filter(F.col(f"_c{entry}") > 0)
    out = []
    for t in exits:
        r = F.col(f"_c{t}") / F.col(f"_c{entry}") - 1.0
        out += [r.alias(f"ret_{entry}_{t}"), F.abs(r).alias(f"abs_ret_{entry}_{t}")]
    return g.select("symbol", "date", *out)


def plain_t(value, cond=None) -> dict[str, Column]:
    """Mean and t of a column (sample deviation), as aggregates."""
    v = X.col(value)
    n, sd = F.count(v), F.stddev_samp(v)
    return {"mean": F.avg(v), "t": F.when((n > 1) & (sd > 0), F.avg(v) / (sd / F.sqrt(n.cast("double"))))}


def confidence(value) -> dict[str, Column]:
    v = X.col(value)
    se = F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))
    return {"mean": F.avg(v), "se": se, "low": F.avg(v) - 1.96 * se, "high": F.avg(v) + 1.96 * se, "n": F.count(v)}


def newey_west(
    df: DataFrame, keys: Sequence[str], value: str, lags: int | str, order: str = "date", most: int = max(HAC_LAGS.values()),
) -> DataFrame:
    """Mean and Bartlett-weighted t per key; lag 0 is the plain t.

    One row per date, so a series is bounded by the calendar.  ``lags`` may name
    a column that is constant per key; ``most`` is then the largest value it may
    hold, and a larger one is an error.
    """
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull()).withColumn(
        "_lags", F.lit(lags) if isinstance(lags, int) else F.col(lags))
    if isinstance(lags, int):
        most = lags
    else:
        known = known.withColumn("_lags", F.when(F.col("_lags") > most, F.raise_error(
            F.concat(F.lit(f"more than {most} lags asked for: "), F.col("_lags").cast("string"))).cast("int")).otherwise(F.col("_lags")))
    whole = Window.partitionBy(*keys)
    line = whole.orderBy(order)
    c = known.withColumn("_c", F.col(value) - F.avg(value).over(whole))
    c = c.withColumns({f"_l{k}": F.lag("_c", k).over(line) for k in range(1, most + 1)})
    n = F.count(F.lit(1)).cast("double")
    long_run = F.sum(F.col("_c") * F.col("_c")) / n
    for k in range(1, most + 1):
        w = F.greatest(F.lit(0.0), 1.0 - k / (F.max("_lags") + 1.0))
        long_run = long_run + 2.0 * w * F.coalesce(F.sum(F.col("_c") * F.col(f"_l{k}")), F.lit(0.0)) / n
    t = plain_t(value)
    var = F.greatest(F.lit(0.0), long_run) / n
    return c.groupBy(*keys).agg(
        t["mean"].alias("mean"),
        F.when(F.max("_lags") == 0, t["t"]).otherwise(
            F.when((n > 1) & (var > 0), t["mean"] / F.sqrt(var))).alias("t"),
        F.count(F.lit(1)).alias("n_dates"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("positive_date_share"),
    )


def annual_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, volatility, cumulative return, Sharpe (252), t and win rate of a daily series."""
    v = F.col(value)
    n, sd = F.count(v), F.stddev_samp(v)
    aggs = {
        "n_days": n, "avg_daily_ret": F.avg(v), "cum_ret": F.product(1.0 + v) - 1.0,
        "ann_ret_simple": F.avg(v) * 252.0,
        "ann_vol": F.coalesce(sd, F.lit(0.0)) * (252.0 ** 0.5),
        "sharpe": F.coalesce(F.when(sd > 0, F.avg(v) / sd * (252.0 ** 0.5)), F.lit(0.0)),
        "t_stat": F.coalesce(F.when(sd > 0, F.avg(v) / (sd / F.sqrt(n.cast("double")))), F.lit(0.0)),
        "win_rate": F.avg(F.when(v > 0, 1.0).otherwise(0.0)),
    }
    cols = [e.alias(k) for k, e in aggs.items()]
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def decile_table(df: DataFrame, factor: str, ret: str, minimum: int = 10) -> DataFrame:
    """All ten decile means per date, the universe mean, spread, and both correlations."""
    both = stage(df.filter(F.col(factor).isNotNull() & F.col(ret).isNotNull()).select("symbol", "date", factor, ret), "deciles")
    deciles = slice_deciles(both, ["date"], factor)
    g = deciles.groupBy("date").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.when(F.col("decile") == d, F.col(ret))).alias(f"d{d}") for d in range(1, 11)],
        F.avg(ret).alias("universe_ret"),
    ).filter(F.col("n") >= minimum)
    g = g.withColumns({"top_bottom": F.col("d10") - F.col("d1"), "top_excess": F.col("d10") - F.col("universe_ret")})
    pic = pearson(both, ["date"], factor, ret, "pearson_ic").drop("n")
    ric = rank_ic(both, ["date"], factor, ret, "rank_ic").drop("n")
    return g.join(pic, "date", "left").join(ric, "date", "left")


def event_gap(df: DataFrame, group: Sequence[str], event: str, ret: str) -> DataFrame:
    """Mean return of positive and negative events minus that of non-events."""
    e, r = F.col(event), F.col(ret)
    known = df.filter(r.isNotNull())
    ctrl = F.avg(F.when(e == 0, r))
    return known.groupBy(*group).agg(
        (F.avg(F.when(e == 1, r)) - ctrl).alias("positive_gap"),
        (F.avg(F.when(e == -1, r)) - ctrl).alias("negative_gap"),
        X.count_if(e != 0).alias("n_events"), F.count(F.lit(1)).alias("n"),
    )


SCOPES = ("domain", "domain_rank_aggregate", "exchange", "all_market")


def scoped(
    df: DataFrame, factors: Sequence[str], targets: Sequence[str], minimum: int = 15, whole: bool = False, by: Sequence[str] = (),
) -> DataFrame:
    """Rows repeated for each scope, factor and target, which are numbered as listed.

    Scopes: the row's domain, the pool of domain percentile ranks, its exchange,
    the whole market.  Domains below ``minimum`` names stay out of the pool.
    ``whole``: the cross-sections are known to be small enough for plain windows.
    ``by`` are further keys of every cross-section.
    """
    items = F.array(*[F.struct(F.lit(i).alias("factor_name"), F.col(f).cast("double").alias("score")) for i, f in enumerate(factors)])
    long = df.filter(F.col("domain").isNotNull()).withColumn("_f", F.explode(items)).select(
        "symbol", "date", "domain", "exchange", *by, "_f.*", *[t for t in targets]
    ).filter(F.col("score").isNotNull())
    group = ["date", "domain", "factor_name", *by]
    if whole:
        ranked = long.withColumns({"_r": tied_rank(group, "score"), "_dn": F.count(F.lit(1)).over(Window.partitionBy(*group))})
    else:
        long = stage(long, "scope-base")
        ranks = value_ranks(long, group, "score", "_r", "_dn").select(*group, "score", "_r", "_dn")
        ranked = long.join(ranks, [*group, "score"])
    ranked = ranked.withColumn("_pct", F.when(F.col("_dn") > 1, (F.col("_r") - 1) / (F.col("_dn") - 1)).otherwise(0.5))

    def scope(name, key, score, cond=None):
        s = F.struct(F.lit(SCOPES.index(name)).alias("scope"), key.alias("scope_key"), score.alias("score"))
        return s if cond is None else F.when(cond, s)

    scopes = F.array_compact(F.array(
        scope("domain", F.col("domain"), F.col("score")),
        scope("domain_rank_aggregate", F.lit("all_domains"), F.col("_pct"), F.col("_dn") >= minimum),
        scope("exchange", F.col("exchange"), F.col("score")),
        scope("all_market", F.lit("all"), F.col("score"))))
    goals = F.array(*[F.struct(F.lit(i).alias("target_name"), F.col(t).alias("target")) for i, t in enumerate(targets)])
    rows = ranked.withColumn("_s", F.explode(scopes)).withColumn("_t", F.explode(goals)).select(
        "symbol", "date", *by, "factor_name", "_s.*", "_t.*")
    return rows.filter(F.col("target").isNotNull())


SCOPE_KEYS = ["scope", "scope_key", "date", "factor_name", "target_name"]


def fits(df: DataFrame) -> bool:
    """Whether no date of ``df`` has more than ``WHOLE`` rows."""
    return span_of(df, ["date"], WHOLE) is None


def evaluate(
    df: DataFrame, factors: Sequence[str], targets: Sequence[str], minimum: int = 15, whole: bool | None = None, split: str | None = None,
) -> DataFrame:
    """Rank correlation and decile spread by date, scope, factor and target.

    Where no date has more than ``WHOLE`` rows, rows are shuffled once and every
    cross-section is sorted in its task; larger ones are ranked in value ranges.
    ``whole`` is that judgement where it is known (:func:`fits`).  ``split`` is a
    column whose values are evaluated each alone, and all rows together as ``all``.
    """
    if whole is None:
        whole = fits(df)
    by = [split] if split else []
    if split:
        df = df.withColumn(split, F.explode(F.array_compact(F.array(F.col(split), F.lit("all")))))
    rows = scoped(df, factors, targets, minimum, whole, by)
    keys = [*SCOPE_KEYS, *by]
    if whole:
        group = Window.partitionBy(*keys)
        placed = rows.repartition(shuffle_tasks(rows), *keys).withColumns({
            "_p": F.row_number().over(group.orderBy("score", "symbol")), "_a": tied_rank(keys, "score"), "n": F.count(F.lit(1)).over(group)})
        placed = placed.withColumn("_b", tied_rank(keys, "target"))
        side = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.1)))
        top, bottom = F.col("_p") > F.col("n") - side, F.col("_p") <= side
        g = placed.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"), F.stddev_pop("_a").alias("_sa"), F.stddev_pop("_b").alias("_sb"), F.covar_pop("_a", "_b").alias("_cov"),
            (F.avg(F.when(top, F.col("target"))) - F.avg(F.when(bottom, F.col("target")))).alias("d10_d1"))
        ok = (F.col("n") >= 3) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
        by_date = g.withColumn("rank_ic", F.when(ok, F.col("_cov") / (F.col("_sa") * F.col("_sb"))))
    else:
        rows = stage(rows, "scoped")
        ic = rank_ic(rows, keys, "score", "target", "rank_ic")
        by_date = ic.join(tail_spread(rows, keys, "score", "target", 0.1, "d10_d1").select(*keys, "d10_d1"), keys)
    names = {"scope": SCOPES, "factor_name": factors, "target_name": targets}
    named = {k: F.element_at(F.array(*[F.lit(v) for v in vs]), F.col(k) + 1) for k, vs in names.items()}
    # Twelve digits, so rounding noise around zero never counts as a sign.
    return by_date.filter(F.col("n") >= minimum).select(
        *[named.get(k, F.col(k)).alias(k) for k in keys], "n", *[F.round(m, 12).alias(m) for m in ("rank_ic", "d10_d1")])


def summarise(by_date: DataFrame, metrics: Sequence[str] = ("rank_ic", "d10_d1"), keys: Sequence[str] | None = None) -> DataFrame:
    """Mean, t and positive-date share of the metrics over dates."""
    keys = list(keys or [k for k in SCOPE_KEYS if k != "date"])
    daily = by_date.groupBy(*keys, "date").agg(
        *[F.avg(m).alias(m) for m in metrics], F.sum("n").alias("_n"))
    aggs = [F.count(F.lit(1)).alias("n_dates"), F.sum("_n").alias("n_obs"), F.avg("_n").alias("avg_names")]
    for m in metrics:
        t = plain_t(m)
        aggs += [t["mean"].alias(m), t["t"].alias(f"{m}_t"),
                 F.avg(F.when(F.col(m).isNotNull(), F.when(F.col(m) > 0, 1.0).otherwise(0.0))).alias(f"{m}_positive_date_share")]
    return daily.groupBy(*keys).agg(*aggs)


def neutralise(df: DataFrame, factor: str, styles: Sequence[str], where: str = "market", out: str = "neutral") -> DataFrame:
    """Residualise before (``market``) or inside (``domain``) the split into domains."""
    group = ["date"] if where == "market" else ["date", "domain"]
    return residualise(df, group, {out: (factor, list(styles))})


def style_exposure(df: DataFrame, factor: str, styles: Sequence[str], group: Sequence[str] = ("date",)) -> DataFrame:
    """Joint R2 on all styles and the rank correlation with each."""
    group = list(group)
    rows = stage(df.select("symbol", *group, factor, *styles), "exposure")
    cols = {f"_x{i}": c for i, c in enumerate([factor, *styles])}
    ranked = percentile_ranks(rows, group, cols)
    ic = ranked.groupBy(*group).agg(
        *[F.corr("_x0", f"_x{i + 1}").alias(f"rank_exposure_{s}") for i, s in enumerate(styles)],
        F.count(F.lit(1)).alias("n"))
    r2 = residualise(rows, group, {"_e": (factor, list(styles))}, r2=True, rank=True).groupBy(*group).agg(
        F.any_value("_e_r2").alias("joint_r2"), F.any_value("_e_rank").alias("effective_rank"))
    mean_abs = sum([F.abs(F.col(f"rank_exposure_{s}")) for s in styles], F.lit(0.0)) / len(styles)
    return ic.join(r2, group).withColumn("mean_abs_exposure", mean_abs)


def tail_grid(df: DataFrame, factor: str, target: str, widths: Sequence[float], group: Sequence[str] = ("date",)) -> DataFrame:
    """Top and bottom means at several tail widths from one ordering."""
    group = list(group)
    both = df.filter(F.col(factor).isNotNull() & F.col(target).isNotNull())
    placed = position(both, group, [F.col(factor), F.col("symbol")], out="_p", total="_n")
    wide = placed.withColumn("tail_width", F.explode(F.array(*[F.lit(w) for w in widths])))
    side = F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("tail_width")))
    return wide.groupBy(*group, "tail_width").agg(
        F.count(F.lit(1)).alias("n"), F.max(side).cast("long").alias("tail_names"),
        F.avg(F.when(F.col("_p") > F.col("_n") - side, F.col(target))).alias("top_return"),
        F.avg(F.when(F.col("_p") <= side, F.col(target))).alias("bottom_return"),
    ).withColumn("top_minus_bottom", F.col("top_return") - F.col("bottom_return"))
