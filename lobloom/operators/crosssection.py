"""Cross-section operators: per-group statistics, quantiles, ranks, residuals.

Moments and quantiles are combinable aggregates joined back to the rows, so a
large cross-section is never gathered in one task.  Positions are taken inside
value ranges chosen from a hashed sample once a group is large.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ONE_IN = 16_384
WIDE = 512


def attach(df: DataFrame, group: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """Join per-group aggregates back to the rows."""
    stats = df.groupBy(*group).agg(*[a.alias(n) for n, a in aggs.items()])
    return df.join(stats, list(group))


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, points: Mapping[str, float], whole: bool = False,
) -> DataFrame:
    """Interpolated quantiles per group from ranked distinct values.

    Nothing is gathered per group: the two neighbours of each quantile are the
    smallest values whose running count reaches their positions.  ``whole``: the
    groups are known to be small enough for a plain window.
    """
    group = list(group)
    known = df.filter(F.col(value).isNotNull())
    if whole:
        w = Window.partitionBy(*group)
        placed = known.select(*group, F.col(value).alias("_q")).withColumns(
            {"_upto": F.row_number().over(w.orderBy("_q")), "_n": F.count(F.lit(1)).over(w)})
    else:
        counts = known.groupBy(*group, F.col(value).alias("_q")).agg(F.count(F.lit(1)).alias("_c"))
        placed = position(counts, group, [F.col("_q")], weight="_c", out="_upto", total="_n")
    aggs, outs = [F.max("_n").alias("_n")], []
    for i, (name, p) in enumerate(points.items()):
        at = (F.col("_n") - 1) * F.lit(float(p))
        aggs.append(F.min(F.when(F.col("_upto") >= F.floor(at) + 1, F.col("_q"))).alias(f"_a{i}"))
        aggs.append(F.min(F.when(F.col("_upto") >= F.ceil(at) + 1, F.col("_q"))).alias(f"_b{i}"))
        w = at - F.floor(at)
        outs.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * w).alias(name))
    return placed.groupBy(*group).agg(*aggs).select(*group, *outs)


def group_quantiles(
    df: DataFrame, group: Sequence[str], points: Mapping[str, tuple[str, float]], whole: bool = False,
) -> DataFrame:
    """One row per group with several ``output -> (column, probability)`` quantiles.

    The columns are stacked first, so one ranking serves them all.
    """
    group = list(group)
    cols = list(dict.fromkeys(c for c, _ in points.values()))
    probs = sorted({p for _, p in points.values()})
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("_col"), F.col(c).cast("double").alias("_v")) for c in cols]))
    long = df.select(*group, stack.alias("_s")).select(*group, "_s.*")
    q = exact_quantiles(long, [*group, "_col"], "_v", {f"_p{i}": p for i, p in enumerate(probs)}, whole)
    return q.groupBy(*group).agg(*[
        F.max(F.when(F.col("_col") == c, F.col(f"_p{probs.index(p)}"))).alias(n)
        for n, (c, p) in points.items()])


def quantile_agg(value, p: float) -> Column:
    """Interpolated quantile as an aggregate.

    Buffers one counter per distinct value, so it is meant for values on a small
    grid (ticks, counts, milliseconds); others go through :func:`group_quantiles`.
    """
    return F.percentile(value, F.lit(p))


def winsorise(
    df: DataFrame, group: Sequence[str], columns: Mapping[str, str],
    lower: float = 0.01, upper: float = 0.99, count: str | None = None, minimum: int = 0, whole: bool = False,
) -> DataFrame:
    """``columns``: output -> input, clipped at interpolated group quantiles.

    ``count`` also keeps the group size and drops groups below ``minimum``.
    ``whole``: the groups are known to be small enough for plain windows.
    """
    group = list(group)
    points = {f"_lo_{out}": (c, lower) for out, c in columns.items()}
    points |= {f"_hi_{out}": (c, upper) for out, c in columns.items()}
    cuts = group_quantiles(df, group, points, whole)
    base = df
    if count:
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias(count))
        base = df.join(sizes.filter(F.col(count) >= minimum), group)
    clipped = {
        out: F.least(F.greatest(F.col(c), F.col(f"_lo_{out}")), F.col(f"_hi_{out}"))
        for out, c in columns.items()
    }
    return base.join(cuts, group, "left").withColumns(clipped).drop(*points)


def zscore(df: DataFrame, group: Sequence[str], columns: Mapping[str, str]) -> DataFrame:
    """Population z-score, 0 where the group has no spread."""
    aggs = {}
    for out, c in columns.items():
        aggs[f"_m_{out}"] = F.avg(c)
        aggs[f"_s_{out}"] = F.stddev_pop(c)
    scored = attach(df, group, aggs)
    return scored.withColumns(
        {
            out: F.when(F.col(f"_s_{out}") > 0, (F.col(c) - F.col(f"_m_{out}")) / F.col(f"_s_{out}"))
            .otherwise(F.when(F.col(c).isNotNull(), F.lit(0.0)))
            for out, c in columns.items()
        }
    ).drop(*aggs)


def value_ranks(df: DataFrame, group: Sequence[str], value: str, out: str, total: str) -> DataFrame:
    """Average-tie rank of every distinct value of a group, and the group size."""
    group = list(group)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(
        F.count(F.lit(1)).alias("_c"))
    placed = position(counts, group, [F.col(value)], weight="_c", out="_upto", total=total)
    return placed.select(
        *group, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out), total)


def tied_rank(group: Sequence[Column | str], value: str) -> Column:
    """Average-tie rank of a row in its group by plain windows, for groups of counted size."""
    w = Window.partitionBy(*group).orderBy(value)
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.rank().over(w) + (ties - 1) / 2.0


def average_rank(df: DataFrame, group: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Average-tie rank (1-based) plus the group size in ``<out>_n``.

    Works on distinct values and their counts, so equal values cost one row.
    """
    ranks = value_ranks(df, group, value, out, f"{out}_n")
    return df.join(ranks, [*group, value], "left")


def position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    out: str = "pos",
    weight: str | None = None,
    total: str | None = None,
    one_in: int = SAMPLE_ONE_IN,
) -> DataFrame:
    """1-based position (running weight) of each row in its group's order.

    ``order`` must identify a row.  A hashed sample of the keys (one in
    ``one_in``) cuts a group into ranges of about ``8 * one_in`` rows, however
    large it is, ranked on their own.  A row finds its range in two steps: first
    among the few keys of a sample ``WIDE`` times thinner, then among the bounds
    of that wide range, so no row is compared with all bounds of its group and no
    list holds them.  Positions are exact whatever the sample, because each range
    adds the size of those before it.  An ordinary group has no bound and stays
    whole.
    """
    group = list(group)
    w_ = F.col(weight) if weight else F.lit(1).cast("long")
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("_key", key)

    def below(bounds: str) -> Column:
        return F.when(F.col(bounds).isNull(), 0).otherwise(
            F.size(F.filter(bounds, lambda b: b < F.col("_key")))).cast("long")

    # Sampled rows only reach the lists, so the aggregates stay small.
    sample = keyed.withColumn("_hash", F.xxhash64(*order)).filter(
        F.pmod("_hash", F.lit(one_in)) == 0).select(*group, "_key", "_hash")
    listed = F.sort_array(F.collect_list("_key"))
    top = sample.filter(F.pmod("_hash", F.lit(one_in * WIDE)) == 0).groupBy(*group).agg(listed.alias("_top"))
    fine = (
        sample.join(top, group, "left").withColumn("_wide", below("_top"))
        .groupBy(*group, "_wide").agg(listed.alias("_keys"))
        .select(*group, "_wide", F.filter("_keys", lambda _k, i: i % 8 == 7).alias("_bounds"))
    )
    ranged = (
        keyed.join(top, group, "left").withColumn("_wide", below("_top")).drop("_top")
        .join(fine, [*group, "_wide"], "left")
        .withColumn("_range", F.struct("_wide", below("_bounds").alias("_narrow"))).drop("_bounds", "_wide")
    )
    whole = Window.partitionBy(*group)
    before = (
        ranged.groupBy(*group, "_range").agg(F.sum(w_).alias("_rw"))
        .select(
            *group, "_range", F.sum("_rw").over(whole).alias("_w"),
            F.coalesce(F.sum("_rw").over(
                whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
            ), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    res = (
        ranged.withColumn(out, F.sum(w_).over(inside))
        .join(before, [*group, "_range"])
        .withColumn(out, (F.col(out) + F.col("_before")).cast("long"))
    )
    if total:
        res = res.withColumn(total, F.col("_w"))
    return res.drop("_range", "_before", "_key", "_w")


def rank_score(rank, n, mode: str) -> Column:
    """Rank conventions: ``pct_half`` (r-1)/(n-1), 0.5 alone; ``pct_zero`` same, 0
    alone; ``open`` r/(n+1); ``centred`` r/(n+1)-0.5; ``pos`` pos/(n-1), 0 alone."""
    r, c = F.col(rank) if isinstance(rank, str) else rank, F.col(n) if isinstance(n, str) else n
    if mode == "pct_half":
        return F.when(c > 1, (r - 1.0) / (c - 1.0)).otherwise(F.when(r.isNotNull(), F.lit(0.5)))
    if mode in ("pct_zero", "pos"):
        return F.when(c > 1, (r - 1.0) / (c - 1.0)).otherwise(F.when(r.isNotNull(), F.lit(0.0)))
    if mode == "open":
        return r / (c + 1.0)
    if mode == "centred":
        return r / (c + 1.0) - 0.5
    raise ValueError(f"unknown rank mode {mode!r}")


def percentile_rank(
    df: DataFrame, group: Sequence[str], value: str, mode: str = "pct_half",
    out: str = "rank_pct", tie: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Percentile rank of ``value`` in its group under one of five conventions."""
    if mode == "pos":
        known = df.filter(F.col(value).isNotNull())
        placed = position(
            known, group, [F.col(value), *[F.col(t) for t in tie]], out="__r", total="__r_n"
        )
    else:
        placed = average_rank(df, group, value, out="__r")
    return placed.withColumn(out, rank_score("__r", "__r_n", mode)).drop("__r", "__r_n")


def percentile_ranks(
    df: DataFrame, group: Sequence[str], columns: Mapping[str, str], mode: str = "pct_half", whole: bool = False,
) -> DataFrame:
    """Percentile ranks of several columns, each computed on ``df`` itself.

    The ranks are tables of distinct values joined back one after another, so
    the plan grows by one branch per column.  ``whole``: the groups are known to
    be small enough for plain windows, which share one shuffle.
    """
    group = list(group)
    if whole:
        outs = {}
        for out, value in columns.items():
            known = [*group, F.col(value).isNull()]
            score = rank_score(tied_rank(known, value), F.count(F.lit(1)).over(Window.partitionBy(*known)), mode)
            outs[out] = F.when(F.col(value).isNotNull(), score)
        return df.withColumns(outs)
    res = df
    for out, value in columns.items():
        ranks = value_ranks(df, group, value, "__r", "__n").select(
            *group, value, rank_score("__r", "__n", mode).alias(out))
        res = res.join(ranks, [*group, value], "left")
    return res


def equal_buckets(
    df: DataFrame, group: Sequence[str], value: str, k: int,
    out: str = "bucket", tie: Sequence[str] = ("symbol",), whole: bool = False,
) -> DataFrame:
    """Equal-count buckets 0..k-1 by ``floor(k * pos / n)``; ties by symbol.

    ``whole``: the groups are known to be small enough for plain windows.
    """
    if whole:
        w = Window.partitionBy(*group)
        placed = df.withColumns({"_p": F.row_number().over(w.orderBy(value, *tie)), "_p_n": F.count(F.lit(1)).over(w)})
    else:
        placed = position(df, group, [F.col(value), *[F.col(t) for t in tie]], out="_p", total="_p_n")
    return placed.withColumn(
        out, F.floor(F.lit(k) * (F.col("_p") - 1) / F.col("_p_n")).cast("int")
    ).drop("_p", "_p_n")


def slice_deciles(
    df: DataFrame, group: Sequence[str], value: str, k: int = 10,
    out: str = "decile", tie: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Decile d (1..k) holds positions [(d-1)n//k, dn//k); ties by symbol."""
    placed = position(df, group, [F.col(value), *[F.col(t) for t in tie]], out="_p", total="_p_n")
    return placed.withColumn(
        out, F.ceil(F.lit(k) * F.col("_p") / F.col("_p_n")).cast("int")
    ).drop("_p", "_p_n")


def quintile(pct) -> Column:
    p = F.col(pct) if isinstance(pct, str) else pct
    return F.least(F.lit(5), F.floor(p * 5.0) + 1).cast("int")


def _moment_solver(n: int, passes: Sequence[tuple[Sequence[int], Sequence[int]]], tolerance: float):
    """Gram-Schmidt on packed moment matrices, one row per group.

    ``passes`` holds (exposure positions, value positions).  Returns, per value of
    each pass, its coefficients, R2, residual deviation and kept exposures.
    """
    spec = [(list(e), list(v)) for e, v in passes]

    def solve(packed: pd.Series) -> pd.Series:
        import numpy as np
        import pandas

        flat = np.array([np.asarray(r, dtype=float) for r in packed]).reshape(len(packed), -1)
        g = np.zeros((len(flat), n, n))
        upper = np.triu_indices(n)
        g[:, upper[0], upper[1]] = flat
        g = g + np.transpose(np.triu(g, 1), (0, 2, 1))
        parts = []
        for ex, values in spec:
            k, cols = len(ex), ex + values
            u = np.zeros((len(g), k, k + len(values)))
            a = np.zeros_like(u)
            kept = np.zeros((len(g), k), dtype=bool)
            for j in range(k):
                u[:, j] = g[:, ex[j], :][:, cols] - np.einsum("ri,rit->rt", a[:, :j, j], u[:, :j])
                norm = u[:, j, j]
                kept[:, j] = norm > np.maximum(tolerance**2, 1e-12 * g[:, ex[j], ex[j]])
                safe = np.where(kept[:, j], norm, 1.0)
                a[:, j] = np.where(kept[:, j, None], u[:, j] / safe[:, None], 0.0)
            for v, y in enumerate(values):
                coef = a[:, :, k + v].copy()
                for j in reversed(range(k)):
                    coef[:, j] -= np.einsum("ri,ri->r", a[:, j, j + 1:k], coef[:, j + 1:])
                explained = (a[:, :, k + v] * u[:, :, k + v]).sum(axis=1)
                total = g[:, y, y]
                with np.errstate(divide="ignore", invalid="ignore"):
                    share = np.where(total > 0, np.clip(explained / total, 0.0, 1.0), np.nan)
                left = np.sqrt(np.maximum(0.0, total - explained))
                parts.append(np.column_stack([coef, share, left, kept.sum(axis=1)]))
        return pandas.Series(list(np.hstack(parts)))

    return F.pandas_udf(solve, "array<double>")


def residualise(
    df: DataFrame,
    group: Sequence[str],
    models: Mapping[str, tuple[str, Sequence[str]]],
    r2: bool = False,
    sd: bool = False,
    rank: bool = False,
    tolerance: float = 1e-10,
) -> DataFrame:
    """Residuals of each model ``output -> (value, exposures)`` with an intercept.

    One JVM-side aggregate collects means and covariances for all models
    together.  The small moment matrix of a group is then solved (a Pandas UDF
    over one row per group, the only Python here), dropping an exposure that
    earlier ones explain, and each row gets
    ``value - mean - coefficients * (exposure - mean)``.  Inputs must not be NULL.
    ``r2``/``sd``/``rank`` add ``<output>_r2``, the residual deviation
    ``<output>_sd`` and the number of exposures kept.
    """
    group = list(group)
    xs = list(dict.fromkeys(x for _, ex in models.values() for x in ex))
    ys = list(dict.fromkeys(v for v, _ in models.values()))
    cols = [*xs, *[y for y in ys if y not in xs]]
    at = {c: i for i, c in enumerate(cols)}
    passes: dict[tuple[str, ...], list[str]] = {}
    for value, ex in models.values():
        known = passes.setdefault(tuple(ex), [])
        if value not in known:
            known.append(value)
    solver = _moment_solver(
        len(cols), [([at[x] for x in ex], [at[v] for v in vs]) for ex, vs in passes.items()], tolerance
    )
    pairs = [
        F.covar_pop(c, cols[j]) for i, c in enumerate(cols) for j in range(i, len(cols))
    ]
    stats = df.groupBy(*group).agg(
        F.array(*[F.avg(c) for c in cols]).alias("_means"), F.array(*pairs).alias("_moments")
    ).withColumn("_fit", solver("_moments")).drop("_moments")
    start, offset = {}, 0
    for ex, vs in passes.items():
        for v in vs:
            start[tuple(ex), v] = offset
            offset += len(ex) + 3
    back = df.join(stats, group)
    outs = {}
    for o, (value, ex) in models.items():
        s = start[tuple(ex), value]
        e = F.col(value) - F.col("_means")[at[value]]
        for j, x in enumerate(ex):
            e = e - F.col("_fit")[s + j] * (F.col(x) - F.col("_means")[at[x]])
        outs[o] = e
        share = F.col("_fit")[s + len(ex)]
        if r2:
            outs[f"{o}_r2"] = F.when(~F.isnan(share), share)
        if sd:
            outs[f"{o}_sd"] = F.col("_fit")[s + len(ex) + 1]
        if rank:
            outs[f"{o}_rank"] = F.col("_fit")[s + len(ex) + 2].cast("int")
    keep = [c for c in df.columns if c not in outs]
    return back.select(*keep, *[e.alias(n) for n, e in outs.items()])


def pearson(df: DataFrame, group: Sequence[str], a: str, b: str, out: str = "ic", minimum: int = 3):
    """Correlation per group, NULL below ``minimum`` pairs or without spread."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = both.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop(a).alias("_sa"), F.stddev_pop(b).alias("_sb"),
        F.covar_pop(a, b).alias("_cov"),
    )
    ok = (F.col("n") >= minimum) & (F.col("_sa") > 0) & (F.col("_sb") > 0)
    return g.select(
        *group, "n", F.when(ok, F.col("_cov") / (F.col("_sa") * F.col("_sb"))).alias(out)
    )


def rank_ic(df: DataFrame, group: Sequence[str], a: str, b: str, out: str = "ic", minimum: int = 3):
    """Spearman correlation with average ties per group."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*group, a, b)
    ra = value_ranks(both, group, a, "_ra", "_na").drop("_na")
    rb = value_ranks(both, group, b, "_rb", "_nb").drop("_nb")
    ranked = both.join(ra, [*group, a]).join(rb, [*group, b])
    return pearson(ranked, group, "_ra", "_rb", out, minimum)


def tail_spread(
    df: DataFrame, group: Sequence[str], score: str, target: str,
    width: float = 0.1, out: str = "spread", tie: Sequence[str] = ("symbol",),
) -> DataFrame:
    """Mean target of the top minus the bottom ``max(1, floor(n * width))`` names."""
    both = df.filter(F.col(score).isNotNull() & F.col(target).isNotNull())
    placed = position(both, group, [F.col(score), *[F.col(t) for t in tie]], out="_p", total="_n")
    side = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(width)))
    return placed.groupBy(*group).agg(
        F.avg(F.when(F.col("_p") > F.col("_n") - side, F.col(target))).alias("top"),
        F.avg(F.when(F.col("_p") <= side, F.col(target))).alias("bottom"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn(out, F.col("top") - F.col("bottom"))
