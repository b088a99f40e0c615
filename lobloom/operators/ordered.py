"""Ordered operators over long event groups.

One stock-day may hold a large share of all rows, so nothing here puts a whole
group in one window.  Rows are cut into chunks of ``span`` consecutive row ids;
each chunk is scanned on its own and receives what precedes it from one summary
row per chunk.  With ``span=None`` a plain window is used, for groups whose size
is bounded by construction (for example one row per trading day) or was counted
(:func:`span_of`); it reads its input once and shares the sort of its neighbours.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 65536
SESSION = ("symbol", "date", "session")


def span_of(df: DataFrame, keys: Sequence[str] = SESSION, span: int = SPAN) -> int | None:
    """``None`` (plain windows) where no group of ``df`` has more than ``span`` rows, else ``span``.

    One count per group is run for it, so ``df`` should be a table.
    """
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return None if (most or 0) <= span else span


def carry_forward(
    df: DataFrame,
    keys: Sequence[str] = SESSION,
    order: str = "row_id",
    last: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    inclusive: bool = False,
    span: int | None = SPAN,
    backward: bool = False,
) -> DataFrame:
    """Add running values over ``keys`` in ``order``.

    ``last``: latest non-NULL value; ``sums``/``maxs``: running sum/maximum.
    The current row counts only when ``inclusive``.  ``backward`` scans from the
    end, so ``last`` becomes "next non-NULL value".
    """
    last, sums, maxs = dict(last or {}), dict(sums or {}), dict(maxs or {})
    keys = list(keys)
    edge = 0 if inclusive else -1
    by = F.col(order).desc() if backward else F.col(order).asc()

    def frame(part, ordering, end):
        return Window.partitionBy(*part).orderBy(ordering).rowsBetween(
            Window.unboundedPreceding, end
        )

    if span is None:
        w = frame(keys, by, edge)
        out = {n: F.last(c, ignorenulls=True).over(w) for n, c in last.items()}
        out |= {n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in sums.items()}
        out |= {n: F.max(c).over(w) for n, c in maxs.items()}
        return df.withColumns(out)

    chunked = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(span)).cast("long"))
    pick = F.min_by if backward else F.max_by
    aggs = [
        pick(c, F.when(c.isNotNull(), F.col(order))).alias(f"_s_{n}") for n, c in last.items()
    ]
    aggs += [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    aggs += [F.max(c).alias(f"_s_{n}") for n, c in maxs.items()]
    summary = chunked.groupBy(*keys, "_chunk").agg(*aggs)
    cby = F.col("_chunk").desc() if backward else F.col("_chunk").asc()
    cw = frame(keys, cby, -1)
    carry = summary.select(
        *keys,
        "_chunk",
        *[F.last(f"_s_{n}", ignorenulls=True).over(cw).alias(f"_c_{n}") for n in last],
        *[F.sum(f"_s_{n}").over(cw).alias(f"_c_{n}") for n in sums],
        *[F.max(f"_s_{n}").over(cw).alias(f"_c_{n}") for n in maxs],
    )
    w = frame([*keys, "_chunk"], by, edge)
    local = chunked.withColumns(
        {f"_l_{n}": F.last(c, ignorenulls=True).over(w) for n, c in last.items()}
        | {f"_l_{n}": F.sum(c).over(w) for n, c in sums.items()}
        | {f"_l_{n}": F.max(c).over(w) for n, c in maxs.items()}
    )
    joined = local.join(carry, [*keys, "_chunk"], "left")
    out = {n: F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in last}
    out |= {
        n: F.coalesce(F.col(f"_l_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))
        for n in sums
    }
    out |= {n: F.greatest(F.col(f"_l_{n}"), F.col(f"_c_{n}")) for n in maxs}
    helpers = ["_chunk", *[f"_{p}_{n}" for n in (*last, *sums, *maxs) for p in "lc"]]
    return joined.withColumns(out).drop(*helpers)


def dense_order(
    df: DataFrame, keys: Sequence[str] = SESSION, order: str = "row_id",
    out: str = "seq", span: int | None = SPAN,
) -> DataFrame:
    """1-based position of every row inside its group."""
    return carry_forward(
        df, keys, order, sums={out: F.lit(1).cast("long")}, inclusive=True, span=span
    )


def shift_dense(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    shifts: Mapping[str, tuple[Column, int]],
    span: int | None = SPAN,
) -> DataFrame:
    """Add ``value`` taken ``k`` rows ahead (k > 0) or behind (k < 0).

    Needs a dense ``seq``.  Each chunk gets copies of the few neighbouring rows
    it looks at, so chunks stay independent.
    """
    keys = list(keys)
    if span is None:
        w = Window.partitionBy(*keys).orderBy(seq)
        return df.withColumns({n: F.lead(v, k).over(w) if k > 0 else F.lag(v, -k).over(w) for n, (v, k) in shifts.items()})
    ahead = max([k for _, k in shifts.values() if k > 0], default=0)
    behind = max([-k for _, k in shifts.values() if k < 0], default=0)
    if max(ahead, behind) >= span:
        raise ValueError("span must exceed the largest shift")
    pos = F.col(seq) - 1
    home = F.floor(pos / F.lit(span)).cast("long")
    spot = F.pmod(pos, F.lit(span))
    homes = F.array_compact(
        F.array(
            home,
            F.when(spot < ahead, home - 1) if ahead else F.lit(None).cast("long"),
            F.when(spot >= span - behind, home + 1) if behind else F.lit(None).cast("long"),
        )
    )
    spread = df.withColumn("_home", home).withColumn("_chunk", F.explode(homes))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    cols = {}
    for name, (value, k) in shifts.items():
        cols[name] = F.lead(value, k).over(w) if k > 0 else F.lag(value, -k).over(w)
    return (
        spread.withColumns(cols)
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_home", "_chunk")
    )


def rolling_dense(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    size: int,
    aggs: Mapping[str, Column],
    span: int = SPAN,
    inclusive: bool = False,
) -> DataFrame:
    """Aggregates over the ``size`` rows before the current one, or up to it."""
    keys = list(keys)
    if size >= span:
        raise ValueError("span must exceed the frame")
    pos = F.col(seq) - 1
    home = F.floor(pos / F.lit(span)).cast("long")
    homes = F.array_compact(
        F.array(home, F.when(F.pmod(pos, F.lit(span)) >= span - size, home + 1))
    )
    w = (
        Window.partitionBy(*keys, "_chunk").orderBy(seq).rowsBetween(
            1 - size if inclusive else -size, 0 if inclusive else -1)
    )
    return (
        df.withColumn("_home", home)
        .withColumn("_chunk", F.explode(homes))
        .withColumns({n: a.over(w) for n, a in aggs.items()})
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_home", "_chunk")
    )


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: str, payload: Sequence[str]
) -> DataFrame:
    """One row per key: the payload of its smallest ``order``.

    A combinable aggregate instead of ``row_number() = 1``, so a hot key is
    reduced before the shuffle.
    """
    best = F.min_by(F.struct(*payload), F.col(order)).alias("_b")
    return df.groupBy(*keys).agg(F.min(order).alias(order), best).select(
        *keys, order, *[F.col(f"_b.{p}").alias(p) for p in payload if p != order]
    )


def flag_first(
    df: DataFrame, key: Sequence[Column | str], order: str = "row_id", out: str = "is_first"
) -> DataFrame:
    """Flag the first row per key; rows with a NULL in the key are all first.

    The winners come from a pre-aggregated ``min``, then join back on the key
    and row, so neither NULLs nor hot keys gather in one window.
    """
    named = df
    names = []
    for i, k in enumerate(key):
        name = k if isinstance(k, str) else f"_k{i}"
        if not isinstance(k, str):
            named = named.withColumn(name, k)
        names.append(name)
    known = F.lit(True)
    for n in names:
        known = known & F.col(n).isNotNull()
    firsts = (
        named.filter(known).groupBy(*names).agg(F.min(order).alias(order))
        .withColumn("_first", F.lit(True))
    )
    joined = named.join(firsts, [*names, order], "left")
    return joined.withColumn(
        out, F.coalesce(F.col("_first"), F.lit(False)) | ~known
    ).drop("_first", *[n for n in names if n.startswith("_k")])
