"""Own-history operators over one row per symbol and day.

A series is bounded by the number of trading days (at most a few thousand), so
plain windows by symbol are safe here.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.functions.expr import sign


def _past(keys: Sequence[str], order: str, n: int):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(-n, -1)


def lagged_z_and_rank(
    df: DataFrame, keys: Sequence[str], value: str, lookback: int = 60, minimum: int = 20,
    order: str = "date", prefix: str = "history",
) -> DataFrame:
    """z-score and mid-rank of the value against its own previous observations."""
    w = _past(keys, order, lookback)
    v, n = F.col(value), F.col(f"{prefix}_n")
    past = df.withColumns({
        f"{prefix}_n": F.count(value).over(w),
        "_m": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w),
        "_h": F.collect_list(value).over(w),
    })
    below = F.size(F.filter("_h", lambda x: x < v))
    same = F.size(F.filter("_h", lambda x: x == v))
    enough = n >= minimum
    return past.withColumns({
        f"{prefix}_z": F.when(
            enough, F.when(F.col("_s") > 0, (v - F.col("_m")) / F.col("_s")).otherwise(0.0)
        ),
        f"{prefix}_rank": F.when(enough, (below + 0.5 * same) / n),
    }).drop("_m", "_s", "_h")


def ewma_of(values: Column, span: int) -> Column:
    """EWMA of an ordered array, seeded with its first element."""
    a = 2.0 / (span + 1.0)
    return F.aggregate(
        values, F.lit(None).cast("double"),
        lambda s, x: F.when(s.isNull(), x).otherwise(F.lit(a) * x + F.lit(1.0 - a) * s),
    )


def surprise(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], length: int = 60,
    order: str = "date",
) -> DataFrame:
    """(x - EWMA of the last ``length`` own values) / their deviation; strictly lagged."""
    w = _past(keys, order, length)
    for out, c in columns.items():
        df = df.withColumns({
            "_h": F.collect_list(c).over(w), "_s": F.stddev_pop(c).over(w),
        }).withColumn(
            out,
            F.when(
                F.size("_h") >= length,
                F.when(F.col("_s") > 0, (F.col(c) - ewma_of(F.col("_h"), length)) / F.col("_s")).otherwise(0.0),
            ),
        ).drop("_h", "_s")
    return df


EWMA_CHUNK = 64


def recursive_ewma(df: DataFrame, keys: Sequence[str], value: str, span: int, out: str, order: str = "date") -> DataFrame:
    """EWMA over the whole series, seeded with its first value; a missing value leaves it as it is.

    Each step is an affine map of the last state, s -> keep * s + a * x, and affine
    maps compose. A series is cut into chunks of ``EWMA_CHUNK`` values: inside a
    chunk the composed map is a running sum of values scaled to the chunk's start;
    what comes before is the composition of the chunks before, a list of one pair
    of numbers per chunk.
    """
    a = 2.0 / (span + 1.0)
    if a >= 1.0:  # a span of one keeps the last value only
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(F.col(value).cast("double"), ignorenulls=True).over(w))
    keep, chunk = 1.0 - a, min(EWMA_CHUNK, max(1, int(600 / -math.log2(1.0 - a))))
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.greatest(F.col("_n") - 1, F.lit(0))
    step = F.pmod(at, F.lit(chunk))
    part = F.when(F.col("_n") == 1, F.col(value)).otherwise(F.lit(a) * F.col(value)) * F.pow(F.lit(keep), -F.col("_step"))
    rows = df.withColumn("_n", F.count(value).over(upto)).withColumns({"_chunk": F.floor(at / chunk), "_step": step.cast("double")})
    rows = rows.withColumn("_own", F.sum(F.when(F.col(value).isNotNull(), part)).over(inside) * F.pow(F.lit(keep), "_step"))
    whole = rows.groupBy(*keys, "_chunk").agg(
        F.max_by("_own", "_n").alias("_end"), F.pow(F.lit(keep), F.max("_step") + 1).alias("_left"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*keys, "_chunk", F.aggregate(
        F.collect_list(F.struct("_left", "_end")).over(before), F.lit(0.0), lambda s, c: c["_left"] * s + c["_end"]).alias("_carry"))
    return rows.join(carried, [*keys, "_chunk"]).withColumn(
        out, F.when(F.col("_n") > 0, F.coalesce("_own", F.lit(0.0)) + F.pow(F.lit(keep), F.col("_step") + 1) * F.col("_carry"))
    ).drop("_n", "_chunk", "_step", "_own", "_carry")


def persistence(df: DataFrame, keys: Sequence[str], value: str, prefix: str, order: str = "date", n: int = 5) -> DataFrame:
    """Sum and same-sign count of the last ``n`` values, and the same-sign run length."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = w.rowsBetween(-(n - 1), 0)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("_sign")
    marked = df.withColumn("_sign", sign(value)).withColumn(
        "_new", (~F.lag("_sign").over(w).eqNullSafe(s)).cast("int")
    ).withColumns({
        "_run": F.sum("_new").over(upto),
        "_cnt": F.count(value).over(last),
        "_signs": F.collect_list("_sign").over(last),
    })
    run = Window.partitionBy(*keys, "_run").orderBy(order)
    return marked.withColumns({
        f"{prefix}_persistence_{n}": F.when(F.col("_cnt") == n, F.sum(value).over(last)),
        f"{prefix}_same_sign_count_{n}": F.when(
            (F.col("_cnt") == n) & (s != 0), F.size(F.filter("_signs", lambda x: x == s))
        ),
        f"{prefix}_same_sign_run_length": F.when(s != 0, F.row_number().over(run)),
    }).drop("_sign", "_new", "_run", "_cnt", "_signs")


def hysteresis(
    df: DataFrame, keys: Sequence[str], enter: Column, stay: Column, out: str = "held", order: str = "date"
) -> DataFrame:
    """Membership that starts on ``enter`` and lasts while ``stay`` holds.

    Needs a dense series per key; a missing day is a row with both false.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumns({
        "_stay": F.coalesce(stay, F.lit(False)), "_enter": F.coalesce(enter, F.lit(False)),
    }).withColumn("_isle", F.sum((~F.col("_stay")).cast("int")).over(w))
    isle = Window.partitionBy(*keys, "_isle").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    since = F.max(F.col("_enter") & F.col("_stay")).over(isle)
    return marked.withColumn(out, F.col("_stay") & F.coalesce(since, F.lit(False))).drop(
        "_stay", "_enter", "_isle"
    )
