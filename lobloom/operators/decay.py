"""Exponentially decayed running sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.operators.ordered import SPAN, carry_forward
from lobloom.session import stage

# Values whose weights are taken from their own age; older ones come as one carried sum.
NEAR = 64

# The largest double over the smallest one is below 2^2100.
LASTING = 2_100
# Half-lives of a super-block: values up to 2^120 scaled by them stay finite.
REACH = 900


def decayed_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    clock: str,
    half_life: float,
    values: Mapping[str, Column],
    block: int,
    span: int | None = SPAN,
) -> DataFrame:
    """Sum of earlier and current values, each halved every ``half_life`` of ``clock``.

    Values are scaled to the start of their clock block, so a running sum inside
    the block is enough. What earlier blocks leave is a running sum again: block
    totals are scaled to the start of their super-block, which is as long as a
    double's exponent allows (``REACH`` half-lives), so a decayed total is kept as a
    plain number and a power of two. Of earlier super-blocks only the last few
    count: what is older than ``LASTING`` half-lives has become exactly 0 in a
    step-by-step decay too. Every step is a running sum or a bounded look back.
    ``block / half_life`` must stay well under 1000 to avoid overflow.
    """
    keys = list(keys)
    if block / half_life > REACH:
        raise ValueError("block too long for the half-life")
    b = F.floor(F.col(clock) / F.lit(block)).cast("long")
    tagged = df.withColumn("_block", b)
    up = F.pow(F.lit(2.0), (F.col(clock) - F.col("_block") * block) / F.lit(float(half_life)))
    scaled = {f"_v_{n}": F.coalesce(v, F.lit(0.0)).cast("double") * up for n, v in values.items()}
    tagged = tagged.withColumns(scaled)
    run = carry_forward(
        tagged, [*keys, "_block"], order, sums={f"_r_{n}": F.col(f"_v_{n}") for n in values},
        inclusive=True, span=span)
    many = max(1, int(REACH * half_life / block))  # blocks of a super-block
    halvings = block / half_life
    inside = (F.col("_block") - F.col("_super") * many) * F.lit(halvings)
    totals = tagged.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    totals = totals.withColumn("_super", F.floor(F.col("_block") / many).cast("long"))
    totals = totals.withColumns({f"_t_{n}": F.col(f"_t_{n}") * F.pow(F.lit(2.0), inside) for n in values})
    w = Window.partitionBy(*keys, "_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"_i_{n}": F.coalesce(F.sum(f"_t_{n}").over(w), F.lit(0.0)) for n in values})
    older = math.ceil(LASTING / (many * halvings))
    sums = totals.groupBy(*keys, "_super").agg(*[F.sum(f"_t_{n}").alias(f"_s_{n}") for n in values])
    back = Window.partitionBy(*keys).orderBy("_super").rangeBetween(-older, -1)
    sums = sums.withColumn("_past", F.collect_list(F.struct("_super", *[f"_s_{n}" for n in values])).over(back))

    def left(n):
        return F.aggregate("_past", F.lit(0.0), lambda s, x: s + x[f"_s_{n}"] * F.pow(
            F.lit(2.0), -(F.col("_super") - x["_super"]) * F.lit(many * halvings)))

    sums = sums.select(*keys, "_super", *[left(n).alias(f"_o_{n}") for n in values])
    carry = totals.join(sums, [*keys, "_super"]).select(*keys, "_block", *[
        ((F.col(f"_i_{n}") + F.col(f"_o_{n}")) * F.pow(F.lit(2.0), -inside)).alias(f"_c_{n}") for n in values])
    down = F.pow(F.lit(2.0), -(F.col(clock) - F.col("_block") * block) / F.lit(float(half_life)))
    out = run.join(carry, [*keys, "_block"], "left")
    return out.withColumns({
        n: (F.col(f"_r_{n}") + F.coalesce(f"_c_{n}", F.lit(0.0))) * down for n in values
    }).drop("_block", *[f"_{p}_{n}" for n in values for p in "vrc"])


def decayed_sums_near(
    df: DataFrame,
    keys: Sequence[str],
    number: str,
    counts: Column,
    kinds: Mapping[str, Column],
    value: str,
    decays: Mapping[str, tuple[str, float, int]],
) -> DataFrame:
    """Decayed sums on several clocks and of several kinds, ``<decay>_<kind>``, in one pass.

    ``number`` counts the rows that hold a value (``counts``) up to and including
    each row.  ``decays``: name -> (clock, half-life, block of :func:`decayed_sums`).
    ``NEAR`` consecutive values make a block, which is one list; a row adds those of
    its block up to itself, each weighted by its own age, so equal values of equal
    ages give equal sums wherever they stand on the clock.  What earlier blocks leave
    is a decayed sum over one row per block.
    """
    keys = list(keys)
    c = F.col
    clocks = list(dict.fromkeys(clock for clock, _, _ in decays.values()))
    block = F.floor((c(number) - 1) / F.lit(NEAR)).cast("long")
    held = df.filter(counts).select(
        *keys, block.alias("_nb"), F.struct(
            c(number).alias("_no"), *[c(k).alias(k) for k in clocks], *[F.when(k, c(value)).cast("double").alias(f"v_{n}") for n, k in kinds.items()]).alias("_x"))
    lists = held.groupBy(*keys, "_nb").agg(F.sort_array(F.collect_list("_x")).alias("_near"))
    lists = stage(lists, "near-values")

    def near(upto: Column, kind: str, clock: str, half_life: float, now: Column) -> Column:
        def add(s, x):
            v = x[f"v_{kind}"]
            return F.when((x["_no"] <= upto) & v.isNotNull(), s + v * F.pow(F.lit(2.0), -(now - x[clock]) / F.lit(float(half_life)))).otherwise(s)
        return F.aggregate("_near", F.lit(0.0), add)

    # A block's sums at its last value, decayed on over the blocks, are carried to the next block.
    carry = lists.select(*keys, "_nb").filter("_nb > 0")
    for name, (clock, half_life, width) in decays.items():
        end = F.element_at("_near", -1)
        at_end = lists.select(*keys, "_nb", end[clock].alias("_end"), *[
            near(end["_no"], n, clock, half_life, end[clock]).alias(f"_t_{n}") for n in kinds])
        past = decayed_sums(at_end, keys, "_nb", "_end", half_life, {f"_p_{n}": c(f"_t_{n}") for n in kinds}, width)
        carry = carry.join(past.select(*keys, (c("_nb") + 1).alias("_nb"), F.struct(
            c("_end").alias("at"), *[c(f"_p_{n}").alias(n) for n in kinds]).alias(f"_c_{name}")), [*keys, "_nb"])
    # Only groups of more than one block have a carry.
    rows = df.withColumn("_nb", block).join(lists, [*keys, "_nb"], "left").join(carry, [*keys, "_nb"], "left")
    out = {}
    for name, (clock, half_life, _) in decays.items():
        old = c(f"_c_{name}")
        for n in kinds:
            left = F.coalesce(old[n] * F.pow(F.lit(2.0), -(c(clock) - old["at"]) / F.lit(float(half_life))), F.lit(0.0))
            out[f"{name}_{n}"] = F.coalesce(near(c(number), n, clock, half_life, c(clock)), F.lit(0.0)) + left
    return rows.select(*df.columns, *[e.alias(n) for n, e in out.items()])


def decayed_sums_few(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    counts: Column,
    kinds: Mapping[str, Column],
    value: str,
    decays: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """:func:`decayed_sums_near` for groups of at most ``NEAR`` values: a running list holds them all.

    ``decays``: name -> (clock, half-life).
    """
    c = F.col
    clocks = list(dict.fromkeys(clock for clock, _ in decays.values()))
    x = F.struct(*[c(k).alias(k) for k in clocks], *[F.when(k, c(value)).cast("double").alias(f"v_{n}") for n, k in kinds.items()])
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_near", F.collect_list(F.when(counts, x)).over(upto))

    def total(kind: str, clock: str, half_life: float) -> Column:
        def add(s, v):
            return F.when(v[f"v_{kind}"].isNotNull(), s + v[f"v_{kind}"] * F.pow(F.lit(2.0), -(c(clock) - v[clock]) / F.lit(float(half_life)))).otherwise(s)
        return F.aggregate("_near", F.lit(0.0), add)

    return rows.select(*df.columns, *[total(n, clock, h).alias(f"{name}_{n}") for name, (clock, h) in decays.items() for n in kinds])
