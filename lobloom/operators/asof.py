"""As-of lookups: the state of a group at or around a clock time.

Events and probes are first reduced to one row per (group, millisecond), which
bounds a group by the length of a session in milliseconds; the ordered scan is
then cut into time chunks like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobloom.operators.ordered import carry_forward

TIME_SPAN = 60_000


def asof(
    probes: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    probe_time: str,
    event_time: str,
    values: Mapping[str, Column],
    order: str = "row_id",
    direction: str = "forward",
    strict: bool = False,
    span: int | None = TIME_SPAN,
) -> DataFrame:
    """Left as-of join.

    ``forward``: first event at or after the probe time (after it if strict);
    ``backward``: last event at or before it (before it if strict).  Inside one
    millisecond the smallest row id wins going forward, the largest going back.
    """
    keys = list(keys)
    pick = F.min_by if direction == "forward" else F.max_by
    state = F.struct(*[c.alias(n) for n, c in values.items()], F.col(event_time).alias("_t"))
    ticks = events.groupBy(*keys, F.col(event_time).alias("_at")).agg(
        pick(state, F.col(order)).alias("_v")
    )
    wanted = probes.select(*keys, F.col(probe_time).alias("_at")).distinct()
    # Probes sort before or after events of the same millisecond as the rule needs.
    first = (direction == "forward") != strict
    probe_slot, event_slot = (0, 1) if first else (1, 0)
    if direction == "backward":
        probe_slot, event_slot = (0, 1) if strict else (1, 0)
    line = (
        ticks.select(*keys, "_at", F.lit(event_slot).alias("_slot"), "_v")
        .unionByName(
            wanted.select(*keys, "_at", F.lit(probe_slot).alias("_slot")),
            allowMissingColumns=True,
        )
        .withColumn("_line", F.col("_at") * 2 + F.col("_slot"))
    )
    found = (
        carry_forward(
            line, keys, "_line", last={"_hit": F.col("_v")},
            span=None if span is None else span * 2,
            backward=direction == "forward",
        )
        .filter(F.col("_slot") == probe_slot)
        .filter(F.col("_v").isNull())
        .select(*keys, F.col("_at").alias(probe_time), "_hit")
    )
    return probes.join(found, [*keys, probe_time], "left").select(
        *probes.columns,
        *[F.col(f"_hit.{n}").alias(n) for n in values],
        F.col("_hit._t").alias(f"{probe_time}_hit"),
    )
