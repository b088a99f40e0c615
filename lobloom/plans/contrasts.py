"""Contrast tables of the mechanism study, driven by a table of definitions.

A definition names the two legs of a contrast: a variant, and either the whole
group key or texts that the key must contain.  Statistics meet the definitions
in one broadcast join (their number is fixed by the rules below, whatever the
data), so all contrasts of a study share one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lobloom.operators.lifecycle import DAY

KEY = ["domain", "mechanism", "contrast"]


class Leg(NamedTuple):
    """One side: its name in the output, the variant, the key or texts in it."""

    label: str
    variant: str
    exact: str | None = None
    parts: tuple[str, ...] = ()


class Contrast(NamedTuple):
    mechanism: str
    name: str
    left: Leg
    right: Leg


def state_contrasts(horizon: int = 10, profile: str = "hl5", trade_profile: str = "teh20") -> list[Contrast]:
    """M1 to M4 and M6 on both clocks: the same stock-day on either side."""
    out = []
    for lead, prefix, clock in (("", "", profile), ("trade_event_", f"{trade_profile}_", trade_profile)):
        def leg(label, variant, *parts, pre=prefix):
            return Leg(label, f"{pre}{variant}", None, parts)

        heat = f"n{horizon}_delta_heat"
        flow = f"n{horizon}_future_signed_volume"
        up, down = "price=up|trigger=B", "price=down|trigger=S"
        out += [
            Contrast("M1", f"{lead}buy_vs_sell_same_direction_persistence", leg("trigger=B", flow, "trigger=B"), leg("trigger=S", flow, "trigger=S")),
            Contrast("M2", f"{lead}up_buy_vs_down_sell_delta_heat", leg(up, heat, up), leg(down, heat, down)),
            Contrast("M3", f"{lead}buy_up_vs_buy_non_up_delta_heat",
                     Leg("buy_up", prefix + heat, "buy_up"), Leg("buy_non_up", prefix + heat, "buy_non_up")),
            Contrast("M4", f"{lead}buy_high_vs_low_ask_depth",
                     Leg("B1", f"{clock}_log_depth3_ask", None, ("state=B1",)), Leg("B0", f"{clock}_log_depth3_ask", None, ("state=B0",))),
            Contrast("M4", f"{lead}sell_high_vs_low_bid_depth",
                     Leg("S1", f"{clock}_log_depth3_bid", None, ("S1",)), Leg("S0", f"{clock}_log_depth3_bid", None, ("S0",)))]
        for side, other in (("B", "S"), ("S", "B")):
            at = (f"side={side}", "distance=best")
            for until in ("60s", "continuous"):
                for whose, flag in (("own", side), ("opposite", other)):
                    out.append(Contrast(
                        "M6", f"{lead}{side}_{whose}_high_vs_low_fill_{until}",
                        *[leg(f"{flag}{level}", f"filled_orders_{until}", *at, f"{flag}{level}") for level in (1, 0)]))
    return out


def heat_contrasts(trade_profile: str = "teh20") -> list[Contrast]:
    """M5: depth on days of high and of low activity; a day is one or the other."""
    return [
        Contrast("M5", f"{lead}high_vs_low_heat_depth_{state}",
                 *[Leg(f"{heat}/{state}", f"{prefix}mean_log_total_depth3", f"heat={heat}|state={state}") for heat in ("high", "low")])
        for lead, prefix in (("", ""), ("trade_event_", f"{trade_profile}_"))
        for state in ("all", "B0S0", "B1S0", "B0S1", "B1S1")]


def quote_contrasts(lob_horizons: Sequence[int] = (20, 50), trade_horizons: Sequence[int] = (20, 50)) -> list[Contrast]:
    """M1Q: chains against single trades, sides, and the quotes that follow."""
    out = []
    for p in [f"lob{h}" for h in lob_horizons] + [f"trade{h}" for h in trade_horizons]:
        for metric in ("future_signed_volume", "directional_mid_bps"):
            chain = f"{p}_chain_{metric}"
            out += [
                Contrast("M1Q", f"{p}_chain_minus_raw_{metric}", Leg("chain/all", chain, None, ("chain=all",)), Leg("raw", f"{p}_raw_{metric}")),
                Contrast("M1Q", f"{p}_multi_minus_single_{metric}", Leg("multi", chain, None, ("chain=multi",)), Leg("single", chain, None, ("chain=single",))),
                Contrast("M1Q", f"{p}_chain_buy_minus_sell_{metric}",
                         *[Leg(f"trigger={s}", chain, f"trigger={s}|chain=all") for s in "BS"])]
        for metric in ("future_signed", "mid_bps"):
            for side in "BS":
                for name, left, right in (
                    ("chase_effect_low_replenish", (1, 0), (0, 0)), ("replenish_effect_with_chase", (1, 1), (1, 0)),
                    ("penetration_minus_recovery", (1, 0), (0, 1)),
                ):
                    out.append(Contrast("M1Q", f"{p}_{side}_{name}_{metric}", *[
                        Leg(f"chase={chase}/replenish={rep}", f"{p}_chain_{metric}_by_quote_state", f"trigger={side}|chase={chase}|replenish={rep}|chain=all")
                        for chase, rep in (left, right)]))
    return out


def prepost_contrasts(lob_horizons: Sequence[int] = (20, 50), trade_horizons: Sequence[int] = (20, 50)) -> list[Contrast]:
    """M1PP: flow after a chain minus flow before it, by kind of chain and side."""
    kinds = {k: Leg(k, "", None, (f"chain={k}",)) for k in ("all", "single", "multi")}
    kinds |= {n: Leg(n, "", f"trigger={s}|chain=all") for n, s in (("buy", "B"), ("sell", "S"))}
    return [
        Contrast("M1PP", f"{p}_{n}_post_minus_pre_{metric}",
                 *[k._replace(label=f"{when}/{n}", variant=f"{p}_chain_{when}_{metric}") for when in ("post", "pre")])
        for p in [f"lob{h}" for h in lob_horizons] + [f"trade{h}" for h in trade_horizons]
        for metric in ("signed_volume", "total_volume", "signed_share") for n, k in kinds.items()]


def leg_values(stats: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Mean of each leg of each contrast per domain and stock-day."""
    c = F.col
    rows = [(k.mechanism, k.name, leg, d.variant, d.exact, list(d.parts)) for k in contrasts for leg, d in (("left", k.left), ("right", k.right))]
    legs = stats.sparkSession.createDataFrame(
        rows, "mechanism string, contrast string, leg string, variant string, _exact string, _parts array<string>")
    fits = F.when(c("_exact").isNotNull(), c("group_key") == c("_exact")).otherwise(F.forall("_parts", lambda t: F.contains(c("group_key"), t)))
    # Texts are looked for once in each distinct group key; the rows then meet the legs by equality.
    name = ["mechanism", "variant", "group_key"]
    fit = stats.select(*name).distinct().join(F.broadcast(legs), ["mechanism", "variant"]).filter(fits).groupBy(*name).agg(
        F.collect_list(F.struct("contrast", "leg")).alias("_legs"))  # as many as there are definitions
    fit = F.broadcast(fit.withColumnsRenamed({n: f"_{n}" for n in name}))
    same = [c(n).eqNullSafe(c(f"_{n}")) for n in name]
    return stats.join(fit, same).withColumn("_l", F.explode("_legs")).select(*stats.columns, "_l.*").groupBy(*KEY, "leg", *DAY).agg(
        F.sum("value_sum").alias("s"), F.sum("weight_sum").alias("w")).filter(c("w") > 0).select(
        *KEY, "leg", *DAY, (c("s") / c("w")).alias("v"))


def _mean_t(v: str) -> dict[str, Column]:
    """Mean, t and 95 % interval; equal values have t zero, a single one has none."""
    se = F.when(F.max(v) == F.min(v), 0.0).otherwise(F.stddev_samp(v) / F.sqrt(F.count(v).cast("double")))
    se = F.when(F.count(v) > 1, se)
    return {"mean": F.avg(v), "t": F.when(se == 0, 0.0).otherwise(F.avg(v) / se), "low": F.avg(v) - 1.96 * se, "high": F.avg(v) + 1.96 * se}


def _sides(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both legs of a unit side by side, and their difference."""
    c = F.col
    return values.groupBy(*KEY, *by).agg(*[F.avg(F.when(c("leg") == leg, c("v"))).alias(leg) for leg in ("left", "right")]).withColumn(
        "d", c("left") - c("right"))


def _table(units: DataFrame) -> DataFrame:
    c, m = F.col, _mean_t("d")
    both = c("d").isNotNull()
    return units.groupBy(*KEY).agg(
        F.count("d").alias("stock_days"), F.avg(F.when(both, c("left"))).alias("left_mean"), F.avg(F.when(both, c("right"))).alias("right_mean"),
        m["mean"].alias("difference"), m["t"].alias("difference_t"), m["low"].alias("ci95_lower"), m["high"].alias("ci95_upper"))


def _named(table: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    labels = table.sparkSession.createDataFrame(
        [(k.mechanism, k.name, k.left.label, k.right.label) for k in contrasts],
        "mechanism string, contrast string, left_group string, right_group string")
    return table.join(F.broadcast(labels), ["mechanism", "contrast"]).select(
        *KEY, "left_group", "right_group", "stock_days", "left_mean", "right_mean", "difference", "difference_t", "ci95_lower", "ci95_upper",
        "symbols", "symbol_mean_difference", "symbol_t", "dates", "date_mean_difference", "date_t")


def paired(values: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Left minus right on the same stock-day, also averaged by symbol and by date.

    A contrast that only one leg has in a domain is a row of zero stock-days.
    """
    pairs = _sides(values, DAY)
    out = _table(pairs)
    for unit in ("symbol", "date"):
        m = _mean_t("m")
        g = pairs.groupBy(*KEY, unit).agg(F.avg("d").alias("m")).groupBy(*KEY).agg(
            F.count("m").alias(f"{unit}s"), m["mean"].alias(f"{unit}_mean_difference"), m["t"].alias(f"{unit}_t"))
        out = out.join(g, KEY)
    return _named(out, contrasts)


def within_symbol(values: DataFrame, contrasts: Sequence[Contrast]) -> DataFrame:
    """Days of either kind averaged within a symbol, then left minus right over symbols.

    Pairs are symbols, so ``stock_days`` and ``symbols`` agree and dates are NULL.
    """
    c = F.col
    out = _table(_sides(values, ["symbol"])).withColumns({
        "symbols": c("stock_days"), "symbol_mean_difference": c("difference"), "symbol_t": c("difference_t"), "dates": F.lit(None).cast("long"),
        "date_mean_difference": F.lit(None).cast("double"), "date_t": F.lit(None).cast("double")})
    return _named(out, contrasts)
