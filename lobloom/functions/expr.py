"""Column expressions for event normalisation (all JVM-side, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Exchange clock (HHMMSSmmm) and factor windows.
AM_OPEN, AM_CLOSE = 93000000, 113000000
PM_OPEN, PM_CLOSE = 130000000, 145700000
WINDOWS = {
    "daily_0930_close": (93000000, 145700000),
    "daily_1000_close": (100000000, 145700000),
    "intraday_1000_1030": (100000000, 103000000),
}
PRICE_SCALE = 10000.0


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num, den) -> Column:
    """``num / den`` in doubles; NULL when the denominator is zero or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def session_of(time="time") -> Column:
    t = col(time)
    return F.when((t >= AM_OPEN) & (t < AM_CLOSE), "AM").when(
        (t >= PM_OPEN) & (t < PM_CLOSE), "PM"
    )


def in_session(time="time") -> Column:
    t = col(time)
    return ((t >= AM_OPEN) & (t < AM_CLOSE)) | ((t >= PM_OPEN) & (t < PM_CLOSE))


def in_window(start: int, end: int, time="time") -> Column:
    t = col(time)
    return (t >= F.lit(start)) & (t < F.lit(end))


def clock_ms(time="time") -> Column:
    """HHMMSSmmm -> milliseconds since midnight."""
    t = col(time).cast("long")
    hours = F.floor(t / 10000000)
    minutes = F.floor(t / 100000) % 100
    seconds = F.floor(t / 1000) % 100
    return (((hours * 60 + minutes) * 60 + seconds) * 1000 + t % 1000).cast("long")


def clock_seconds(time="time") -> Column:
    return clock_ms(time) / 1000.0


def best(side: str, ladder: str | None = None) -> Column:
    """Best price of a ladder, NULL for an empty one."""
    return F.try_element_at(F.col(ladder or f"{side}_px"), F.lit(1))


def book_ok(mode: str = "strict", bid=None, ask=None) -> Column:
    """Book validity: ``nonempty`` | ``strict`` (ask > bid) | ``locked_ok``."""
    b = best("bid") if bid is None else col(bid)
    a = best("ask") if ask is None else col(ask)
    present = b.isNotNull() & a.isNotNull()
    if mode == "nonempty":
        return present
    if mode == "strict":
        return F.coalesce(present & (b > 0) & (a > b), F.lit(False))
    if mode == "locked_ok":
        return F.coalesce(present & (b > 0) & (a >= b), F.lit(False))
    raise ValueError(f"unknown book mode {mode!r}")


def book_state(bid, ask) -> Column:
    """missing / locked / crossed / valid."""
    b, a = col(bid), col(ask)
    return (
        F.when(b.isNull() | a.isNull() | (b <= 0) | (a <= 0), "missing")
        .when(b == a, "locked")
        .when(b > a, "crossed")
        .otherwise("valid")
    )


def depth(ladder: str, levels: int) -> Column:
    """Summed volume of the first ``levels`` levels; NULL for a shorter ladder."""
    arr = F.col(ladder)
    total = F.aggregate(F.slice(arr, 1, levels), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(F.size(arr) >= levels, total)


def own_side_id(side="source_side") -> Column:
    """Order id on the event's own side (the aggressor of a TRADE)."""
    s = col(side)
    return F.when(s == "B", F.col("source_buy_order_id")).when(
        s == "S", F.col("source_sell_order_id")
    )


def other_side_id(side="source_side") -> Column:
    """Order id on the opposite side (the resting order of a TRADE)."""
    s = col(side)
    return F.when(s == "B", F.col("source_sell_order_id")).when(
        s == "S", F.col("source_buy_order_id")
    )


def opposite(side="source_side") -> Column:
    s = col(side)
    return F.when(s == "B", "S").when(s == "S", "B")


def half_hour_bucket(time="time") -> Column:
    """AM00..AM03 and PM00..PM03."""
    ms = clock_ms(time)
    am = F.floor((ms - 34200000) / 1800000).cast("int")
    pm = F.floor((ms - 46800000) / 1800000).cast("int")
    s = session_of(time)
    return F.when(s == "AM", F.format_string("AM%02d", am)).when(
        s == "PM", F.format_string("PM%02d", pm)
    )


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def sum_if(value, cond: Column) -> Column:
    return F.sum(F.when(cond, col(value)))


def sum0(value, cond: Column | None = None) -> Column:
    v = col(value) if cond is None else F.when(cond, col(value))
    s = F.sum(v)
    return F.coalesce(s, F.lit(0).cast("long"))


def log_ratio(num, den) -> Column:
    """ln(num) - ln(den), NULL unless both are positive."""
    n, d = col(num), col(den)
    return F.when((n > 0) & (d > 0), F.ln(n.cast("double")) - F.ln(d.cast("double")))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """``;``-joined labels of the conditions that hold."""
    return F.concat_ws(";", *[F.when(cond, F.lit(name)) for cond, name in pairs])


def sign(x) -> Column:
    v = col(x)
    return F.when(v > 0, 1).when(v < 0, -1).otherwise(0)


def logit(p, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), col(p)))
    return F.ln(q / (1.0 - q))


def smoothstep(x) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(x)))
    return t * t * (3.0 - 2.0 * t)


def domain_of(cap, price, symbol="symbol") -> Column:
    """Nine cap x price/board domains; STAR names below 10 have none.

    Fixed values: cap cuts 500,000 and 5,000,000 (10k-CNY units), price cut 10.
    """
    c, p, s = col(cap), col(price), col(symbol)
    size = F.when(c < 500000, "low").when(c < 5000000, "mid").when(c >= 5000000, "high")
    star = s.startswith("SH688")
    part = (
        F.when(~star & (p < 10), "lt10")
        .when(~star & (p >= 10), "ge10")
        .when(star & (p >= 10), "star")
    )
    return F.when(c.isNotNull() & p.isNotNull(), F.concat(size, F.lit("_"), part))


def tradable(
    category="security_category", st="is_st", suspended="is_suspended",
    listed="listing_days", liquid="liquidity_history_days",
) -> Column:
    """Universe predicate for stock-days."""
    return (
        (col(category) == 1)
        & (col(st) == 0)
        & (col(suspended) == 0)
        & (col(listed) >= 10)
        & (col(liquid) >= 20)
    )
