"""Keyed stream operators with their own state: chains, 10:30 signals, late rows.

Rows wait in keyed state (chains in two tables of a bucket, signals in a day's map entry) until the
watermark has passed them; a timer then takes them, minute by minute in row order, and clears them. So
arrival order inside the allowed delay does not matter, and what is held per key is bounded by that
delay. Stock-days are many and small, so chains share buckets: a batch costs calls for each bucket,
not for each stock-day, and rows are taken by columns.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lobloom.functions import expr as X

MINUTE = 60_000
SESSION_END = {"AM": 41_400_000, "PM": 53_820_000}
SIGNAL_FROM_MS, SIGNAL_MS, LABEL_MS = 36_000_000, 37_800_000, 38_400_000
SIDES = [None, "B", "S"]
BUCKETS = 512  # fixed, so that a checkpoint fits whatever the session's settings
_GROUP = ["symbol", "date", "session"]

CHAIN_OUT = ("symbol string, date int, session string, side string, order_id long, volume long, children long, "
             "first_row long, last_row long, first_ms long, last_ms long, status string")
_CHAIN = [c.split()[0] for c in CHAIN_OUT.split(", ")]
SIGNAL_OUT = ("symbol string, date int, buy_30m long, sell_30m long, last_mid double, future_buy_10m long, future_sell_10m long, "
              "future_events long, earlier_rows long")
_SIGNAL = [c.split()[0] for c in SIGNAL_OUT.split(", ")]


def midnight(date: int) -> int:
    """Milliseconds of the start of an integer date."""
    return pd.Timestamp(str(date)).value // 1_000_000


def _traded() -> F.Column:
    return F.coalesce((F.col("source_action") == "TRADE") & (F.col("source_volume") > 0), F.lit(False))


def _table(frame: pd.DataFrame) -> bytes:
    """A frame as bytes for a state value."""
    table, out = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as w:
        w.write_table(table)
    return out.getvalue().to_pybytes()


def _frame(held: bytes | None) -> pd.DataFrame | None:
    return None if held is None else pa.ipc.open_stream(bytes(held)).read_pandas()


def advance(rows: pd.DataFrame, live: pd.DataFrame | None, now: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame]:
    """Takes rows that are final at ``now`` into their groups' chains: (what is emitted, live groups, rows that wait on).

    A live group has one row: its open chain, if ``trade``, its newest row (``done``) and its session's end.
    """
    ready = (rows["at"] // MINUTE + 1) * MINUTE <= now
    t = rows[ready]
    t = t.assign(minute=t["at"] // MINUTE, children=1, opens=False)
    t = t.assign(first_row=t["row_id"], last_row=t["row_id"], first_ms=t["ms"], last_ms=t["ms"], done=t["row_id"]).drop(columns=["row_id", "ms", "at"])
    if live is not None and len(live):
        t = pd.concat([live.assign(minute=-1, opens=True), t], ignore_index=True)
    t["g"] = t.groupby(_GROUP, sort=False, dropna=False).ngroup()
    t = t.iloc[np.lexsort((t["done"], t["minute"], t["g"]))].reset_index(drop=True)
    newest = t.groupby("g")["done"].cummax()
    before = newest.groupby(t["g"]).shift(fill_value=-1)
    t["done"] = newest
    back = ~t["opens"] & (t["first_row"] <= before)
    broken = t[back].assign(status="order_break", order_id=pd.array([None] * int(back.sum()), "Int64"), children=0)
    # A chain is a run of one group's rows in order that are trades of one aggressor.
    t = t[~back].reset_index(drop=True)
    g, trade = t["g"].to_numpy(), t["trade"].to_numpy(bool)
    side, oid = t["side"].to_numpy(), t["oid"].to_numpy()
    start = np.ones(len(t), bool)
    start[1:] = ~((g[1:] == g[:-1]) & trade[1:] & trade[:-1] & (side[1:] == side[:-1]) & (oid[1:] == oid[:-1]))
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(t))[: len(first)] - 1
    runs = t.iloc[first].reset_index(drop=True)
    for name in ("volume", "children"):
        runs[name] = np.add.reduceat(t[name].to_numpy(), first) if len(first) else runs[name]
    for name in ("last_row", "last_ms", "done"):
        runs[name] = t[name].to_numpy()[last]
    runs["open"] = ~runs["g"].duplicated(keep="last")
    over = runs["open"] & (runs["end"] <= now)
    out = runs[runs["trade"].astype(bool) & (~runs["open"] | over)]
    out = out.assign(status=np.where(out["open"], "censored", "closed"), order_id=out["oid"].astype("Int64"))
    stays = runs[runs["open"] & ~over]
    return pd.concat([out, broken], ignore_index=True), stays[_LIVE], rows[~ready]


_LIVE = [*_GROUP, "end", "side", "oid", "trade", "volume", "children", "first_row", "last_row", "first_ms", "last_ms", "done"]


class Chains(StatefulProcessor):
    """Contiguous trades of one aggressor; see :func:`trade_chains`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value: a bucket costs one read, one write and at most two timers a batch.
        self.held = handle.getValueState("held", "waiting binary, live binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, new = self.held.get(), pd.concat(list(rows), ignore_index=True)[_WAITING]
        # The last minute of the batch takes the minutes before it along.
        self.handle.registerTimer((int(new["at"].max()) // MINUTE + 1) * MINUTE)
        self.handle.registerTimer(int(new["end"].min()))
        waiting = _frame(held[0]) if held else None
        if waiting is not None and len(waiting):
            new = pd.concat([waiting, new], ignore_index=True)
        self.held.update((_table(new), held[1] if held else None))
        yield pd.DataFrame(columns=_CHAIN)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        if held is None:
            return
        # Whatever the watermark has passed is final; later timers of this batch find nothing more.
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        rows, live = _frame(held[0]), _frame(held[1])
        taken = (rows["at"] // MINUTE + 1) * MINUTE <= now
        if not taken.any() and (live is None or not (live["end"] <= now).any()):
            return
        out, live, rest = advance(rows, live, now)
        if len(live) or len(rest):
            self.held.update((_table(rest.reset_index(drop=True)), _table(live.reset_index(drop=True))))
        else:
            self.held.clear()
        if len(live):
            self.handle.registerTimer(int(live["end"].min()))
        out["side"] = np.array(SIDES, object)[out["side"].to_numpy(np.int64)]
        yield out[_CHAIN]

    def close(self) -> None:
        pass


_WAITING = [*_GROUP, "end", "at", "row_id", "ms", "oid", "volume", "side", "trade"]


def trade_chains(events: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Contiguous trades of one aggressor per (symbol, day, session).

    Any other row closes the chain; a chain still open when the watermark passes
    the session end is emitted as censored; a row that goes back in row order is
    reported as an order break and left out.
    """
    at, session = F.unix_millis("ts"), X.session_of()
    ends = F.when(session == "AM", (SESSION_END["AM"] // MINUTE + 1) * MINUTE).otherwise((SESSION_END["PM"] // MINUTE + 1) * MINUTE)
    e = events.filter(X.in_session()).withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("symbol", "date", session), F.lit(BUCKETS)).cast("int").alias("bucket"),
        "symbol", "date", session.alias("session"), "ts", (at - F.col("ms") + ends).alias("end"), at.alias("at"), "row_id", F.col("ms").cast("long").alias("ms"),
        F.coalesce(X.own_side_id(), F.lit(0)).cast("long").alias("oid"), F.coalesce("source_volume", F.lit(0)).cast("long").alias("volume"),
        F.when(F.col("source_side") == "B", 1).when(F.col("source_side") == "S", 2).otherwise(0).alias("side"),
        (_traded() & X.own_side_id().isNotNull()).alias("trade"))
    return e.groupBy("bucket").transformWithStateInPandas(Chains(), CHAIN_OUT, "Append", "EventTime")


class Signals(StatefulProcessor):
    """10:30 flow and mid of each day of a stock; see :func:`signal_snapshot`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState(
            "days", "date int", "rows long, buy long, sell long, mid double, mid_row long, fbuy long, fsell long, fevents long")
        self.history = handle.getValueState("history", "rows long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.history.update((int(initialState["earlier_rows"].sum()),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for date, d in b.groupby("date"):
                h = self.days.getValue((int(date),))
                h = list(h) if h else [0, 0, 0, None, -1, 0, 0, 0]
                h[0] += len(d)
                d = d[d["signal"]]
                after, buy = d["ms"] >= SIGNAL_MS, d["source_side"] == "B"
                window, t = (d["ms"] >= SIGNAL_FROM_MS) & ~after, d["trade"]
                for at, mask in ((1, window & t & buy), (2, window & t & ~buy), (5, after & t & buy), (6, after & t & ~buy)):
                    h[at] += int(d.loc[mask, "volume"].sum())
                h[7] += int(after.sum())
                books = d.loc[~after & d["mid"].notna()]
                if len(books) and int(books["row_id"].max()) > h[4]:
                    i = books["row_id"].idxmax()
                    h[3], h[4] = float(books.at[i, "mid"]), int(books.at[i, "row_id"])
                self.days.updateValue((int(date),), tuple(h))
                if len(d):
                    self.handle.registerTimer(midnight(date) + LABEL_MS)
        yield pd.DataFrame(columns=_SIGNAL)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() - LABEL_MS
        known = sorted(d for (d,) in list(self.days.keys()))
        earlier = self.history.get()[0] if self.history.exists() else 0
        for day in [d for d in known if midnight(d) < at]:
            earlier += self.days.getValue((day,))[0]
            self.days.removeKey((day,))
        self.history.update((earlier,))
        day = next(d for d in known if midnight(d) == at)
        h = self.days.getValue((day,))
        yield pd.DataFrame([[key[0], day, h[1], h[2], h[3], h[5], h[6], h[7], earlier]], columns=_SIGNAL)

    def close(self) -> None:
        pass


def signal_snapshot(events: DataFrame, delay: str = "1 minute", history: DataFrame | None = None) -> DataFrame:
    """10:30 flow and mid with 10-minute labels, emitted by a timer at 10:40.

    ``earlier_rows`` counts a stock's rows of earlier days. A stream that starts
    late takes what lies before it from ``history(symbol, earlier_rows)`` as initial
    state; after a stop it goes on from its checkpoint.
    """
    e = events.withWatermark("ts", delay).select(
        "symbol", "date", "ts", "row_id", F.col("ms").cast("long").alias("ms"), "source_side",
        F.coalesce("source_volume", F.lit(0)).cast("long").alias("volume"), _traded().alias("trade"),
        F.coalesce(X.in_window(X.AM_OPEN, X.AM_CLOSE) & (F.col("ms") < LABEL_MS), F.lit(False)).alias("signal"),
        F.when(X.book_ok("strict"), (X.best("bid").cast("double") + X.best("ask")) / 2.0).alias("mid"))
    start = None if history is None else history.select("symbol", F.col("earlier_rows").cast("long")).groupBy("symbol")
    return e.groupBy("symbol").transformWithStateInPandas(Signals(), SIGNAL_OUT, "Append", "EventTime", start)


class Latecomers(StatefulProcessor):
    """Marks rows behind the newest event time of earlier batches."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = before
        for b in rows:
            newest = max(int(b["event_ms"].max()), newest if newest is not None else -(1 << 62))
            yield b[["symbol", "date", "row_id", "ms", "event_ms"]].assign(
                is_late=False if before is None else b["event_ms"] < before - self.delay_ms)
        self.newest.update((newest,))

    def close(self) -> None:
        pass


def mark_late(events: DataFrame, delay_ms: int) -> DataFrame:
    """All rows, ``is_late`` for those behind their stock's watermark on arrival.

    The watermark of a stock is its newest event time of earlier micro-batches
    less ``delay_ms``. Engine watermarks drop late rows silently; here they stay
    in the output and can be led to a table of their own.
    """
    e = events.select("symbol", "date", "row_id", F.col("ms").cast("long").alias("ms"), F.unix_millis("ts").alias("event_ms"))
    return e.groupBy("symbol").transformWithStateInPandas(
        Latecomers(delay_ms), "symbol string, date int, row_id long, ms long, event_ms long, is_late boolean", "Append", "None")


# Processors travel with the query, so workers need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
