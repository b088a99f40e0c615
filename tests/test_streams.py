"""Stateful stream operators: order inside the delay, restart, initial state, late rows."""

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lobloom.catalog import stream_queries
from lobloom.sources.derived import lob
from lobloom.streaming import flows, processors

SF = "/root/testdata/sf0.001"


def write(spark, folder, rows, part):
    """Rows (symbol, date, time, row_id, action, side, order id, volume) as one file of the event table."""
    schema = lob(spark, SF).schema
    names = {f.name: f.dataType for f in schema}
    d = spark.createDataFrame(rows, "symbol string, date int, time long, row_id long, source_action string, source_side string, oid long, source_volume long")
    cols = {"source_buy_order_id": F.when(F.col("source_side") == "B", F.col("oid")), "source_sell_order_id": F.when(F.col("source_side") == "S", F.col("oid"))}
    d.select(*[
        cols.get(n, F.col(n) if n in d.columns else F.lit(None)).cast(t).alias(n) for n, t in names.items()
    ]).coalesce(1).write.mode("append").parquet(f"{folder}/part={part}")


def stream(spark, folder):
    e = lob(spark, SF)
    return flows.with_event_time(spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(str(folder)))


def trade(row, time, side="B", oid=1, volume=100, symbol="X", date=20240102, action="TRADE"):
    return (symbol, date, time, row, action, side, oid, volume)


END = [trade(10**6, 100_000_000, symbol="~", date=20240110)]


def chains(rows):
    return sorted((r.side, r.order_id, r.volume, r.children, r.first_row, r.last_row, r.status) for r in rows)


def test_rows_inside_the_delay_are_put_in_order(spark, tmp_path):
    write(spark, tmp_path / "in", [trade(3, 100_001_000), trade(1, 100_000_000), trade(5, 100_002_000, "S", 9)], 0)
    write(spark, tmp_path / "in", [trade(2, 100_000_500), trade(4, 100_001_500, action="CANCEL"), trade(6, 100_002_500, "S", 9)], 1)
    write(spark, tmp_path / "in", END, 2)
    got = flows.run_once(spark, processors.trade_chains(stream(spark, tmp_path / "in"))).where("symbol = 'X'").collect()
    assert chains(got) == [("B", 1, 300, 3, 1, 3, "closed"), ("S", 9, 200, 2, 5, 6, "censored")]


def test_chain_over_minutes_and_sessions(spark, tmp_path):
    rows = [trade(1, 112_859_000), trade(2, 112_958_000), trade(3, 130_000_000), trade(4, 130_100_000), trade(5, 130_200_000, "S", 2)]
    write(spark, tmp_path / "in", rows, 0)
    write(spark, tmp_path / "in", END, 1)
    got = flows.run_once(spark, processors.trade_chains(stream(spark, tmp_path / "in"))).where("symbol = 'X'").collect()
    assert chains(got) == [("B", 1, 200, 2, 1, 2, "censored"), ("B", 1, 200, 2, 3, 4, "closed"), ("S", 2, 100, 1, 5, 5, "censored")]


@pytest.mark.parametrize("stop", [1, 2, 3])
def test_restart_gives_the_rows_of_one_run(spark, tmp_path, stop):
    parts = [
        [trade(1, 93_100_000), trade(2, 100_100_000, volume=7)], [trade(3, 102_900_000, "S", 3, 5), trade(4, 103_100_000)],
        [trade(5, 103_200_000), trade(6, 140_000_000), trade(7, 101_000_000, date=20240103)], END]
    whole = tmp_path / "whole"
    for i, rows in enumerate(parts):
        write(spark, whole, rows, i)
    history = spark.createDataFrame([("X", 40)], "symbol string, earlier_rows long")
    want = flows.run_once(spark, processors.signal_snapshot(stream(spark, whole), history=history)).where("symbol = 'X'").collect()
    grown, root = tmp_path / "grown", str(tmp_path / "out")
    for span in (range(stop), range(stop, 4)):
        for i in span:
            shutil.copytree(whole / f"part={i}", grown / f"part={i}")
        got = flows.run_once(spark, processors.signal_snapshot(stream(spark, grown), history=history), root=root)
    assert sorted(got.where("symbol = 'X'").collect()) == sorted(want)
    assert [(r.date, r.buy_30m, r.sell_30m, r.future_buy_10m, r.future_events, r.earlier_rows) for r in sorted(want, key=lambda r: r.date)] == [
        (20240102, 7, 5, 200, 2, 40), (20240103, 100, 0, 0, 0, 46)]


def test_late_rows_stay_in_the_output(spark, tmp_path):
    write(spark, tmp_path / "in", [trade(1, 100_500_000), trade(2, 100_000_000)], 0)
    write(spark, tmp_path / "in", [trade(3, 100_350_000), trade(4, 100_450_000), trade(5, 93_000_000, symbol="Y")], 1)
    write(spark, tmp_path / "in", [trade(6, 100_600_000), trade(7, 92_000_000, symbol="Y")], 2)
    got = flows.run_once(spark, processors.mark_late(stream(spark, tmp_path / "in"), 60_000))
    assert {r.row_id: r.is_late for r in got.collect()} == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_replay_follows_the_clock_not_the_row_ids(spark, tmp_path):
    write(spark, tmp_path / "in", [trade(1, 100_000_000, date=20240105, symbol="A"), trade(2, 100_000_000, date=20240102, symbol="B")], 0)
    e = spark.read.schema(lob(spark, SF).schema).parquet(str(tmp_path / "in" / "part=0"))
    stream_queries._files(e, str(tmp_path / "out"), 2, range(1))
    assert [r.symbol for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["B"]


def test_stock_days_that_share_a_bucket_stay_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(processors, "BUCKETS", 1)
    write(spark, tmp_path / "in", [trade(1, 112_900_000), trade(2, 112_901_000, symbol="Y"), trade(3, 112_902_000)], 0)
    # Only rows of a later day wait when the first day's open chains end.
    write(spark, tmp_path / "in", [trade(4, 100_000_000, action="CANCEL", symbol="Y", date=20240103)], 1)
    write(spark, tmp_path / "in", [trade(6, 100_201_000, symbol="Y", date=20240103), trade(5, 100_300_000, symbol="Y", date=20240103)], 2)
    write(spark, tmp_path / "in", END, 3)
    got = flows.run_once(spark, processors.trade_chains(stream(spark, tmp_path / "in"))).where("symbol <> '~'").collect()
    assert sorted((r.symbol, r.date, *chains([r])[0][1:]) for r in got if r.order_id) == [
        ("X", 20240102, 1, 200, 2, 1, 3, "censored"), ("Y", 20240102, 1, 100, 1, 2, 2, "censored"), ("Y", 20240103, 1, 100, 1, 6, 6, "censored")]
    assert [(r.symbol, r.first_row, r.volume, r.children) for r in got if r.status == "order_break"] == [("Y", 5, 100, 0)]


def chains_one_by_one(rows):
    """Chains of each stock-day, row by row; all rows are final."""
    out, groups = [], {}
    for r in sorted(rows.to_dict("records"), key=lambda r: (r["at"] // processors.MINUTE, r["row_id"])):
        groups.setdefault((r["symbol"], r["date"], r["session"]), []).append(r)
    for key, group in groups.items():
        chain, last = None, -1
        for r in group:
            if r["row_id"] <= last:
                out.append((*key, 0, r["row_id"], r["row_id"], "order_break"))
                continue
            last = r["row_id"]
            if chain and r["trade"] and chain[0] == (r["side"], r["oid"]):
                chain[1:] = [chain[1] + 1, chain[2], last]
                continue
            if chain:
                out.append((*key, *chain[1:], "closed"))
            chain = [(r["side"], r["oid"]), 1, last, last] if r["trade"] else None
        if chain:
            out.append((*key, *chain[1:], "censored"))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_chains_taken_in_steps(seed):
    r, n = np.random.default_rng(seed), 400
    date, session = r.choice([20240102, 20240103], n), r.choice(["AM", "PM"], n)
    day = np.array([processors.midnight(d) for d in date])
    ms = np.where(session == "AM", 34_200_000, 46_800_000) + r.integers(0, 2_000_000, n)
    ends = np.array([processors.SESSION_END[s] // processors.MINUTE * processors.MINUTE + processors.MINUTE for s in session])
    rows = pd.DataFrame({
        "symbol": r.choice(["A", "B"], n), "date": date, "session": session, "end": day + ends, "at": day + ms, "row_id": np.argsort(np.argsort(day + ms)),
        "ms": ms, "oid": r.integers(1, 3, n), "volume": 100, "side": r.integers(1, 3, n), "trade": r.random(n) < 0.8})
    rows["row_id"] += np.where(r.random(n) < 0.1, r.integers(-60, 60, n), 0)
    got, waiting, live = [], rows, None
    for now in (*np.sort(r.choice(rows["at"], 7)), int(rows["end"].max())):
        out, live, waiting = processors.advance(waiting.reset_index(drop=True), live, int(now))
        got += out[["symbol", "date", "session", "children", "first_row", "last_row", "status"]].itertuples(index=False, name=None)
    assert sorted(got) == chains_one_by_one(rows)
    assert len(live) == len(waiting) == 0


def test_replay_writes_a_part_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 200)
    e = lob(spark, SF)
    assert stream_queries._files(e, str(tmp_path / "out"), 3, range(3)) > 1
    files = sorted(tmp_path.glob("out/*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    tasks, part = len(files) // 3, []
    for i in range(3):
        of = flows.with_event_time(spark.read.parquet(*map(str, files[i * tasks : (i + 1) * tasks])))
        part.append((of.agg(F.min("ts"), F.max("ts")).first(), of.count()))
    assert part[0][0][1] < part[1][0][0] and part[1][0][1] < part[2][0][0]
    assert sum(n for _, n in part) == e.count()
