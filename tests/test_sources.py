"""File layouts, snapshots as JSON lines, certified inputs and reruns of a month."""

import os

import pytest
from pyspark.sql import functions as F

import lobloom.catalog.all_queries  # noqa: F401
from lobloom.catalog.registry import QUERIES
from lobloom.sources import readers as R
from lobloom.sources.derived import lob

SF = "/root/testdata/sf0.001"


def files(root):
    return sorted(os.path.join(d, f)[len(str(root)) + 1 :] for d, _, fs in os.walk(root) for f in fs if not f.endswith(".crc"))


def test_month_symbol_files(spark, tmp_path):
    e = lob(spark, SF)
    root = str(tmp_path / "events")
    R.write_event_files(e, root)
    want = {f"{r.date // 100}/{r.symbol}.parquet" for r in e.select("date", "symbol").distinct().collect()}
    assert set(files(root)) == want
    back = R.read_events(spark, root)
    assert sorted(back.select("symbol", "date", "row_id").collect()) == sorted(e.select("symbol", "date", "row_id").collect())
    months = sorted({w[:6] for w in want})[:1]
    some = R.read_events(spark, root, ["source_volume"], (100_000_000, 103_000_000), months)
    assert {f.split("/")[-2] for f in some.inputFiles()} == set(months)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "bid_px" not in plan and "GreaterThanOrEqual(time,100000000)" in plan
    # Writing one day again replaces the files of its month only.
    day = e.agg(F.min("date")).first()[0]
    R.write_event_files(e.filter(F.col("date") == day), root)
    assert set(files(root)) == want
    again = R.read_events(spark, root, ["date"], months=[str(day // 100)])
    symbols = [r.symbol for r in e.filter(F.col("date") == day).select("symbol").distinct().collect()]
    assert {r.date for r in again.filter(F.col("symbol").isin(symbols)).select("date").distinct().collect()} == {day}


def test_a_file_outside_the_universe_stops_the_job(spark):
    listed = spark.createDataFrame([("/a/202401/SH1.parquet",), ("/a/202401/ETF.parquet",)], "path string")
    universe = spark.createDataFrame([("SH1", 1), ("ETF", 2)], "symbol string, security_category int")
    marked = R.certified_inputs(listed, universe)
    assert {(r.month, r.symbol, r.is_certified) for r in marked.collect()} == {("202401", "SH1", True), ("202401", "ETF", False)}
    with pytest.raises(Exception, match="outside the stock universe: /a/202401/ETF"):
        R.assert_certified(marked).collect()


def test_json_snapshots_keep_broken_lines_apart(spark, tmp_path):
    good = '{"symbol": "SH1", "row_id": 4, "time": 93000000, "bid_px": [10, 9], "bid_cnt": [1, 2], "bid_ordvol": [5, 1, 2], "more": "x"}'
    (tmp_path / "a.json").write_text("\n".join([good, "{", '{"row_id": "x"}', "", '{"symbol": "SH2"}']))
    rows, broken = R.read_snapshots(spark, str(tmp_path))
    assert [(r.symbol, r.row_id, r.bid_ordvol, r.ask_px) for r in sorted(rows.collect(), key=lambda r: r.symbol)] == [
        ("SH1", 4, [5, 1, 2], None), ("SH2", None, None, None)]
    assert sorted(r.corrupt for r in broken.collect()) == ["{", '{"row_id": "x"}']


def test_a_month_run_again_is_replaced_once(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "202401", 1), ("b", "202401", 2), ("a", "202402", 3)], "symbol string, month string, n int")
    R.replace_partitions(rows, out, ["month"])
    R.replace_partitions(rows.filter("month = '202401' AND symbol = 'a'").withColumn("n", F.lit(9)), out, ["month"])
    got = spark.read.schema("symbol string, n int, month string").parquet(out)
    assert sorted((r.symbol, r.month, r.n) for r in got.collect()) == [("a", "202401", 9), ("a", "202402", 3)]


def test_the_file_scan_takes_all_months_and_hours(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    months = [events.withColumn("ts", F.col("ts") + F.expr(f"interval {31 * k} days")).withColumn(
        "event_id", F.col("event_id") + k * 10**6) for k in range(3)]
    months[0].unionByName(months[1]).unionByName(months[2]).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["s01_s04_file_scan_round_trip"](spark, str(tmp_path))
    e = lob(spark, str(tmp_path))
    want = e.groupBy("symbol", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("source_volume").alias("volume"), F.max("time").alias("last_time"))
    assert e.select(F.floor(F.col("date") / 100)).distinct().count() > 2
    assert sorted(got.collect()) == sorted(want.collect())
