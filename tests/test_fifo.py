"""The FIFO measure reads its snapshots once; the de-duplicating stream carries no books."""

from pyspark.sql import functions as F

from lobloom.catalog import stream_queries
from lobloom.plans.summaries import fifo_active_take

SNAP = ("symbol string, date int, time long, row_id long, bid_px array<bigint>, ask_px array<bigint>, bid_cnt array<bigint>, ask_cnt array<bigint>, "
        "bid_ordvol array<bigint>, ask_ordvol array<bigint>")


def test_snapshots_are_read_once(spark):
    rows = [
        ("s", 1, 93000000, 1, [99], [101, 102], [1], [2, 2], [5], [1, 2, 3, 4]),
        # The best ask level is gone and one of the next level is taken from its first order.
        ("s", 1, 93000001, 2, [99], [102], [1], [2], [5], [2, 4]),
        # The mid falls, the bid does not: a move, but nothing taken.
        ("s", 1, 93000002, 3, [99], [101], [1], [1], [5], [9])]
    got = fifo_active_take(spark.createDataFrame(rows, SNAP))
    r = got.first()
    assert (r.transitions, r.mid_moves, r.active_take_events, r.active_take_qty) == (2, 2, 1, 1 + 2 + 1)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_dedup_stream_holds_only_what_it_counts(spark, monkeypatch):
    seen = {}
    e = spark.range(1).select(
        F.lit("s").alias("symbol"), F.lit(20240102).alias("date"), F.lit(93000000).cast("long").alias("time"), F.col("id").alias("row_id"),
        F.lit("TRADE").alias("source_action"), F.col("id").alias("source_recid"), F.lit(1).cast("long").alias("source_volume"),
        F.array(F.lit(1)).alias("bid_px"))
    monkeypatch.setattr(stream_queries, "replay", lambda spark, sf: e)
    monkeypatch.setattr(stream_queries.flows, "dedup_trades", lambda s: s)
    monkeypatch.setattr(stream_queries.flows, "run_once", lambda spark, s: seen.update(columns=s.columns) or s)
    assert stream_queries.r01(spark, "").collect()[0].trades == 1
    assert "bid_px" not in seen["columns"]
