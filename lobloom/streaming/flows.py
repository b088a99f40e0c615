"""Streaming forms of the event-time operators.

Events carry ``ts`` (see :func:`with_event_time`).  State is keyed by symbol, day
and session, so it resets where the exchange does; checkpoints make a query
resumable and history comes from a static table joined to the stream.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lobloom.functions import expr as X
from lobloom.session import shared_folder

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_event_time(events: DataFrame) -> DataFrame:
    """Add ``ms`` and the event time ``ts`` from the integer date and clock."""
    day = F.unix_date(F.to_date(F.col("date").cast("string"), "yyyyMMdd")).cast("long")
    return events.withColumn("ms", X.clock_ms()).withColumn("ts", F.timestamp_millis(day * DAY_MS + F.col("ms")))


def dedup_trades(events: DataFrame, delay: str = "10 hours") -> DataFrame:
    """Trades once per (symbol, date, record id); those without an id all pass."""
    t = events.filter((F.col("source_action") == "TRADE") & (F.col("source_volume") > 0)).withWatermark("ts", delay)
    # A missing id becomes unique, so it neither matches nor gathers in one state.
    key = F.coalesce(F.col("source_recid").cast("string"), F.concat(F.lit("row-"), F.col("row_id").cast("string")))
    return t.withColumn("_rec", key).dropDuplicatesWithinWatermark(["symbol", "date", "_rec"]).drop("_rec")


def flow_bins(events: DataFrame, width: str = "5 minutes", slide: str | None = None, delay: str = "1 minute") -> DataFrame:
    """Tumbling or sliding buy and sell volume of trades.

    The watermark follows all events, so a bin closes, and leaves the state, when
    the clock has passed it, whether or not anything trades after it.
    """
    t = events.withWatermark("ts", delay) if events.isStreaming else events
    # A filter here would be moved below the watermark and hold it back between trades.
    trade = (F.col("source_action") == "TRADE") & (F.col("source_volume") > 0)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    buy = F.col("source_side") == "B"
    return t.groupBy("symbol", w).agg(
        X.sum0("source_volume", trade & buy).alias("buy_volume"), X.sum0("source_volume", trade & ~buy).alias("sell_volume"),
        X.count_if(trade).alias("trades")).filter("trades > 0").select(
        "symbol", F.col("window.start").alias("bin_start"), F.col("window.end").alias("bin_end"), "buy_volume", "sell_volume", "trades")


def run_once(spark: SparkSession, stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """Drain the available input into a table in the shared folder and read it back.

    A second call with the same ``root`` goes on from the checkpoint of the first.
    """
    root = root or f"{shared_folder(spark)}/lobloom/stream-{uuid.uuid4().hex}"
    out = f"{root}/out"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def save(df: DataFrame, epoch: int) -> None:
        # A batch that is run again after a failure replaces its own rows.
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}" if mode == "append" else out)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(
        availableNow=True).foreachBatch(save).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)
