"""Event, panel and reference-data readers, and the sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONGS = T.ArrayType(T.LongType())
EVENT_SCHEMA = T.StructType([
    T.StructField("date", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("row_id", T.LongType()),
    T.StructField("source_action", T.StringType()), T.StructField("source_recid", T.LongType()),
    T.StructField("source_buy_order_id", T.LongType()), T.StructField("source_sell_order_id", T.LongType()),
    T.StructField("source_side", T.StringType()), T.StructField("source_price", T.LongType()),
    T.StructField("source_volume", T.LongType()), T.StructField("source_link_status", T.StringType()),
    *[T.StructField(f"{s}_{k}", LONGS) for k in ("px", "vol", "cnt") for s in ("bid", "ask")],
])


def symbol_of_path(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.parquet$", 1)


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for ``path``: works wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_event_files(events: DataFrame, root: str) -> None:
    """Events as ``<month>/<symbol>.parquet``, sorted by row id; files of the same name are replaced.

    Spark writes one file for each month and symbol; the driver only renames them.
    """
    spark = events.sparkSession
    tmp = f"{root.rstrip('/')}/_new-{uuid.uuid4().hex}"
    keyed = events.withColumns({"_m": F.floor(F.col("date") / 100).cast("string"), "_s": F.col("symbol")}).drop("symbol")
    keyed.repartition("_m", "_s").sortWithinPartitions("_m", "_s", "row_id").write.partitionBy("_m", "_s").option(
        "maxRecordsPerFile", 0).option("compression", "zstd").parquet(tmp)
    fs, _ = _hadoop(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for found in fs.globStatus(path(f"{tmp}/_m=*/_s=*/*.parquet")):
        month, symbol = (found.getPath().toString().split("/")[i].split("=", 1)[1] for i in (-3, -2))
        fs.mkdirs(path(f"{root}/{month}"))
        to = path(f"{root}/{month}/{symbol}.parquet")
        fs.delete(to, False)
        if not fs.rename(found.getPath(), to):
            raise OSError(f"could not place {to.toString()}")
    fs.delete(path(tmp), True)


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """(path) of the files under ``root``; their content is not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def read_events(
    spark: SparkSession, paths: Sequence[str] | str, columns: Sequence[str] | None = None,
    clock: tuple[int, int] | None = None, months: Sequence[str] | None = None,
) -> DataFrame:
    """Event files ``<month>/<symbol>.parquet``: pruned columns, pushed clock range.

    The symbol comes from the file name; with ``months`` only the folders of those
    months are listed and opened.
    """
    roots = [paths] if isinstance(paths, str) else list(paths)
    folders = [f"{r.rstrip('/')}/{m}" for r in roots for m in months] if months else roots
    df = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders)
    if clock:
        df = df.filter((F.col("time") >= clock[0]) & (F.col("time") < clock[1]))
    wanted = [c for c in (columns or EVENT_SCHEMA.names) if c != "symbol"]
    return df.select(symbol_of_path(F.col("_metadata.file_path")).alias("symbol"), *wanted)


def read_panels(spark: SparkSession, paths: Sequence[str], typed: str | None = None) -> DataFrame:
    """CSV panels with headers, united by column name; missing columns become NULL.

    ``typed`` gives the types of the columns that a panel has; others stay text.
    """
    kinds = dict(f.split() for f in typed.split(", ")) if typed else {}
    out = None
    for p in paths:
        one = spark.read.option("header", "true").csv(p)
        one = one.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in one.columns])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no panel paths given")
    return out


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}")
    return df


def certified_inputs(files: DataFrame, universe: DataFrame, category: int = 1) -> DataFrame:
    """Split listed ``path`` rows into month and symbol and mark those in the stock universe."""
    parts = files.select(
        "path", F.regexp_extract("path", r"(\d{6})/([^/]+)\.parquet$", 1).alias("month"),
        F.regexp_extract("path", r"(\d{6})/([^/]+)\.parquet$", 2).alias("symbol"))
    ok = universe.filter(F.col("security_category") == category).select("symbol").distinct().withColumn("_ok", F.lit(True))
    return parts.join(ok, "symbol", "left").withColumn("is_certified", F.coalesce("_ok", F.lit(False))).drop("_ok")


def assert_certified(inputs: DataFrame) -> DataFrame:
    """Fail the job on the first file outside the universe."""
    bad = F.raise_error(F.concat(F.lit("file outside the stock universe: "), F.col("path")))
    return inputs.withColumn("is_certified", F.when(F.col("is_certified"), F.lit(True)).otherwise(bad.cast("boolean")))


def point_in_time_universe(listings: DataFrame, months: DataFrame) -> DataFrame:
    """(month, symbol) for listings whose life overlaps the month.

    Each listing is expanded to its own months, so this is an equi join.
    """
    last = months.agg(F.max("month").alias("_max"))
    lo = F.trunc("listed", "month")
    hi = F.trunc(F.coalesce("delisted", F.to_date(F.concat("_max", F.lit("01")), "yyyyMMdd")), "month")
    each = listings.withColumn("_k", F.lit(1)).join(F.broadcast(last.withColumn("_k", F.lit(1))), "_k").filter(hi >= lo).select(
        "symbol", F.explode(F.sequence(lo, hi, F.expr("interval 1 month"))).alias("_m"))
    return each.select("symbol", F.date_format("_m", "yyyyMM").alias("month")).join(months.select("month").distinct(), "month")


def minute_closes(bars: DataFrame, stamps: Sequence[str]) -> DataFrame:
    """One row per stock-day with the close at each stamp, only when all exist."""
    g = bars.filter(F.col("stamp").isin(list(stamps))).groupBy("symbol", "date").agg(
        F.count_distinct("stamp").alias("_n"),
        *[F.max(F.when(F.col("stamp") == s, F.col("close"))).alias(f"close_{s}") for s in stamps])
    return g.filter(F.col("_n") == len(stamps)).drop("_n")


def limit_states(
    bars: DataFrame, limits: DataFrame, signal: str = "1030", entry: str = "1031", last: str = "1035", tolerance: float = 1e-6,
) -> DataFrame:
    """Close-at-limit, locked and touched flags at signal, entry and exit minutes."""
    c = F.col
    at = lambda s, f: F.max(F.when(c("stamp") == s, c(f)))
    aggs = {f"{n}_{f}": at(s, f) for n, s in (("signal", signal), ("entry", entry), ("exit", last)) for f in ("open", "high", "low", "close")}
    after = (c("stamp") > entry) & (c("stamp") <= last)
    aggs |= {"post_high": F.max(F.when(after, c("high"))), "post_low": F.min(F.when(after, c("low")))}
    g = bars.filter(c("stamp").between(signal, last)).groupBy("symbol", "date").agg(*[e.alias(n) for n, e in aggs.items()])
    j = g.join(limits.select("symbol", "date", "up_limit", "down_limit"), ["symbol", "date"])
    out = {}
    for n in ("signal", "entry", "exit"):
        for side in ("up", "down"):
            lim = c(f"{side}_limit")
            out[f"{n}_close_at_{side}"] = F.abs(c(f"{n}_close") - lim) <= tolerance
            out[f"{n}_locked_{side}"] = F.greatest(*[F.abs(c(f"{n}_{f}") - lim) for f in ("open", "high", "low", "close")]) <= tolerance
    out["post_entry_touch_up"] = c("post_high") >= c("up_limit") - tolerance
    out["post_entry_touch_down"] = c("post_low") <= c("down_limit") + tolerance
    return j.select("symbol", "date", "up_limit", "down_limit", *[e.alias(n) for n, e in out.items()])


SNAPSHOT_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()), *EVENT_SCHEMA.fields, T.StructField("bid_ordvol", LONGS), T.StructField("ask_ordvol", LONGS),
    T.StructField("corrupt", T.StringType())])


def read_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Legacy full-depth rows kept as JSON lines, with the per-order queues next to the ladders.

    Typed as declared. Returns the rows, and the lines that are no such row, as text.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"}
    lines = spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", SNAPSHOT_SCHEMA, options).alias("r"))
    rows = lines.filter(F.col("r.corrupt").isNull()).select("r.*").drop("corrupt")
    return rows, lines.filter(F.col("r.corrupt").isNotNull()).select("r.corrupt")


def read_lending_balances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("symbol string, date int, balance double").parquet(path)


def write_parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    w = df.write.mode("append").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("header", "true").csv(path)


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Writes ``df`` into its own partitions only: what they held is replaced, other partitions stay.

    Running a month again replaces that month once.
    """
    df.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy(*by).parquet(path)


def pending_only(work: DataFrame, done: DataFrame, keys: Sequence[str] = ("symbol", "month")) -> DataFrame:
    """Work items whose keys are not in the existing output."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
