"""Session defaults, lineage cuts and staged tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[tuple[str, str], str] = {}
_OWN: dict[str, str] = {}


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lobloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        # Small inputs keep all local cores busy: small splits and post-shuffle tasks.
        .config("spark.sql.files.openCostInBytes", "65536")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64kb")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-lobloom-", dir="/tmp"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A single-process session without one gets a temporary folder; on a cluster
    that would be a different disk on each machine, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-lobloom-", dir="/tmp")
    return _OWN[app]


def shuffle_tasks(df: DataFrame) -> int:
    """Shuffle partitions of the session, for rows that are sorted many times after one shuffle.

    Partitions merged by their compressed size would hold sorts that spill.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in a way that survives executor loss, and gives later
    joins real sizes to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lobloom/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_once(spark: SparkSession, key: str, build) -> DataFrame:
    """Stage a derived input table once per application and reuse it."""
    slot = (spark.sparkContext.applicationId, key)
    path = _STAGED.get(slot)
    if path is None:
        df = build()
        path = f"{shared_folder(spark)}/lobloom/base-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        _STAGED[slot] = path
    return spark.read.parquet(path)
