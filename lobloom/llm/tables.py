"""Shared steps on tables: exact ranks of hot keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lobloom.session import stage


def parallel(df: DataFrame) -> int:
    """Partitions that a shuffle of this session gets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    return result_name(df, f"__{name}")


def result_name(df: DataFrame, name: str) -> str:
    """``name`` for a column of results, with underscores after it where ``df`` has such a column already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, key: str, order: list[Column], salt: Column, out: str = "rank") -> DataFrame:
    """Adds a gapless rank from 0 of each row among the rows of its ``key``.

    A key may hold a large share of all rows: its rows are dealt by ``salt`` (any
    hash of the row's id), numbered inside each part, and moved up by the sizes
    of the parts before. Ranks run by part, then by ``order``.
    """
    n = parallel(df)
    parts = df.withColumn("__part", F.pmod(salt, F.lit(n)))
    sizes = parts.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each key and part: at most as many rows of a key as partitions.
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("__key"), F.col("__part").alias("__p"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__part").orderBy(*order)
    numbered = parts.withColumn("__row", F.row_number().over(inside) - 1)
    return (
        numbered.join(offsets, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__p")))
        .withColumn(out, (F.col("__before") + F.col("__row")).cast("long"))
        .drop("__part", "__row", "__key", "__p", "__before"))


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node of ``links(a, b)``.

    Alternates two star steps: every node hands its larger neighbours, then its
    smaller ones, the smallest node it sees. Links shrink towards stars around
    the smallest node of each component, and paths halve, so a few rounds are
    enough. Each round is one written table in the shared folder; nodes without
    links do not appear.
    """
    edges = links.select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stage(edges, "links")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # Large star: u's larger neighbours move to the smallest node u sees.
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = _smallest(both)
        large = both.where("v > u").join(low, "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: u's smaller neighbours, and u, move to the smallest of them.
        large = stage(large, "links")
        moved = large.join(_smallest(large), "u").select(F.explode(F.array(
            F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(moved.select("e.u", "e.v").where("u <> v").distinct(), "links")
        # Done once every node has one link and no centre is linked itself.
        several = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u")
        chained = edges.select("v").distinct().join(
            edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if several.union(chained).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select("v").distinct().select("v", F.col("v").alias("c")))


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest node among u and its neighbours.

    Written out, so that the join with a hub's many links is a plain join of two
    shuffled sides, which Spark can split where a hub is hot.
    """
    return stage(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
