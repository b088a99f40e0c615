"""Balanced shards of indivisible groups by Karmarkar-Karp differencing.

Groups (equal texts here) must not be split. A partial partition is a vector of
``shards`` byte sums. Differencing takes the two partial partitions with the
largest spread and adds them in opposite order, largest sums onto smallest, until
one is left.

Differencing is sequential, so it works on a bounded number of items. A group
with more than ``1 / items`` of all bytes is an item of its own; there are fewer
than ``items`` of those. All others are dealt by their hash into ``items`` bundles
whose bytes are summed where the rows are. At most twice ``items`` sums reach the
driver, whatever the number of documents; the shard of each item goes back as a
table of that size, and every document finds its item without a shuffle. Bundles
are small against a shard, so the shards' bytes differ by far less than a bundle.

Defined cases: a null text is size 1 and in the group of empty texts; empty tables
give empty results; repeated rows are further members of their group; ids may be
null; other columns are not carried.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lobloom.session import stage

from .tables import ranked

ITEMS = 4_096


def difference(vectors: list[list[int]]) -> tuple[list[int], list[list[int]]]:
    """Combined sums, and for each vector the place that each of its sums went to.

    Vectors may have sums in any order. Ties are taken in the order given.
    """
    k = len(vectors[0])
    heap, serial = [], 0
    for i, v in enumerate(vectors):
        order = sorted(range(k), key=lambda j: (-v[j], j))
        sums = [v[j] for j in order]
        # Who is in each place: a tree of (left, right), leaves are (vector, its sum's number).
        heapq.heappush(heap, (sums[-1] - sums[0], serial, sums, [(i, j) for j in order]))
        serial += 1
    while len(heap) > 1:
        _, _, a, who_a = heapq.heappop(heap)
        _, _, b, who_b = heapq.heappop(heap)
        joined = sorted(((x + y, p, q) for x, y, p, q in zip(a, reversed(b), who_a, reversed(who_b), strict=True)), key=lambda s: -s[0])
        sums = [s[0] for s in joined]
        heapq.heappush(heap, (sums[-1] - sums[0], serial, sums, [(s[1], s[2], None) for s in joined]))
        serial += 1
    _, _, sums, who = heap[0]
    moves = [[0] * k for _ in vectors]
    for place, tree in enumerate(who):
        stack = [tree]
        while stack:
            node = stack.pop()
            if len(node) == 3:
                stack += node[:2]
            else:
                moves[node[0]][node[1]] = place
    return sums, moves


def assign(sized: DataFrame, shards: int = 16, items: int = ITEMS) -> DataFrame:
    """Adds ``shard`` to a written table with ``id`` (of the indivisible group) and ``size``."""
    spark = sized.sparkSession
    groups = stage(sized.groupBy("id").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    large = groups.where(F.col("bytes") * items > total)  # fewer than ``items`` rows
    bundle = F.pmod(F.xxhash64("id"), F.lit(items)).cast("string")
    sums = groups.groupBy(F.when(F.col("bytes") * items > total, F.col("id")).otherwise(bundle).alias("item")).agg(
        F.sum("bytes").alias("bytes"))
    found = sorted((-r["bytes"], r["item"]) for r in sums.collect())
    if not found:
        return sized.withColumn("shard", F.lit(None).cast("int"))
    _, moves = difference([[-n, *[0] * (shards - 1)] for n, _ in found])
    placed = spark.createDataFrame([(item, m[0]) for (_, item), m in zip(found, moves, strict=True)], "item string, shard int")
    marked = sized.join(F.broadcast(large.select(F.col("id").alias("__large"))), F.col("id") == F.col("__large"), "left")
    marked = marked.withColumn("item", F.coalesce("__large", bundle)).drop("__large")
    return marked.join(F.broadcast(placed), "item").drop("item")


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", items: int = ITEMS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs``; equal texts stay together."""
    body = F.coalesce(F.col(text), F.lit(""))
    sized = stage(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body.cast("binary"), 256).alias("id")), "sized")
    out = stage(assign(sized, shards, items), "sharded")
    out = ranked(out, "shard", [F.col("doc_id"), F.col("id")], F.xxhash64("doc_id", "id"), "slot")
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")
