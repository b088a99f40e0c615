"""Embedding near-duplicates by an exact metric range join over pivot cells.

Vectors are scaled to length 1, where ``cosine >= c`` means a distance of at most
``r = sqrt(2 - 2c)``. Pivots (spread out over a bounded sample) partition the
vectors: each belongs to the cell of its nearest pivot. A vector of the cell of p
can have a partner in the cell of q only if

* triangle inequality: it is within ``R_q + r`` of q, R_q the radius of that cell;
* the partner is no nearer to any pivot s than to q, so the vector is at most r
  beyond the bisector of q and s: ``(v.s - v.q) / |s - q| <= r`` for every s.

Along the line from p to q linked vectors lie at most r apart, too.

The distinct vectors of a cell are packed into blocks of bounded size, one row
each. Every two blocks whose cells can hold a link are compared once, by a product
of the table of blocks with itself: tasks read the blocks again and again, none is
copied to disk for its partners, so disk grows with the vectors, not with the
pairs. A pair of blocks gives one count for each vector with links and a spanning
forest of its links, never all of them. Every comparison ends in a cosine in
double precision.

Where the data have no structure (random directions in many dimensions) no exact
method prunes much, and the blocks amount to comparing all with all.

Equal vectors are one class with a count. Defined cases: a vector that is null,
empty or zero, or holds a null or a non-finite number, and a row with a null id,
link with nothing; vectors of different lengths do not link; repeated rows are
further vectors; other columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import components

COSINE = 0.9
BLOCK = 4_096
PIVOTS = 64
PIVOT_SAMPLE = 4_096
SLACK = 1e-9  # on distances, against rounding; the last test is the cosine itself
STRIP = 512
PART_BYTES = 64 << 20  # of blocks, which a task of the product holds at once


def _numbers(batch: pa.RecordBatch, number: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All numbers of a batch (id, list) in a row, the places between its lists, and whether each row can link."""
    ids, lists = batch.column(0), batch.column(1)
    at = np.asarray(lists.offsets)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(number) + 0  # a null is not a number; no negative zeros
    wrong, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(flat), flat != 0))
    ok = (wrong[at[1:]] == wrong[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    return flat, at, ok & np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())


def _vectors(batch: pa.RecordBatch, number: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and numbers of the rows that can link and have the given length."""
    flat, at, ok = _numbers(batch, number)
    take = np.flatnonzero(ok & (np.diff(at) == dims))
    return np.asarray(batch.column(0).take(pa.array(take))).astype(np.int64), flat[at[take][:, None] + np.arange(dims)]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _digest(raw: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(raw.tobytes())


def _distinct(key: np.ndarray, ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the distinct keys (16 bytes each), with their least id and all their weight."""
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    least, sums = np.full(len(first), np.iinfo(np.int64).max), np.zeros(len(first), np.int64)
    np.minimum.at(least, group, ids)
    np.add.at(sums, group, weight)
    return first, least, sums


def spread(sample: np.ndarray, count: int) -> np.ndarray:
    """Up to ``count`` pivots, each the vector farthest from those before it."""
    chosen = [0]
    near = sample @ sample[0]
    while len(chosen) < count:
        i = int(np.argmin(near))
        if near[i] >= 1 - 1e-12:
            break
        chosen.append(i)
        near = np.maximum(near, sample @ sample[i])
    return sample[chosen]


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each group of rows and columns that ``near`` connects: its first row, against its other rows or columns (third: is it a column)."""
    tops, ends, column = [], [], []
    rows_done, columns_done = ~near.any(axis=1), np.zeros(near.shape[1], bool)
    for top in np.flatnonzero(~rows_done):
        if rows_done[top]:
            continue
        rows = np.array([top])
        rows_done[top] = True
        while len(rows):
            cols = np.flatnonzero(near[rows].any(axis=0) & ~columns_done)
            columns_done[cols] = True
            rows = np.flatnonzero(near[:, cols].any(axis=1) & ~rows_done) if len(cols) else cols
            rows_done[rows] = True
            for found, kind in ((cols, True), (rows, False)):
                tops.append(np.full(len(found), top))
                ends.append(found)
                column.append(np.full(len(found), kind))
    if not tops:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate(tops), np.concatenate(ends), np.concatenate(column)


def join_block(own: np.ndarray, other: np.ndarray, own_id: np.ndarray, other_id: np.ndarray, own_weight: np.ndarray,
               other_weight: np.ndarray, cosine: float, own_at: np.ndarray | None = None, other_at: np.ndarray | None = None, radius: float = 0.0):
    """Weighted numbers of links of the vectors of either side, and (id, id) links that connect the same vectors.

    With places on a line, own ones descending and other ones ascending, only vectors at most ``radius`` apart are compared.
    """
    near = np.zeros((len(own), len(other)), bool)
    own_n, other_n = np.zeros(len(own)), np.zeros(len(other))  # whole numbers, exact in doubles
    for lo in range(0, len(own), STRIP):
        hi = lo + STRIP
        end = len(other) if own_at is None else int(np.searchsorted(other_at, own_at[lo] + radius, "right"))
        found = own[lo:hi] @ other[:end].T >= cosine
        if found.any():
            found &= own_id[lo:hi, None] != other_id[None, :end]
            near[lo:hi, :end] = found
            found = found.astype(np.float64)
            own_n[lo:hi] = found @ other_weight[:end]
            other_n[:end] += own_weight[lo:hi] @ found
    top, end, column = forest(near) if own_n.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    a, b = own_id[top], np.where(column, other_id[np.where(column, end, 0)], own_id[np.where(column, 0, end)])
    return own_n.astype(np.int64), other_n.astype(np.int64), a[a != b], b[a != b]


def _reaching(dots: np.ndarray, cell: int, gap: np.ndarray, reach: np.ndarray, radius: float) -> np.ndarray:
    """Vectors (by their products with the pivots) that can have a partner in a cell."""
    near = np.sqrt(np.maximum(2 - 2 * dots[:, cell], 0)) <= reach[cell]
    return near & (((dots - dots[:, cell : cell + 1]) / gap[cell][None, :]).max(axis=1) <= radius)


def _join(vectors: DataFrame, number: str, dims: int, n: int, cosine: float, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """(id, links) counts and (a, b) links over the ``n`` vectors (id, numbers) of one length; from a written table."""
    spark = vectors.sparkSession
    radius = math.sqrt(2 - 2 * cosine) + 2 * SLACK

    def lengths(batches):
        for b in batches:
            ids, raw = _vectors(b, number, dims)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in raw], pa.binary())], names=["id", "raw"])

    sample = vectors.mapInArrow(lengths, "id long, raw binary").orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()  # bounded
    pivot = spread(_unit(np.frombuffer(b"".join(r["raw"] for r in sample), number).reshape(-1, dims)), min(pivots, -(-n // block)))
    gap = np.sqrt(np.maximum(2 - 2 * pivot @ pivot.T, 0))
    np.fill_diagonal(gap, 1.0)

    def home(batches):
        for b in batches:
            dots = _unit(_vectors(b, number, dims)[1]) @ pivot.T
            cell, top = dots.argmax(axis=1), dots.max(axis=1)
            for c in np.unique(cell):
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c], pa.int32()), "n": [int((cell == c).sum())], "top": [float(top[cell == c].min())]})

    held = vectors.mapInArrow(home, "cell int, n long, top double").groupBy("cell").agg(F.sum("n").alias("n"), F.min("top").alias("top")).collect()
    blocks, size = np.zeros(len(pivot), np.int64), np.full(len(pivot), -1.0)  # of blocks, and the radius, of each cell
    for r in held:
        blocks[r["cell"]], size[r["cell"]] = -(-r["n"] // block), math.sqrt(max(2 - 2 * r["top"], 0))
    reach = size + radius
    away = np.where(np.eye(len(pivot), dtype=bool), 0, gap)
    meets = [[int(q) for q in np.flatnonzero((size >= 0) & (away[p] <= size[p] + reach + SLACK))] for p in range(len(pivot))]

    def deal(batches):
        for b in batches:
            ids, raw = _vectors(b, number, dims)
            if len(ids) == 0:
                continue
            key = np.array([_digest(x) for x in raw], "S16")
            # Copies shrink here, so that a very common vector is a few rows of its block.
            first, least, weight = _distinct(key, ids, np.ones(len(ids), np.int64))
            key, raw = key[first], raw[first]
            cell = (_unit(raw) @ pivot.T).argmax(axis=1)
            part = (key.view("<u8")[::2] % blocks[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(cell.astype(np.int32)), pa.array(part), pa.array([k.tobytes() for k in key.view("V16")], pa.binary()),
                pa.array(least), pa.array(weight), pa.array([x.tobytes() for x in raw], pa.binary())],
                names=["cell", "part", "key", "id", "weight", "raw"])

    def pack(table: pa.Table) -> pa.Table:
        first, least, weight = _distinct(np.array(table.column("key").to_pylist(), "S16"), np.asarray(table.column("id")), np.asarray(table.column("weight")))
        raw = table.column("raw").take(pa.array(first)).to_pylist()
        cell, part = table.column("cell")[0].as_py(), table.column("part")[0].as_py()
        return pa.table({
            "no": pa.array([(cell << 32) + part]), "cell": pa.array([cell], pa.int32()), "meets": pa.array([meets[cell]], pa.list_(pa.int32())),
            "ids": [least.tobytes()], "weights": [weight.tobytes()], "raw": [b"".join(raw)]})

    total = n * (dims * np.dtype(number).itemsize + 16)
    parts = max(-(-total // PART_BYTES), math.ceil(3 * math.sqrt(spark.sparkContext.defaultParallelism)))
    dealt = vectors.mapInArrow(deal, "cell int, part long, key binary, id long, weight long, raw binary").repartition(
        int(min(parts, blocks.sum())), "cell", "part")
    packed = stage(dealt.groupBy("cell", "part").applyInArrow(
        pack, "no long, cell int, meets array<int>, ids binary, weights binary, raw binary"), "blocks")
    left, right = (packed.select(*[F.col(c).alias(f"{c}{k}") for c in packed.columns]) for k in "12")
    # A product by Spark's own hint: nothing is shuffled, and no side is broadcast.
    pairs = left.hint("shuffle_replicate_nl").join(right, F.expr("no1 <= no2 AND array_contains(meets1, cell2)")).select(
        "no1", "cell1", "ids1", "weights1", "raw1", "no2", "cell2", "ids2", "weights2", "raw2")

    def compare(batches):
        def side(b, r, k):
            cell, ids, weight, raw = (b.column(5 * k + i)[r].as_py() for i in range(1, 5))
            unit = _unit(np.frombuffer(raw, number).reshape(-1, dims))
            return cell, np.frombuffer(ids, np.int64), np.frombuffer(weight, np.int64).astype(np.float64), unit, unit @ pivot.T

        known, own = None, None
        for b in batches:
            out = [[np.zeros(0, np.int64)] * 3]
            for r in range(b.num_rows):
                no, partner = b.column(0)[r].as_py(), b.column(5)[r].as_py()
                if no != known:
                    known, own = no, side(b, r, 0)
                p, own_id, own_weight, unit, dots = own
                q, other_id, other_weight, other, other_dots = own if partner == no else side(b, r, 1)
                at = [None, None]
                if p != q:
                    x = np.flatnonzero(_reaching(dots, q, gap, reach, radius))
                    y = np.flatnonzero(_reaching(other_dots, p, gap, reach, radius))
                    along, beside = ((d[:, q] - d[:, p]) / gap[p, q] for d in (dots[x], other_dots[y]))
                    i, j = np.argsort(-along), np.argsort(beside)
                    x, y, at = x[i], y[j], [along[i], beside[j]]
                    own_id, own_weight, unit, other_id, other_weight, other = own_id[x], own_weight[x], unit[x], other_id[y], other_weight[y], other[y]
                own_n, other_n, a, z = join_block(unit, other, own_id, other_id, own_weight, other_weight, cosine, *at, radius)
                sides = [(own_id, own_n)] if partner == no else [(own_id, own_n), (other_id, other_n)]
                out += [[i[k > 0], np.full((k > 0).sum(), -1), k[k > 0]] for i, k in sides]
                out.append([a, z, np.zeros(len(a), np.int64)])
            a, z, k = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z), pa.array(k), pa.array(k == 0)], names=["a", "b", "n", "link"])

    found = stage(pairs.mapInArrow(compare, "a long, b long, n long, link boolean"), "links")
    return found.where("not link").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("links")), found.where("link").select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding",
                    block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``."""
    of = vectors.schema[embedding].dataType
    kind = "float" if isinstance(of, T.ArrayType) and isinstance(of.elementType, T.FloatType) else "double"
    number = "<f4" if kind == "float" else "<f8"
    picked = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("e"))

    def known(batches):
        for b in batches:
            flat, at, ok = _numbers(b, number)
            keys = [_digest(flat[at[i] : at[i + 1]]) if ok[i] else None for i in range(len(ok))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(np.diff(at).astype(np.int32))], names=["vec_id", "key", "dims"])

    rows = stage(picked.mapInArrow(known, "vec_id long, key binary, dims int"), "rows")
    # Classes are known by the least id; a repeated id may stand for two of them.
    lengths = rows.where("key is not null").groupBy("dims").agg(F.count(F.lit(1)).alias("n")).collect()  # a model has one; a few at most
    parts = [_join(picked, number, r["dims"], r["n"], cosine, block, pivots) for r in lengths]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts, links = parts[0]
    for c, x in parts[1:]:
        counts, links = counts.union(c), links.union(x)
    joined = components(links.distinct())
    classes = rows.where("key is not null").groupBy(F.col("key").alias("of")).agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    labels = classes.join(counts, "id", "left").join(joined, F.col("id") == F.col("node"), "left").select(
        "of", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    out = rows.select("vec_id", "key").join(stage(labels, "labels"), F.col("key") == F.col("of"), "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
