"""Exact substring de-duplication by threshold-bounded interval expansion on a BWT.

A byte is removed if it lies in a string of ``length`` bytes that also starts in a
document with a smaller doc_id. Documents are cut into units that can be compared
apart from each other, and the Burrows-Wheeler work is done per unit group:

1. Every window of ``length`` bytes has an anchor: its leftmost smallest-hash run of
   ``GRAM`` bytes. Equal windows have equal anchors, so windows can only meet under
   one anchor. Neighbouring windows with the same anchor form one stretch; there
   are about ``2 / (length - GRAM + 2)`` stretches for each byte.
2. Stretches meet by anchor. A stretch that an earlier document holds unchanged is
   covered whole. Where stretches of one anchor differ (around edits and the ends
   of shared passages), the first holder of each different stretch is looked at
   byte by byte; all else needs no bytes.
3. Those that agree with another one on half a window beside the anchor are laid end to end, suffix-sorted, and turned into a BWT.
   Backward extension, breadth first over all intervals at once, derives common
   prefixes of 1, 2, 3 … bytes; intervals with one suffix drop out, and expansion
   stops at ``length``. In each interval left, the smallest doc_id covers the rest.

An anchor with more than ``GROUP`` different stretches (a short phrase in very many
contexts) would be one large task. Its windows are dealt out by a 128-bit digest
instead: the smallest doc_id of each window is aggregated where the rows are and
joined back, a join that Spark can split.

Anchors are 64-bit hashes and stretches under an anchor are compared by a further
48-bit hash. Defined cases: a null text is empty; matches never cross documents;
rows that repeat an id count as the same document (an id names one text); rows
with a null id neither cover nor lose anything; other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import parallel
from .textbatch import binary_list, column_chunks, covered, mix, runs_hash

LENGTH = 50
GRAM = 20
GROUP = 20_000  # about 2 MB of bytes in one task
SEGMENT = 1 << 20  # starts looked at together
BWT_BYTES = 1 << 20
BUCKETS_PER_PARTITION = 8
_PLACE = np.uint64((1 << 22) - 1)


def stretches(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """(text, first start, windows, place of the anchor, anchor hash, content hash) of every stretch."""
    out = []
    for k, text in enumerate(texts):
        if len(text) > SEGMENT:  # a long text in parts that share length - 1 bytes
            for lo in range(0, len(text) - length + 1, SEGMENT):
                at, *rest = _stretches([text[lo : lo + SEGMENT + length - 1]], length, gram)[1:]
                out.append((np.full(len(at), k), at + lo, *rest))
    short = [k for k, t in enumerate(texts) if length <= len(t) <= SEGMENT]
    if short:
        doc, *rest = _stretches([texts[k] for k in short], length, gram)
        out.append((np.array(short)[doc], *rest))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _stretches(texts: list[bytes], length: int, gram: int):
    raw = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    grams = np.arange(len(raw) - gram + 1)
    h = runs_hash(raw, grams, grams + gram)
    # Hash and place in one number: the least is the leftmost smallest hash.
    low = (h & ~_PLACE) | grams.astype(np.uint64)
    width, have = length - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    starts = np.arange(len(low))
    doc = np.searchsorted(begin, starts, side="right") - 1
    ok = starts + length <= begin[doc + 1]
    starts, doc, place = starts[ok], doc[ok], (low[ok] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(place) != 0) | (np.diff(doc) != 0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    at = starts[first]
    content = mix(runs_hash(raw, at, at + n + length - 1) ^ np.uint64(0x2545F4914F6CDD1D))
    return doc[first], at - begin[doc[first]], n, place[first] - at, h[place[first]], content


def suffix_order(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols at least, and the place of each."""
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(7):  # seven symbols of nine bits in one number
        key = (key << np.uint64(9)) | padded[i : i + n]
    rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
    have = 7
    while have < depth:
        behind = np.zeros(n, np.int64)
        behind[:-have] = rank[have:] + 1
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1].astype(np.int64)
        have *= 2
    order = np.argsort(rank, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def intervals(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix starts, interval numbers): suffixes that share ``length`` symbols with another one.

    Backward extension on the BWT, breadth first: the suffixes that begin with c
    and go on with an l-interval's prefix are the images of the interval's rows
    whose preceding symbol is c, and form one (l+1)-interval.
    """
    order, place = suffix_order(symbols, length)
    n = len(order)
    # The row of each suffix without its first symbol: the inverse of extending backward.
    shorter = place[np.minimum(order + 1, n - 1)]
    first = symbols[order]
    interval = np.zeros(n, np.int64)
    rows = np.flatnonzero(order + 1 < n)
    alive = np.ones(n, bool)
    for _ in range(length):
        # A suffix can only stay if its shorter one is still together with another.
        rows = rows[alive[shorter[rows]]]
        if len(rows) == 0:
            break
        below, head = interval[shorter[rows]], first[rows]
        edge = np.ones(len(rows), bool)
        edge[1:] = (below[1:] != below[:-1]) | (head[1:] != head[:-1])
        number = np.cumsum(edge)
        several = np.bincount(number)[number] > 1
        rows, number = rows[several], number[several]
        alive = np.zeros(n, bool)
        alive[rows] = True
        interval = np.zeros(n, np.int64)
        interval[rows] = number
    return order[rows], interval[rows]


def covered_windows(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, first window, end window) of windows that a string of a smaller doc holds too."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    # Symbols: 0 ends each string, bytes count from 1 to 256.
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    raw[begin[1:] - 1] = 0
    at, number = intervals(raw, length)
    owner = np.searchsorted(begin, at, side="right") - 1
    inside = at + length <= begin[owner + 1] - 1
    at, number, owner = at[inside], number[inside], owner[inside]
    if len(at) == 0:
        return []
    _, number = np.unique(number, return_inverse=True)
    least = np.full(number.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, number, docs[owner])
    hit = np.sort(at[least[number] < docs[owner]])
    if len(hit) == 0:
        return []
    cut = np.flatnonzero(np.diff(hit) != 1) + 1
    firsts, lasts = hit[np.append(0, cut)], hit[np.append(cut - 1, len(hit) - 1)]
    owner = np.searchsorted(begin, firsts, side="right") - 1
    return list(zip(owner.tolist(), (firsts - begin[owner]).tolist(), (lasts + 1 - begin[owner]).tolist(), strict=True))


def _planes(values: np.ndarray, size: int) -> bytes:
    """Integers as ``size`` planes of one byte each, lowest first, which compress well."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(raw: bytes, n: int, size: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, n).T
    return out.view("<u8").reshape(-1)


# Bytes of each number of a stretch: steps between sorted anchors, content (48 bits), document, start, windows, place.
_SIZES = (8, 6, 8, 5, 1, 1)


def _pack(columns: list[np.ndarray]) -> bytes:
    anchor = np.sort(columns[0])
    order = np.argsort(columns[0], kind="stable")
    steps = np.diff(anchor, prepend=np.uint64(0))
    body = b"".join(_planes(c, size) for c, size in zip([steps, *(c[order] for c in columns[1:])], _SIZES, strict=True))
    return len(anchor).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes) -> list[np.ndarray]:
    n = int.from_bytes(blob[:4], "little")
    body, out, at = zstandard.ZstdDecompressor().decompress(blob[4:]), [], 0
    for size in _SIZES:
        out.append(_from_planes(body[at : at + n * size], n, size))
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _meet(columns: list[np.ndarray], group: int) -> pa.RecordBatch:
    """Among all stretches of some anchors: those held earlier, and those to be looked at."""
    anchor, content, doc, start, windows, place = columns
    doc = doc.view(np.int64)
    order = np.lexsort((doc, content, anchor))
    anchor, content, doc, start, windows, place = (c[order] for c in (anchor, content, doc, start, windows, place))
    new_anchor = np.ones(len(anchor), bool)
    new_anchor[1:] = anchor[1:] != anchor[:-1]
    new_content = new_anchor.copy()
    new_content[1:] |= content[1:] != content[:-1]
    firsts = np.flatnonzero(new_anchor)
    of = np.cumsum(new_anchor) - 1
    earliest, latest = np.minimum.reduceat(doc, firsts), np.maximum.reduceat(doc, firsts)
    different = np.add.reduceat(new_content.astype(np.int64), firsts)[of]
    holder = doc[np.flatnonzero(new_content)][np.cumsum(new_content) - 1]
    shared = (earliest < latest)[of]
    whole = shared & (doc > holder)
    take = np.flatnonzero(whole | (shared & (doc == holder) & (different > 1)))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.where(whole, 0, anchor.view(np.int64))[take], mask=whole[take]), pa.array(doc[take]), pa.array(start[take].view(np.int64)),
         pa.array(windows[take].view(np.int64)), pa.array(place[take].view(np.int64)), pa.array((different > group)[take])],
        names=["anchor", "doc_id", "start", "windows", "place", "hot"])


def shared_stretches(docs: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """Stretches of docs(doc_id, text) that matter: (anchor, doc_id, start, windows, place, hot).

    ``anchor`` is null where an earlier document holds the whole stretch; other rows
    are first holders of a stretch whose anchor another document has with different
    bytes. Each task sends its stretches, sorted and compressed, to ranges of anchors;
    all of an anchor meets in one range, and a range holds an even share of them.
    """
    buckets = BUCKETS_PER_PARTITION * parallel(docs)
    edges = (np.arange(1, buckets, dtype=np.float64) * (2.0**64 / buckets)).astype(np.uint64)

    def cut(batches):
        for b in batches:
            ids = np.asarray(b.column(0)).view(np.uint64)
            parts = []
            for first, texts in column_chunks(b.column(1)):
                doc, at, n, place, anchor, content = stretches(texts, length, gram)
                parts.append((anchor, content >> np.uint64(16), ids[doc + first], at, n, place))
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else []
            if not columns or not len(columns[0]):
                continue
            order = np.argsort(columns[0])
            columns = [c[order] for c in columns]
            cuts = np.concatenate([[0], np.searchsorted(columns[0], edges), [len(order)]])
            full = np.flatnonzero(np.diff(cuts))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.array([_pack([c[cuts[i] : cuts[i + 1]] for c in columns]) for i in full], pa.binary())],
                names=["bucket", "blob"])

    def meet(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        while held:
            _, blobs = held.popitem()
            yield _meet([np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)], group)

    sent = docs.where("doc_id is not null and text is not null").mapInArrow(cut, "bucket int, blob binary")
    return sent.repartition("bucket").mapInArrow(meet, "anchor long, doc_id long, start long, windows long, place long, hot boolean")


def _read(docs: DataFrame, wanted: DataFrame, length: int, of_text, schema: str) -> DataFrame:
    """Rows of ``of_text(doc_id, text, wanted stretches)`` for every document with wanted stretches."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "windows", "place")).alias("wanted"))  # within one text
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def read(batches):
        for b in batches:
            rows = []
            for doc, text, wants in zip(b.column(0).to_pylist(), binary_list(b.column(1)), b.column(2).to_pylist(), strict=True):
                for q in wants:
                    body = text[q["start"] : q["start"] + q["windows"] + length - 1]
                    if len(body) == q["windows"] + length - 1:
                        rows += of_text(doc, q, body)
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.join(by_doc, "doc_id").select("doc_id", "text", "wanted").mapInArrow(read, schema)


def _may_match(rows: list[dict], group_of: np.ndarray, docs: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Stretches that share half a window around the anchor with another document.

    A common window reaches at least half of its other bytes before or behind the
    anchor, so stretches that agree on neither side have none.
    """
    bodies = [r["body"] for r in rows]
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    at = begin + np.fromiter((r["place"] for r in rows), np.int64, len(rows))
    reach = (length - gram) // 2
    keep = np.zeros(len(rows), bool)
    for lo, hi in ((at - reach, at + gram), (at, at + gram + reach)):
        ok = np.flatnonzero((lo >= begin) & (hi <= begin + sizes))
        key = runs_hash(raw, lo[ok], hi[ok]) ^ mix(group_of[ok].astype(np.uint64))
        order = np.lexsort((docs[ok], key))
        key, doc = key[order], docs[ok][order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        if len(key):
            first = np.flatnonzero(new)
            several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            keep[ok[order]] |= several[np.cumsum(new) - 1]
    return keep


def _expand(bodies: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc_id, start, end) of bytes covered inside differing stretches, by BWT."""
    groups = bodies.groupBy("anchor").agg(F.collect_list(F.struct("doc_id", "start", "place", "body")).alias("m"))

    def work(batches):
        held: list[dict] = []
        size = 0
        for b in batches:
            rows = b.column(1).flatten().to_pylist()
            group_of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column(1).offsets)))
            if not rows:
                continue
            docs = np.fromiter((r["doc_id"] for r in rows), np.int64, len(rows))
            for i in np.flatnonzero(_may_match(rows, group_of, docs, length, gram)):
                # Whole groups only: a group is never cut between two expansions.
                if size >= BWT_BYTES and (i == 0 or group_of[i] != group_of[i - 1]):
                    yield spans(held)
                    held, size = [], 0
                held.append(rows[i])
                size += len(rows[i]["body"])
        if held:
            yield spans(held)

    def spans(rows):
        found = covered_windows([r["body"] for r in rows], np.array([r["doc_id"] for r in rows], np.int64), length)
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[k]["doc_id"] for k, _, _ in found], pa.int64()), pa.array([rows[k]["start"] + a for k, a, _ in found], pa.int64()),
             pa.array([rows[k]["start"] + b + length - 1 for k, _, b in found], pa.int64())], names=["doc_id", "start", "end"])

    return groups.mapInArrow(work, "doc_id long, start long, end long")


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, spans): covered byte ranges [start, end), overlapping and unsorted, of docs(doc_id, text)."""
    shared = stage(shared_stretches(docs, length, gram, group), "stretches")
    whole = shared.where("anchor is null").select("doc_id", "start", (F.col("start") + F.col("windows") + length - 1).alias("end"))

    def bytes_of(doc, q, body):
        return [(q["anchor"], doc, q["start"], q["place"], body)]

    def digests_of(doc, q, body):
        raw, at = np.frombuffer(body, np.uint8), np.arange(q["windows"])
        h1 = runs_hash(raw, at, at + length).view(np.int64).tolist()
        h2 = runs_hash(mix(raw.astype(np.uint64) + np.uint64(7)), at, at + length).view(np.int64).tolist()
        return [(a, b, doc, q["start"] + i) for i, (a, b) in enumerate(zip(h1, h2, strict=True))]

    bodies = _read(docs, shared.where("anchor is not null and not hot"), length, bytes_of, "anchor long, doc_id long, start long, place long, body binary")
    inside = _expand(bodies, length, gram)
    windows = stage(_read(docs, shared.where("anchor is not null and hot"), length, digests_of, "h1 long, h2 long, doc_id long, start long"), "windows")
    least = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    dealt = windows.join(stage(least, "least"), ["h1", "h2"]).where("doc_id > least").select("doc_id", "start", (F.col("start") + length).alias("end"))
    return whole.union(inside).union(dealt).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row; ``kept`` is what stays, as bytes."""
    if (doc_id, text) != ("doc_id", "text") or dict(docs.dtypes)[doc_id] != "bigint":
        docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pairs = docs.select("doc_id", "text")
    # The same rows as in the joins of removed_spans, so that their shuffle serves twice.
    known = pairs.where("doc_id is not null")
    spans = removed_spans(known, length, gram, group)
    unknown = pairs.where("doc_id is null").withColumn("spans", F.lit(None).cast("array<struct<start: bigint, end: bigint>>"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for b in batches:
            texts = binary_list(b.column(1))
            removed, runs, kept = [], [], []
            column = b.column(2)
            offsets, values = np.asarray(column.offsets), column.values
            starts, ends = np.asarray(values.field(0)), np.asarray(values.field(1))
            for i, t in enumerate(texts):
                lo, hi = offsets[i], offsets[i + 1]
                if lo == hi or not column[i].is_valid:
                    removed.append(0)
                    runs.append(0)
                    kept.append(t)
                    continue
                gone = covered(np.minimum(starts[lo:hi], len(t)), np.minimum(ends[lo:hi], len(t)), len(t))
                removed.append(int(gone.sum()))
                runs.append(int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1)))
                kept.append(np.frombuffer(t, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=schema.names)

    return known.join(spans, "doc_id", "left").select("doc_id", "text", "spans").union(unknown).mapInArrow(cut, schema)
