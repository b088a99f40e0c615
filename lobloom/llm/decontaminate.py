"""Benchmark decontamination by a broadcast hash set of normalised n-grams.

Items (test questions) give windows of ``width`` consecutive words; an item with
fewer words, but not none, is one window. The windows' hashes go to every task
as one sorted array; each document's word windows are looked up in it and every
hit is verified word by word. Documents are scanned where they are read: no
shuffle. Hit words can be cut out as spans, or whole documents dropped.

The broadcast set is bounded by ``broadcast_windows``. Larger benchmarks take
the join path: document windows meet item windows in an equi-join on the hash,
and each document is then verified against its own candidates only.

Defined cases: a null or empty text has no words; rows with the same id are
judged one by one; an item with a null id marks words but is not listed; columns
of ``docs`` other than id and text are carried through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh, result_name
from .textbatch import Words, binary_list, column_chunks, covered, runs_hash

WIDTH = 10
BROADCAST_WINDOWS = 2_000_000  # about 100 bytes each with their words

_RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.LongType())), T.StructField("clean_text", T.StringType())])


def item_windows(items: DataFrame, width: int = WIDTH, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(n, hash, words, item): every window of every item, its words space-joined."""

    def cut(batches):
        for b in batches:
            for first, texts in column_chunks(b.column(1)):
                w = Words(texts)
                rows = []
                for k, n in enumerate(w.per_doc):
                    size = min(width, int(n))
                    for at in range(w.first[k], w.first[k] + n - size + 1 if n else w.first[k]):
                        rows.append((size, w.text_of(at, size), first + k, at))
                if not rows:
                    continue
                starts = np.array([r[3] for r in rows])
                sizes = np.array([r[0] for r in rows])
                h = runs_hash(w.hashes, starts, starts + sizes)
                ids = b.column(0).take(pa.array([r[2] for r in rows]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sizes.astype(np.int32)), pa.array(h.view(np.int64)),
                     pa.array([r[1] for r in rows], pa.binary()), ids.cast(pa.int64())],
                    names=["n", "hash", "words", "item"])

    return items.select(item_id, text).mapInArrow(cut, "n int, hash long, words binary, item long").distinct()


class WindowTable:
    """Hashes of item windows by length, with words and items for verification."""

    def __init__(self, rows):
        owners: dict[bytes, list] = defaultdict(list)
        hashes: dict[int, set] = defaultdict(set)
        for n, h, words, item in rows:
            owners[bytes(words)].append(item)
            hashes[n].add(h)
        self.owners = dict(owners)
        self.hashes = {n: np.sort(np.fromiter(hs, np.int64, len(hs)).view(np.uint64)) for n, hs in hashes.items()}

    def hits(self, w: Words):
        """(first word, number of words, items) of verified windows in a chunk."""
        for n, known in self.hashes.items():
            at, h = w.windows(n)
            if len(at) == 0:
                continue
            slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
            for i in at[known[slot] == h]:
                found = self.owners.get(w.text_of(i, n))
                if found is not None:
                    yield int(i), n, found


def _judge(w: Words, table: WindowTable, texts: list[bytes]):
    """Columns of ``_RESULT`` for each text of a chunk."""
    starts, ends, items = [], [], defaultdict(set)
    for at, n, found in table.hits(w):
        starts.append(at)
        ends.append(at + n)
        items[int(w.doc_of(np.int64(at)))].update(i for i in found if i is not None)
    hit = covered(np.array(starts, np.int64), np.array(ends, np.int64), len(w.starts))
    running = np.concatenate([[0], np.cumsum(hit)])
    n_hit = running[w.first[1:]] - running[w.first[:-1]]
    clean = []
    for k, t in enumerate(texts):
        if n_hit[k]:
            clean.append(_without(t, w, k, hit).decode("utf-8", "replace"))
        else:
            clean.append(t.decode("utf-8", "replace"))
    return w.per_doc, n_hit, [sorted(items.get(k, ())) for k in range(len(texts))], clean


def _without(text: bytes, w: Words, k: int, hit: np.ndarray) -> bytes:
    """The text without its hit words and what stands between them."""
    lo, hi, base = w.first[k], w.first[k + 1], w.doc_at[k]
    edge = np.diff(hit[lo:hi].astype(np.int8), prepend=0, append=0)
    out, last = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(text[last : w.starts[lo + a] - base])
        last = w.ends[lo + b - 1] - base
    out.append(text[last:])
    return b"".join(out)


def scan(docs: DataFrame, items: DataFrame, width: int = WIDTH, text: str = "text",
         broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Adds struct ``decontamination`` (n_words, n_hit, items, clean_text) to ``docs``."""
    windows = item_windows(items, width)
    held = windows.limit(broadcast_windows + 1).collect()
    if len(held) > broadcast_windows:
        return _scan_joined(docs, windows, text)
    shared = docs.sparkSession.sparkContext.broadcast(WindowTable(held))
    return _apply(docs, text, None, shared)


def _apply(docs: DataFrame, text: str, own_table: str | None, shared) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(result_name(docs, "decontamination"), _RESULT)])
    at = docs.columns.index(text)
    kinds = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("clean_text", pa.string())]

    def judge(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            if own_table:
                given = b.column(b.num_columns - 1).to_pylist()
                parts = (([t], WindowTable([(c["n"], c["hash"], c["words"], c["item"]) for c in given[i] or ()]))
                         for i, t in enumerate(binary_list(b.column(at))))
            else:
                parts = ((chunk, shared.value) for _, chunk in column_chunks(b.column(at)))
            for chunk, table in parts:
                for col, values in zip(cols, _judge(Words(chunk), table, chunk), strict=True):
                    col.extend(values)
            result = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(cols, kinds, strict=True)], names=[n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays([*b.columns, result], names=schema.names)

    return docs.mapInArrow(judge, schema)


def _scan_joined(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """The path for a benchmark too large to broadcast."""
    sizes = [r.n for r in windows.select("n").distinct().collect()]  # at most ``width`` values

    def cut(batches):
        for b in batches:
            for first, texts in column_chunks(b.column(1)):
                w = Words(texts)
                for n in sizes:
                    at, h = w.windows(n)
                    pairs = np.unique(np.stack([w.doc_of(at).astype(np.uint64), h]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(pairs[0].astype(np.int64) + first)), pa.array(np.full(pairs.shape[1], n, np.int32)), pa.array(pairs[1].view(np.int64))],
                        names=["row", "n", "hash"])

    # Rows are told apart by their text's digest, not by an id that may repeat.
    row, of, given = fresh(docs, "row"), fresh(docs, "of"), fresh(docs, "candidates")
    keyed = docs.withColumn(row, F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")), 256))
    seen = keyed.select(row, f"`{text}`").mapInArrow(cut, "row string, n int, hash long").distinct()
    found = seen.join(windows, ["n", "hash"]).groupBy(F.col("row").alias(of)).agg(
        F.collect_set(F.struct("n", "hash", "words", "item")).alias(given))
    joined = keyed.join(found, keyed[row] == found[of], "left").drop(row, of)
    return _apply(joined, text, given, None).drop(given)


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, remove: str = "documents", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or without their hit spans (``remove="spans"``)."""
    judged = scan(docs, items, width, text)
    name = result_name(docs, "decontamination")
    if remove == "documents":
        return judged.where(F.col(f"{name}.n_hit") == 0).drop(name)
    return judged.withColumn(text, F.when(F.col(f"`{text}`").isNotNull(), F.col(f"{name}.clean_text"))).drop(name)


def items_digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in items)).encode()).hexdigest()
