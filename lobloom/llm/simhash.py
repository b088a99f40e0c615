"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint of 64 bits is eight bytes, each with its position. Two fingerprints
that differ in at most ``k`` bits differ in at most ``k`` bytes, so they share at
least ``8 - k`` positional bytes: the guaranteed minimum. Posting lists of single
bytes would hold 1/256 of all documents each and grow with the square of the
input; the index therefore tallies in one step and keeps a posting list for each
choice of ``8 - k`` positional bytes. Two fingerprints meet in some list exactly
if their tally reaches the minimum. Members of a list differ in ``k`` bytes only,
so it holds at most ``256^k`` fingerprints however large the corpus is. Every list
is verified on the differing bits and gives the links of a spanning forest, never
all pairs; connected components follow.

Equal fingerprints are one class with one row in the index, so groups of copies
of any size cost one posting.

Defined cases: null and empty texts have no shingles and fingerprint zero, linked
like any other; a text with fewer words than a shingle is one shingle; repeated
rows share their class; rows with a null id get a fingerprint and the component
of their class, and never name one.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import components
from .textbatch import column_chunks

SHINGLE_CHUNK = 1 << 16
BYTES = 8


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included."""
    parts = text.lower().split()  # on bytes: A-Z, and the blanks \x20 \x09-\x0D
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)], np.uint64)
    spaced = b" ".join(parts)
    blank = np.flatnonzero(np.frombuffer(spaced, np.uint8) == 32)
    starts = [0, *(blank[: len(parts) - words] + 1).tolist()]
    ends = [*blank[words - 1 :].tolist(), len(spaced)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(spaced[a:b], seed) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, words: int, seed: int = 42) -> int:
    """The 64-bit SimHash: a bit is set if over half the shingle hashes set it."""
    h = shingle_hashes(text, words, seed)
    if len(h) == 0:
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), SHINGLE_CHUNK):
        part = h[at : at + SHINGLE_CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 5, seed: int = 42, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each text, as a signed long, to ``docs``."""
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def scan(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, words, seed) for _, texts in column_chunks(b.column(at)) for t in texts), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp.view(np.int64))], names=schema.names)

    return docs.mapInArrow(scan, schema)


def _keep_masks(k: int) -> list[tuple[int, int]]:
    """(bits kept, number) for each choice of 8 - k positional bytes."""
    masks = []
    for gone in combinations(range(BYTES), k):
        keep = (1 << 64) - 1
        for b in gone:
            keep &= ~(0xFF << (8 * b))
        masks.append(keep - (1 << 64) if keep >= 1 << 63 else keep)
    return list(zip(masks, range(len(masks)), strict=True))


def _forest(fps: np.ndarray, reps: np.ndarray, k: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among members within k bits of each other."""
    n = len(fps)
    if n == 2:
        return [(int(reps[0]), int(reps[1]))] if int(fps[0] ^ fps[1]).bit_count() <= k else []
    links = []
    left = np.ones(n, bool)
    for first in range(n):
        if not left[first]:
            continue
        left[first] = False
        reached = [first]
        while reached and left.any():
            i = reached.pop()
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= k]
            left[near] = False
            links.extend((int(reps[i]), int(reps[j])) for j in near)
            reached.extend(near.tolist())
    return links


def links(classes: DataFrame, k: int) -> DataFrame:
    """(a, b) between representatives of ``classes(fp, rep)``, enough to connect all within k bits.

    ``fp`` and ``rep`` are unique. Every linked pair lies in one component of the result.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("shared")) for m, i in _keep_masks(k)])
    postings = classes.select("fp", "rep", F.explode(keys).alias("key"))
    lists = postings.groupBy("key.choice", "key.shared").agg(F.collect_list(F.struct("fp", "rep")).alias("members"))

    def verify(batches):
        for b in batches:
            a = b.column(0)
            values, offsets = a.flatten(), np.asarray(a.offsets)
            offsets = offsets - offsets[0]
            fps = np.asarray(values.field(0)).view(np.uint64)
            reps = np.asarray(values.field(1))
            found = []
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                found.extend(_forest(fps[lo:hi], reps[lo:hi], k))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])

    return lists.where(F.size("members") > 1).select("members").mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, k: int, words: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of at most ``k`` bits.
    """
    prints = stage(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words, seed, "text").drop("text"), "fingerprints")
    classes = stage(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(links(classes.where("rep is not null"), k).distinct())
    labels = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(stage(labels, "labels"), F.col("fingerprint") == F.col("fp"), "left").drop("fp")
