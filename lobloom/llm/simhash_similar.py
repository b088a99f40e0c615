"""SimHash near-duplicates at a shingle similarity, by the byte-position index.

For a similarity of 0.8 on 5-word shingles the fingerprints of two documents differ
in about 15 % of their bits, far beyond what 64 bits can index. The same method
works with wide fingerprints. A fingerprint has ``BANDS * BAND_BYTES`` bytes, each
with its position:

* The distinct shingles of a document are hashed into a signed vector (eight places
  each of ``DIMS``), and every bit is the sign of its product with a fixed random
  direction.
* Posting lists are kept for runs of ``BAND_BYTES`` positional bytes; the positions are
  dealt to runs ``ROUNDS`` times over, each time in another order. A posting carries
  ``SLICE`` bytes of the fingerprint: a member stays in its list only if another
  one's slice is near enough for a pair at the threshold. Chance meetings, which grow
  with the square of the corpus, end there, and whole fingerprints are fetched once
  for lists of the same members.
* Members of a list are tallied: a pair goes on if it shares as many positional
  bytes as a pair at the threshold does, less three standard deviations, and differs
  in as many bits, plus three standard deviations (of the bits and of the sketch).
* Groups that hang together by such pairs are joined with their distinct shingles,
  and a pair is linked only if its sets are alike by count.

With the defaults a pair at 0.8 meets in some list with probability 0.99. Equal
fingerprints are one class and one posting. Lists longer than ``LIST`` and groups of
more than ``LIST`` members or ``GROUP_BYTES`` are compared block against block in
tasks of bounded size; each task returns the links of a spanning forest.

Defined cases: null and empty texts have no shingles and are equal to each other; a
text with fewer words than a shingle is one shingle; rows that repeat an id are one
document, linked by any of its texts; rows with a null id have no component; further
columns may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import components, fresh
from .textbatch import Words, column_chunks, runs_hash

WORDS = 5
SIMILARITY = 0.8
DIMS = 1_024
PLACES = 8
BANDS = 128
BAND_BYTES = 3
ROUNDS = 2
SLICE = 8
LIST = 2_048
GROUP_BYTES = 8 << 20
BROADCAST_ROWS = 500_000
SEED = 42


def _directions(bits: int) -> np.ndarray:
    return np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), size=(DIMS, bits))


def _runs(bands: int, band_bytes: int) -> np.ndarray:
    """Byte positions of each run, in every round."""
    orders = np.random.default_rng(SEED + 1)
    width = bands * band_bytes
    rounds = [np.arange(width)] + [orders.permutation(width) for _ in range(ROUNDS - 1)]
    return np.concatenate(rounds).reshape(ROUNDS * bands, band_bytes)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of each text, in order."""
    w = Words(texts)
    at, h = w.windows(words)
    few = np.flatnonzero((w.per_doc > 0) & (w.per_doc < words))
    doc = np.concatenate([w.doc_of(at), few])
    h = np.concatenate([h, runs_hash(w.hashes, w.first[few], w.first[few + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def sketch(texts: list[bytes], words: int, directions: np.ndarray) -> np.ndarray:
    """Fingerprints, one row of bytes for each text."""
    doc, h = shingles(texts, words)
    vector = np.zeros(len(texts) * DIMS)
    for i in range(PLACES):
        # Ten bits of place and one of sign for each of the places, from a fresh mixture of the hash.
        g = (h ^ np.uint64(i + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        g = (g ^ (g >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        place = doc * DIMS + (g >> np.uint64(54)).astype(np.int64)
        vector += np.bincount(place, 1.0 - 2.0 * ((g >> np.uint64(20)) & np.uint64(1)).astype(np.float64), len(vector))
    signs = vector.reshape(len(texts), DIMS).astype(np.float32) @ directions > 0
    return np.packbits(signs, axis=1)


def threshold(similarity: float, width: int, deviations: int = 3) -> tuple[int, int]:
    """(least number of shared positional bytes, most differing bits) for fingerprints of ``width`` bytes."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    same = (1 - differ) ** 8
    bits = 8 * width
    # Shingles that meet in one of DIMS places move the cosine by (1 - cos^2) / sqrt(DIMS), the angle by sin / sqrt(DIMS).
    sketched = math.sin(math.pi * differ) / math.sqrt(DIMS) / math.pi
    deviation = math.sqrt(bits * differ * (1 - differ) + (bits * sketched) ** 2)
    return int(width * same - deviations * math.sqrt(width * same * (1 - same))), int(differ * bits + deviations * deviation)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of ``least`` or more; empty sets are equal."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) == 0:
        return True
    if len(a) < least * len(b) - 1e-9:
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both >= least * (len(a) + len(b) - both) - 1e-9


def _forest(prints: np.ndarray, ids: list, left_of: np.ndarray, right_of: np.ndarray, bytes_shared: int, bits: int,
            sets: list[np.ndarray] | None = None, least: float = 0.0) -> list:
    """Links of a spanning forest among pairs (left, right) that pass the tally, the bits and, with ``sets``, the exact count."""
    links, waiting = [], right_of.copy()
    todo_left = left_of.copy()
    for start in np.flatnonzero(left_of):
        if not todo_left[start]:
            continue
        todo_left[start] = waiting[start] = False
        reached = [start]
        while reached:
            i = reached.pop()
            rest = np.flatnonzero((waiting if left_of[i] else np.zeros_like(waiting)) | (todo_left if right_of[i] else np.zeros_like(waiting)))
            if len(rest) == 0:
                continue
            rest = rest[(prints[rest] == prints[i]).sum(axis=1) >= bytes_shared]
            near = rest[np.bitwise_count(prints[rest] ^ prints[i]).sum(axis=1, dtype=np.int64) <= bits]
            if sets is not None:
                near = near[np.array([alike(sets[i], sets[j], least) for j in near.tolist()], bool)]
            waiting[near] = todo_left[near] = False
            links.extend((ids[i], ids[j]) for j in near.tolist())
            reached.extend(near.tolist())
    return links


def _blocked(members: DataFrame, key: str) -> DataFrame:
    """(rep, task, own) of members(key, rep, blocks): each meets its own block and every other one, as (smaller, larger) block."""
    held = members.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    held = held.select(key, "rep", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return held.select("rep", F.struct(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"), "own")


def _shingle_sets(pairs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(rep, shingles): sorted 64-bit hashes of the distinct shingles of the wanted(doc_id), one row for each of its texts."""
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)

    def scan(batches):
        for b in batches:
            sets = []
            for _, part in column_chunks(b.column(1)):
                doc, h = shingles(part, words)
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                sets += [h[lo:hi].tobytes() for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return pairs.join(wanted, "doc_id").select("doc_id", "text").mapInArrow(scan, "rep long, shingles binary").distinct()


def _near_members(slices: np.ndarray, bits: int) -> np.ndarray:
    """Marks members that another one's slice is near to."""
    near = np.zeros(len(slices), bool)
    for at in range(0, len(slices), 256):
        apart = np.bitwise_count(slices[at : at + 256, None] ^ slices[None, :])
        near[at : at + 256] = (apart <= bits).sum(axis=1) > 1  # each is near to itself
    return near


def _meetings(bits: int, longest: int):
    """Reads postings (key, rep, slice) in order of their keys.

    Gives (members, null, null) for each list, and (null, key, rep) for members of lists longer than ``longest``.
    """
    def scan(batches):
        key, rep, part = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hot = None
        for b in batches:
            key = np.concatenate([key, np.asarray(b.column(0))])
            rep = np.concatenate([rep, np.asarray(b.column(1))])
            part = np.concatenate([part, np.asarray(b.column(2)).view(np.uint64)])
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            # The last list may go on in the next batch, unless it is too long already.
            done = len(starts) - (sizes[-1] <= longest and key[-1] != hot)
            over = (sizes > longest) | (key[starts] == hot)
            yield from out(key, rep, part, starts[:done], sizes[:done], over[:done])
            cut = starts[done] if done < len(starts) else len(key)
            hot = int(key[-1]) if cut == len(key) else None
            key, rep, part = key[cut:], rep[cut:], part[cut:]
        if len(key):
            yield from out(key, rep, part, np.array([0]), np.array([len(key)]), np.array([False]))

    def out(key, rep, part, starts, sizes, over):
        two = starts[(sizes == 2) & ~over]
        two = two[np.bitwise_count(part[two] ^ part[two + 1]) <= bits]
        lists = np.sort(np.stack([rep[two], rep[two + 1]], axis=1), axis=1).tolist()
        for at, n in zip(starts[(sizes > 2) & ~over].tolist(), sizes[(sizes > 2) & ~over].tolist(), strict=True):
            near = _near_members(part[at : at + n], bits)
            if near.any():
                lists.append(np.sort(rep[at : at + n][near]).tolist())
        long = np.repeat(over, sizes)
        if len(starts):
            rest = np.flatnonzero(long) + starts[0]
            lone = [None] * len(rest)
            if lists or len(rest):
                none = pa.nulls(len(lists), pa.int32()), pa.nulls(len(lists), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(lists + lone, pa.list_(pa.int64())), pa.concat_arrays([none[0], pa.array(key[rest], pa.int32())]),
                    pa.concat_arrays([none[1], pa.array(rep[rest], pa.int64())])], names=["members", "key", "rep"])

    return scan


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, bands: int = BANDS, band_bytes: int = BAND_BYTES,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, component_id) of every row with an id; a component's smallest id names it."""
    width = bands * band_bytes
    fewest, most = threshold(similarity, width)

    def scan(batches):
        directions = _directions(8 * width)
        for b in batches:
            prints = [row.tobytes() for _, part in column_chunks(b.column(1)) for row in sketch(part, words, directions)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary())], names=["doc_id", "print"])

    pairs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    prints = stage(pairs.mapInArrow(scan, "doc_id long, print binary"), "prints")
    classes = stage(prints.groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")

    runs = _runs(bands, band_bytes)

    def post(batches):
        for b in batches:
            p = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, width)[:, runs].astype(np.int64)
            key = np.zeros(p.shape[:2], np.int64)
            for i in range(band_bytes):
                key = (key << 8) | p[:, :, i]
            key |= np.arange(len(runs))[None, :] << (8 * band_bytes)
            part = np.ascontiguousarray(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, width)[:, :SLICE]).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([
                pa.array(key.reshape(-1).astype(np.uint32).view(np.int32)), b.column(1).take(pa.array(np.repeat(np.arange(len(p)), len(runs)))),
                pa.array(np.repeat(part, len(runs)))], names=["key", "rep", "slice"])

    postings = classes.select("print", "rep").mapInArrow(post, "key int, rep long, slice long")
    met = stage(postings.repartition("key").sortWithinPartitions("key").mapInArrow(
        _meetings(threshold(similarity, SLICE, 4)[1], LIST), "members array<long>, key int, rep long"), "meetings")
    short = stage(met.where("members IS NOT NULL").select("members").distinct(), "lists").select(
        F.monotonically_increasing_id().alias("key"), "members")
    short = short.select(F.explode("members").alias("rep"), F.struct("key", F.lit(0).alias("i"), F.lit(0).alias("j")).alias("task"), F.lit(0).alias("own"))
    long = met.where("members IS NULL").select((-1 - F.col("key").cast("long") - (1 << 33)).alias("key"), "rep")
    full = long.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"))
    held = short.unionByName(_blocked(long.join(full, "key"), "key"))
    lists = held.join(classes, "rep").groupBy("task").agg(F.collect_list(F.struct("rep", "own", "print")).alias("m")).where(F.size("m") > 1)

    def verify(batches):
        for b in batches:
            links = []
            for task, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = np.frombuffer(b"".join(r["print"] for r in m), np.uint8).reshape(len(m), width)
                own = np.array([r["own"] for r in m])
                sets = [np.frombuffer(r["shingles"], np.uint64) for r in m] if "shingles" in m[0] else None
                links += _forest(p, [r["rep"] for r in m], own == task["i"], own == task["j"], fewest, most, sets, similarity)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([a for _, a in links], pa.int64())], names=["a", "b"])

    link = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    # What hangs together by fingerprints is compared again by its shingles.
    met = stage(components(lists.mapInArrow(verify, link).distinct()), "met")
    sets = stage(met.join(_shingle_sets(pairs, met.select(F.col("node").alias("doc_id")), words), F.col("node") == F.col("rep")).drop("node"), "sets")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("shingles")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("n") / LIST), F.ceil(F.col("bytes") / GROUP_BYTES), F.lit(1)).cast("int")
    grouped = _blocked(met.select("component", F.col("node").alias("rep")).join(sizes.select("component", blocks.alias("blocks")), "component"), "component")
    groups = grouped.join(sets.drop("component"), "rep").join(classes, "rep").groupBy("task").agg(
        F.collect_list(F.struct("rep", "own", "print", "shingles")).alias("m")).where(F.size("m") > 1)
    joined = components(groups.mapInArrow(verify, link).distinct())
    labels = classes.join(joined, F.col("rep") == F.col("node"), "left").select(
        F.col("print").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(stage(labels, "labels"), F.col("print") == F.col("of")).select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; null ids stay."""
    found = near_duplicates(docs, similarity, words, doc_id=doc_id, text=text)
    name = fresh(docs, "gone")
    gone = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs[doc_id] == gone[name], "left_anti")
