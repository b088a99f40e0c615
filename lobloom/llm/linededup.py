"""Fuzzy line de-duplication: SimHash, pigeonhole blocks, edit similarity, components.

Lines are normalised (A-Z lower-cased, digits alike, words with one space between).
Every line with a word takes part (``MIN_WORDS`` is 1), however short; lines without
one stay. Equal normalised lines are one class. Classes are linked if their 64-bit
SimHashes differ in at most ``K`` bits and their edit similarity (1 - distance /
longer length, in bytes) is at least ``SIMILARITY``. Of each connected group the
first occurrence stays, by (doc_id, line number); all others are cut.

A fingerprint is five blocks; with at most three differing bits two blocks are
equal, so classes meet under one of ten keys of two blocks. Keys are counted first;
one with a single fingerprint ends there, one with more than ``LIST`` is cut further:
of eight parts of its other bits five are equal, which leaves at most 2^15
fingerprints to a key. Within a key only fingerprints that have another one within
``K`` bits go on. The lines of a key, of which any number may share a fingerprint, are
dealt to blocks of about ``MEMBERS`` lines or ``MEMBER_BYTES``; each pair of blocks is
verified in one task and gives the links of a spanning forest, never all pairs.

Copies of a line, however many, are one row from the first aggregation on. The
texts of candidates are read from the documents of their first occurrence; that
join is a broadcast up to ``BROADCAST_ROWS`` candidates and a shuffle beyond.

Defined cases: a null text stays null and has no lines; a text that loses all its
lines becomes empty; rows that repeat an id and a text are one document and keep
the same lines; rows with a null id are left as they are; other columns stay.
"""

from __future__ import annotations

from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import components, fresh, result_name
from .textbatch import Words, binary_list, column_chunks, mix, runs_hash, text_chunks

MIN_WORDS = 1
K = 3
SIMILARITY = 0.8
LIST = 4_096
MEMBERS = 2_048
MEMBER_BYTES = 8 << 20
BROADCAST_ROWS = 500_000
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
REACH = 12  # words ahead within which an alignment looks for equal words
STRIDE = 64  # characters between two looks at how far a distance has grown at least

_EACH_BYTE = np.uint64(0x0101010101010101)

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x30:0x3A] = 0x30


def _bits(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) & ~((1 << lo) - 1)


def _signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def _votes(hashes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many hashes of each run [first, last) set each bit; runs hold one hash at least and follow each other."""
    # Eight counters of a byte to a number: runs are summed in parts of at most 255 hashes.
    parts = -(-(last - first) // 255)
    at = np.concatenate([[0], np.cumsum(parts)])
    begin = np.repeat(first, parts) + 255 * (np.arange(at[-1]) - np.repeat(at[:-1], parts))
    end = np.minimum(begin + 255, np.repeat(last, parts))
    votes = np.empty((len(first), 64), np.int32)
    total = np.zeros(len(hashes) + 1, np.uint64)
    for bit in range(8):
        np.cumsum((hashes >> np.uint64(bit)) & _EACH_BYTE, out=total[1:])
        counts = np.ascontiguousarray(total[end] - total[begin]).view(np.uint8).reshape(-1, 8)
        if len(counts) > len(first):
            counts = np.add.reduceat(counts, at[:-1], axis=0, dtype=np.int32)
        votes[:, bit::8] = counts
    return votes


class Lines:
    """The lines of a chunk of texts that have enough words."""

    def __init__(self, texts: list[bytes], min_words: int):
        w = Words(texts)
        fold = _FOLD[w.low]
        ends = np.flatnonzero(w.raw == 10)
        line = np.searchsorted(ends, w.starts)
        first = np.searchsorted(line, np.arange(len(ends) + 1))
        count = np.diff(first)
        doc = np.searchsorted(w.doc_at, ends, side="right") - 1
        number = np.arange(len(ends)) - np.searchsorted(ends, w.doc_at[:-1])[doc]
        keep = np.flatnonzero(count >= min_words)
        self.w, self.fold, self.first, self.keep = w, fold, first, keep
        self.doc, self.number = doc[keep], number[keep]
        self.words = words = runs_hash(fold, w.starts, w.ends)
        a, b = first[keep], first[keep + 1]
        self.ids = np.stack([runs_hash(words, a, b), runs_hash(mix(words ^ np.uint64(0x5851F42D4C957F2D)), a, b)], axis=1)

    @cached_property
    def sims(self) -> np.ndarray:
        """The SimHash of each line; a line without a word has none set."""
        a, b = self.first[self.keep], self.first[self.keep + 1]
        sims, some = np.zeros(len(a), np.uint64), np.flatnonzero(b > a)
        if len(some):
            set_ = _votes(self.words, a[some], b[some]) * 2 > (b - a)[some][:, None]
            sims[some] = np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1)
        return sims

    def normal(self, k: int) -> bytes:
        a, b = self.first[self.keep[k]], self.first[self.keep[k] + 1]
        w = self.w
        return b" ".join(self.fold[w.starts[i] : w.ends[i]].tobytes() for i in range(a, b))


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, line, id, sim) of every line of docs(doc_id, text) with enough words."""

    def scan(batches):
        for b in batches:
            for first, texts in column_chunks(b.column(1)):
                x = Lines(texts, min_words)
                n = len(x.keep)
                ids = pa.Array.from_buffers(pa.binary(16), n, [None, pa.py_buffer(np.ascontiguousarray(x.ids).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(x.doc + first)), pa.array(x.number.astype(np.int32)), ids.cast(pa.binary()), pa.array(x.sims.view(np.int64))],
                    names=["doc_id", "line", "id", "sim"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(scan, "doc_id long, line int, id binary, sim long")


@lru_cache
def _masks(k: int) -> list[int]:
    return [_bits(*a) | _bits(*b) for a, b in combinations(BLOCKS, len(BLOCKS) - k)]


def _close(differ: np.ndarray, k: int, choice: int) -> np.ndarray:
    """Pairs (by their differing bits) that are this key's to look at.

    A pair may share several keys; the first choice of blocks takes it. Choice -1
    stands for equal fingerprints of different lines.
    """
    if choice < 0:
        return differ == 0
    near = (np.bitwise_count(differ) <= k) & (differ != 0)
    for m in _masks(k)[:choice]:
        near &= differ & np.uint64(m) != 0
    return near


def _partners(sims: np.ndarray, k: int, choice: int) -> np.ndarray:
    """Which fingerprints of a list have another one within k bits."""
    has = np.zeros(len(sims), bool)
    for lo in range(0, len(sims), 256):
        has[lo : lo + 256] = _close(sims[lo : lo + 256, None] ^ sims[None, :], k, choice).any(axis=1)
    return has


def _key(choice: int, part: int, mask: int) -> Column:
    """One number for a choice of blocks, a part and the bits of ``sim`` in them.

    The lowest bits hold the choice, the others a hash: should two keys fall together,
    more fingerprints are compared, and those within ``K`` bits are linked as ever.
    """
    shared = F.xxhash64(F.lit(part), F.col("sim").bitwiseAND(F.lit(_signed(mask))))
    return shared.bitwiseAND(F.lit(-16)).bitwiseOR(F.lit(choice & 15).cast("long"))


def _choice(key: str) -> Column:
    low = F.col(key).bitwiseAND(F.lit(15)).cast("int")
    return F.when(low == 15, F.lit(-1)).otherwise(low)


def _candidates(classes: DataFrame, k: int) -> DataFrame:
    """(key, sim): fingerprints with another one within k bits, by the keys they share."""
    sims = classes.groupBy("sim").agg(F.count(F.lit(1)).alias("n"))
    masks = _masks(k)
    keys = F.array(*[_key(i, 0, m) for i, m in enumerate(masks)])
    postings = sims.select("sim", F.explode(keys).alias("key"))
    met = postings.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    # A key with very many fingerprints is cut by parts of its other bits.
    cut_keys = F.array()
    for i, m in enumerate(masks):
        cuts = np.array_split(np.array([b for b in range(64) if not m >> b & 1]), 8)
        finer = [_key(i, p, m | sum(1 << int(b) for b in np.concatenate(kept))) for p, kept in enumerate(combinations(cuts, 8 - k), 1)]
        cut_keys = F.when(_choice("key") == i, F.array(*finer)).otherwise(cut_keys)
    dealt = met.select("sim", F.explode(F.when(F.col("n") > LIST, cut_keys).otherwise(F.array("key"))).alias("key"))
    lists = dealt.groupBy("key").agg(F.collect_list("sim").alias("sims")).where(F.size("sims") > 1)
    # Most lists are pairs, and most pairs differ in too many bits.
    lists = lists.where((F.size("sims") > 2) | (F.bit_count(F.col("sims")[0].bitwiseXOR(F.col("sims")[1])) <= k))
    lists = lists.select(_choice("key").alias("choice"), "key", "sims")

    def filter_lists(batches):
        for b in batches:
            column = b.column(2)
            choices = np.asarray(b.column(0)).tolist()
            values = np.asarray(column.flatten()).view(np.uint64)
            offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
            row, kept = [], []
            for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = values[lo:hi]
                found = own[_partners(own, k, choices[i])]
                if len(found):
                    row += [i] * len(found)
                    kept.append(found)
            sim = np.concatenate(kept).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(row, pa.int64())), pa.array(sim)], names=["key", "sim"])

    near = lists.mapInArrow(filter_lists, "key bigint, sim bigint")
    return near.union(sims.where("n > 1").select(_key(-1, 0, _bits(0, 64)).alias("key"), "sim"))


def edit_distance(a: bytes, b: bytes, most: int) -> int:
    """Levenshtein distance (bit-parallel over ``a``); any number above ``most`` means more."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    a, b = a[lo:], b[lo:]
    hi = 0
    while hi < min(len(a), len(b)) and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[: len(a) - hi], b[: len(b) - hi]
    if not a or not b or abs(len(a) - len(b)) > most:
        return max(len(a), len(b))
    if len(a) < len(b):  # fewer steps, wider words
        a, b = b, a
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # plus, minus: where a column of the table of distances goes up and down by one.
    ones, get = (1 << len(a)) - 1, where.get
    plus, minus = ones, 0
    for at in range(0, len(b), STRIDE):
        if at and _least(plus & ones, minus, len(a), at, len(b)) > most:
            return most + 1
        for c in b[at : at + STRIDE]:
            eq = get(c, 0)
            x = ((((eq & plus) + plus) ^ plus) | eq | minus) & ones
            up = ((minus | (ones ^ (x | plus) & ones)) << 1 | 1) & ones
            plus, minus = (plus & x) << 1 | (ones ^ (x | up)), up & x
    return len(b) + (plus & ones).bit_count() - minus.bit_count()


def _least(plus: int, minus: int, n: int, at: int, m: int) -> int:
    """The least that a distance can become after ``at`` of ``m`` columns of ``n`` rows."""
    size = -(-n // 8)
    up, down = (np.unpackbits(np.frombuffer(x.to_bytes(size, "little"), np.uint8), count=n, bitorder="little").view(np.int8) for x in (plus, minus))
    column = np.concatenate([[at], at + np.cumsum(up - down, dtype=np.int64)])
    return int((column + np.abs(np.arange(n, -1, -1) - (m - at))).min())


def aligned(x: list[bytes], y: list[bytes], most: int) -> int:
    """Bytes changed by one alignment of two lists of words: the distance is that or less. A search that does not end well gives more than ``most``."""
    i = j = cost = misses = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        p = q = 1
        for s in range(1, REACH):
            # The nearest two equal words that are followed by equal words or by an end.
            p = next((p for p in range(s + 1) if i + p < n and j + s - p < m and x[i + p] == y[j + s - p]
                      and (i + p + 1 == n or j + s - p + 1 == m or x[i + p + 1] == y[j + s - p + 1])), -1)
            if p >= 0:
                q = s - p
                break
        else:
            p = q = 1
            misses += 1
        # Each word with the blank after it; both ends get one, which leaves the distance as it is.
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        if cost > most or misses > 3:
            return most + 1
        i, j = i + p, j + q
    return cost + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def similar(a: bytes, b: bytes, least: float) -> bool:
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    # Replacing differing words one by one is one way to edit; if it is cheap enough, the distance is too.
    x, y = a.split(b" "), b.split(b" ")
    if len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y, strict=True) if u != v) <= most:
        return True
    return aligned(x, y, most) <= most or edit_distance(a, b, most) <= most


PROFILE = 256


def _profiles(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed byte pairs of each text; an edit changes at most four of them by one."""
    out = np.zeros((len(texts), PROFILE), np.int32)
    for i, t in enumerate(texts):
        v = np.frombuffer(t, np.uint8).astype(np.int64)
        out[i] = np.bincount((v[:-1] * 31 + v[1:] * 7) % PROFILE, minlength=PROFILE)
    return out


def _forest(ids: list[bytes], sims: np.ndarray, texts: list[bytes], k: int, least: float, choice: int,
            left_of: np.ndarray, right_of: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Links of a spanning forest over pairs (left, right) that are close in bits and in edits."""
    if len(ids) == 2:  # most keys
        met = left_of[0] and right_of[1] or left_of[1] and right_of[0]
        return [(ids[0], ids[1])] if met and _close(sims[:1] ^ sims[1], k, choice)[0] and similar(*texts, least) else []
    links, todo_left, waiting = [], left_of.copy(), right_of.copy()
    nobody = np.zeros(len(ids), bool)
    profile = _profiles(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    for start in np.flatnonzero(left_of).tolist():
        if not todo_left[start]:
            continue
        todo_left[start] = waiting[start] = False
        reached = [start]
        while reached:
            i = reached.pop()
            rest = np.flatnonzero((waiting if left_of[i] else nobody) | (todo_left if right_of[i] else nobody))
            rest = rest[_close(sims[rest] ^ sims[i], k, choice)]
            if len(rest) == 0:
                continue
            # Pairs whose byte pairs differ too much for the edits allowed are not worth a distance.
            allowed = 4 * ((1 - least) * np.maximum(size[rest], size[i]) + 1e-9)
            rest = rest[np.abs(profile[rest] - profile[i]).sum(axis=1) <= allowed]
            for j in rest.tolist():
                if similar(texts[i], texts[j], least):
                    todo_left[j] = waiting[j] = False
                    reached.append(j)
                    links.append((ids[i], ids[j]))
    return links


def _texts(docs: DataFrame, wanted: DataFrame, min_words: int) -> DataFrame:
    """(id, body): normalised lines at wanted(id, doc_id, line), one row for each id."""
    by_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("line", "id")).alias("wanted"))  # as many as its lines
    if wanted.count() <= BROADCAST_ROWS:
        by_doc = F.broadcast(by_doc)

    def read(batches):
        for b in batches:
            texts = binary_list(b.column(1))
            wants = b.column(2).to_pylist()
            for first, part in text_chunks(texts):
                x = Lines(part, min_words)
                at = {(d, n): k for k, (d, n) in enumerate(zip(x.doc.tolist(), x.number.tolist(), strict=True))}
                # A row that only repeats the id has other lines; its text does not count.
                found = [(q["id"], at[i, q["line"]]) for i in range(len(part)) for q in wants[first + i] if (i, q["line"]) in at]
                found = [(i, k) for i, k in found if x.ids[k].tobytes() == i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in found], pa.binary()), pa.array([x.normal(k) for _, k in found], pa.binary())], names=["id", "body"])

    hit = docs.join(by_doc, "doc_id").select("doc_id", "text", "wanted")
    return hit.mapInArrow(read, "id binary, body binary").groupBy("id").agg(F.min("body").alias("body"))


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, removed): line numbers to cut from each document of docs(doc_id, text) that has any."""
    found = stage(occurrences(docs, min_words), "lines")
    # Places as one number: Spark sorts whole rows to find the smallest of a struct, but hashes them for numbers.
    high = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 32)
    place = high + F.col("line")
    classes = found.groupBy("id").agg(
        F.min("doc_id").alias("doc_id"), F.min(place).alias("low"), F.max(place).alias("top"), F.max("sim").alias("sim"))
    classes = stage(classes.select(
        "id", F.struct("doc_id", (F.col("low") - high).cast("int").alias("line")).alias("first"), (F.col("low") != F.col("top")).alias("repeated"), "sim"), "classes")
    keys = stage(_candidates(classes, k), "keys")
    members = keys.join(classes.select("sim", "id", "first"), "sim")
    members = stage(members, "members")
    texts = stage(_texts(docs, members.select("id", "first.doc_id", "first.line").distinct(), min_words), "texts")
    sizes = members.join(texts.select("id", F.length("body").alias("size")), "id").groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).where("n > 1")
    blocks = F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("bytes") / MEMBER_BYTES), F.lit(1)).cast("int")
    held = members.select("key", "id", "sim").join(sizes.select("key", blocks.alias("blocks")), "key")
    held = held.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # Each line meets its own block and every other one, as (smaller, larger) block.
    held = held.select("key", "id", "sim", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    held = held.select(F.struct("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).alias("task"), "id", "sim", "own")
    choice = _choice("task.key").alias("choice")
    groups = held.join(texts, "id").groupBy("task").agg(F.collect_list(F.struct("id", "sim", "body", "own")).alias("m")).where(F.size("m") > 1).select(
        "task", "m", choice)

    def verify(batches):
        for b in batches:
            tasks, column = b.column(0), b.column(1)
            choices, left, right = np.asarray(b.column(2)).tolist(), np.asarray(tasks.field("i")), np.asarray(tasks.field("j"))
            offsets = np.asarray(column.offsets) - column.offsets[0].as_py()
            rows = column.flatten()
            links = []
            for t, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                m = rows.slice(lo, hi - lo)
                own = np.asarray(m.field("own"))
                links += _forest(m.field("id").to_pylist(), np.asarray(m.field("sim")).view(np.uint64), m.field("body").to_pylist(), k, similarity, choices[t],
                                 own == left[t], own == right[t])
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([a for _, a in links], pa.binary())], names=["a", "b"])

    joined = components(groups.mapInArrow(verify, "a binary, b binary").distinct())
    # Classes with more than one line, by themselves or with others, and the line that each group keeps.
    owned = classes.join(joined, F.col("id") == F.col("node"), "left").where("component is not null or repeated")
    owned = stage(owned.select("id", F.coalesce("component", "id").alias("component"), "first"), "owned")
    kept = owned.groupBy("component").agg(F.min("first").alias("kept"))
    keepers = stage(owned.join(kept, "component").select("id", "kept"), "kept")
    cut = found.join(keepers, "id").where(F.struct("doc_id", "line") != F.col("kept"))
    return cut.groupBy("doc_id").agg(F.collect_set("line").alias("removed"))  # as many as the document's lines


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, k: int = K, similarity: float = SIMILARITY,
                doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines cut, and ``line_dedup`` (n_lines, n_removed)."""
    pairs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    doc, gone = fresh(docs, "doc"), fresh(docs, "removed")
    removed = stage(removed_lines(pairs, min_words, k, similarity), "removed").withColumnsRenamed({"doc_id": doc, "removed": gone})
    # A merge join at every size: the removed lines grow with the corpus.
    joined = docs.join(removed.hint("merge"), docs[doc_id] == removed[doc], "left").drop(doc)
    result = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    schema = T.StructType([*docs.schema.fields, T.StructField(result_name(docs, "line_dedup"), result)])
    at, last = docs.columns.index(text), len(docs.columns)

    def cut(batches):
        for b in batches:
            texts, counts, cuts = [], [], []
            for t, r in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                lines = t.split("\n") if t is not None else []
                counts.append(len(lines))
                cuts.append(len(r or ()))
                if r:
                    drop = set(r)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(t)
            struct = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(cuts, pa.int64())], names=result.names)
            cols = [*b.columns[:last], struct]
            cols[at] = pa.array(texts, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return joined.select(*[joined[f"`{c}`"] for c in docs.columns], gone).mapInArrow(cut, schema)
