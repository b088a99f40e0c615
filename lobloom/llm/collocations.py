"""Collocations by counting quotient filters over packed word-id n-grams.

Word ids are 64-bit hashes, checked to be different for all different words of a
language (another hash is taken if two ever meet). The ids of an n-gram, packed
side by side, are permuted invertibly; the top of the first id becomes the
quotient and everything else stays in full as the remainder, so counters are
exact. A filter stores, for its sorted entries, which quotients occur, where each
quotient's run ends, the remainders, and counters of one byte (longer ones aside).

Every task fills filters of bounded size, cut by leading bits into buckets; the
sorted filters of a bucket are merged. The number of buckets grows with the text,
so the size of a merge does not. Phrases of n words are counted only where both
phrases of n - 1 words inside them reach the minimum: no other can. That is
looked up in a bitmap of bounded size without false negatives; a full bitmap lets
more through but changes no result.

Defined cases: null texts are empty, null languages ``und``; further columns are
not looked at; a table without frequent phrases gives no rows; repeated rows count
as often as they come.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lobloom.session import stage

from .tables import parallel
from .textbatch import _BYTE, LOWER, column_chunks, mix, runs_hash

SCAN_BYTES = 1 << 21
FLUSH_BYTES = 1 << 24
HELD_WORDS = 400_000
DRAIN_ROWS = 50_000
BUCKET_ENTRIES = 1 << 20
MAP_BITS = 28  # at most 2^28 bits, 32 MB, are broadcast
LONGEST = 4

_CUT = np.isin(_BYTE, [0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"])
_BLANK = _CUT | np.isin(_BYTE, [0x20, 0x09])


class Pieces:
    """The words of a chunk of texts, lower-cased, with the piece that each stands in."""

    def __init__(self, texts: list[bytes]):
        self.low = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
        edge = np.diff((~_BLANK[self.low]).view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.piece = np.searchsorted(np.flatnonzero(_CUT[self.low]), self.starts)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at positions ``at``, as an Arrow array."""
        sizes = self.ends[at] - self.starts[at]
        ends = np.cumsum(sizes)
        step = np.arange(ends[-1] if len(at) else 0) - np.repeat(ends - sizes, sizes)
        data = self.low[np.repeat(self.starts[at], sizes) + step]
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])

    def ids(self, plain: bool) -> np.ndarray:
        if plain:
            return np.fromiter((xxhash.xxh64_intdigest(self.word(i), 13) for i in range(len(self.starts))), np.uint64, len(self.starts))
        return runs_hash(self.low, self.starts, self.ends)

    def same_words(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether words a[i] and b[i] are equal for all i."""
        sizes = self.ends[a] - self.starts[a]
        if not np.array_equal(sizes, self.ends[b] - self.starts[b]):
            return False
        step = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.array_equal(self.low[np.repeat(self.starts[a], sizes) + step], self.low[np.repeat(self.starts[b], sizes) + step])


def by_lang(batch: pa.RecordBatch):
    """(language, pieces) of an Arrow batch with columns lang and text, in chunks."""
    langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
    for lang in dict.fromkeys(langs.tolist()):
        texts = batch.column(1).take(pa.array(np.flatnonzero(langs == lang)))
        for _, part in column_chunks(texts, SCAN_BYTES):
            yield lang, Pieces(part)


def _summed(ids: np.ndarray, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Counts of equal words added up: by id, or by spelling if different words share an id."""
    _, first, back = np.unique(ids, return_index=True, return_inverse=True)
    if not pc.all(pc.equal(words, words.take(pa.array(first[back])))).as_py():
        _, first, back = np.unique(np.asarray(words.dictionary_encode().indices), return_index=True, return_inverse=True)
    return ids[first], words.take(pa.array(first)), np.bincount(back, n, len(first)).astype(np.int64)


def _word_counts(plain: bool):
    """Counts words held as flat arrays: a word takes its bytes and 20 more."""
    def scan(batches):
        held: dict[str, list] = defaultdict(list)
        size, limit = 0, HELD_WORDS
        for b in batches:
            for lang, p in by_lang(b):
                ids = p.ids(plain)
                _, first, back, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
                if not p.same_words(np.arange(len(ids)), first[back]):
                    first, n = np.arange(len(ids)), np.ones(len(ids), np.int64)
                held[lang].append((ids[first], p.words(first), n.astype(np.int64)))
                size += len(first)
                if size > limit:
                    for key, parts in held.items():
                        held[key] = [_summed(*joined(parts))]
                    size = sum(len(parts[0][0]) for parts in held.values())
                    limit = size + HELD_WORDS
                    if size > HELD_WORDS:
                        yield from drain(held)
                        size, limit = 0, HELD_WORDS
        yield from drain(held)

    def joined(parts):
        ids, words, n = zip(*parts, strict=True)
        return np.concatenate(ids), pa.concat_arrays(words), np.concatenate(n)

    def drain(held):
        while held:
            lang, parts = held.popitem()
            ids, words, n = _summed(*joined(parts))
            for at in range(0, len(ids), DRAIN_ROWS):
                part = slice(at, at + DRAIN_ROWS)
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(ids[part]), pa.string()), pa.array(ids[part].view(np.int64)),
                    words.slice(at, DRAIN_ROWS), pa.array(n[part])], names=["lang", "id", "word", "n"])

    return scan


# The permutation: the first id is mixed with all that follow it. It can be undone.

def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def unmix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _inverse(0xA0761D6478BD642F)
    h = h ^ (h >> np.uint64(29)) ^ (h >> np.uint64(58))
    h = h * _inverse(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def permuted(lanes: list[np.ndarray]) -> np.ndarray:
    """First lane after the permutation; the other lanes stay as they are."""
    h = mix(lanes[-1])
    for lane in reversed(lanes[:-1]):
        h = mix(lane ^ h)
    return h


def restored(first: np.ndarray, rest: list[np.ndarray]) -> np.ndarray:
    return unmix(first) ^ permuted(rest) if rest else unmix(first)


def counted(first: np.ndarray, rest: list[np.ndarray], n: np.ndarray | None = None):
    """Entries sorted by the permuted lanes, equal ones as one with their count."""
    order = np.argsort(first, kind="stable")
    for _ in range(2):
        f, r = first[order], [x[order] for x in rest]
        tie = f[1:] == f[:-1]
        same = tie.copy()
        for x in r:
            same &= x[1:] == x[:-1]
        if np.array_equal(same, tie):
            break
        order = np.lexsort([*reversed(rest), first])  # equal first lanes of different phrases
    at = np.flatnonzero(np.concatenate([[True], ~same])) if len(f) else np.zeros(0, np.int64)
    total = np.diff(np.append(at, len(f))) if n is None else np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
    return f[at], [x[at] for x in r], total.astype(np.int64)


def packed(first: np.ndarray, rest: list[np.ndarray], n: np.ndarray, skip: int) -> bytes:
    """A quotient filter of sorted entries whose leading ``skip`` bits are the bucket's."""
    size = len(first)
    q = 16 if size >= 1 << 16 else 8 if size >= 1 << 8 else 0
    local = first << np.uint64(skip)
    quotient = (local >> np.uint64(64 - q)).astype(np.int64) if q else np.zeros(size, np.int64)
    used = np.zeros(1 << q, bool)
    used[quotient] = True
    last = np.append(quotient[1:] != quotient[:-1], True)[:size]
    keep = -(-(64 - skip - q) // 8)
    remainder = (local << np.uint64(q)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :keep]
    short = np.minimum(n, 255).astype(np.uint8)
    return b"".join([
        np.array([size, q], "<u4").tobytes(), np.packbits(used).tobytes(), np.packbits(last).tobytes(), remainder.tobytes(),
        *[x.astype("<u8").tobytes() for x in rest], short.tobytes(), n[n >= 255].astype("<i8").tobytes()])


def unpacked(data: bytes, lanes: int, bucket: int, skip: int):
    """(first, rest, counts) of a filter."""
    raw = np.frombuffer(data, np.uint8)
    size, q = (int(x) for x in raw[:8].view("<u4"))
    at = 8

    def take(k: int) -> np.ndarray:
        nonlocal at
        at += k
        return raw[at - k : at]

    used = np.flatnonzero(np.unpackbits(take(-(-(1 << q) // 8)))[: 1 << q])
    last = np.unpackbits(take(-(-size // 8)))[:size]
    quotient = used[np.cumsum(last) - last]
    keep = -(-(64 - skip - q) // 8)
    remainder = np.zeros((size, 8), np.uint8)
    remainder[:, :keep] = take(size * keep).reshape(size, keep)
    local = remainder.view(">u8").ravel().astype(np.uint64) >> np.uint64(q)
    if q:
        local |= quotient.astype(np.uint64) << np.uint64(64 - q)
    first = local >> np.uint64(skip)
    if skip:
        first |= np.uint64(bucket) << np.uint64(64 - skip)
    rest = [take(8 * size).copy().view("<u8").astype(np.uint64) for _ in range(lanes - 1)]
    n = take(size).astype(np.int64)
    n[n == 255] = raw[at:].copy().view("<i8")
    return first, rest, n


class Bitmap:
    """Marks permuted first lanes of a language; no false negatives."""

    def __init__(self, data: bytes):
        self.bits, self.mask = np.frombuffer(data, np.uint8), np.uint64(8 * len(data) - 1)

    def has(self, lang: str, first: np.ndarray) -> np.ndarray:
        at = spot(lang, first) & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def spot(lang: str, first: np.ndarray) -> np.ndarray:
    return mix(first ^ np.uint64(xxhash.xxh64_intdigest(lang.encode())))


def _filters(n: int, plain: bool, known, skip: int):
    def scan(batches):
        bitmap = Bitmap(known.value)
        held: dict[str, list] = defaultdict(list)
        size = 0
        for b in batches:
            for lang, p in by_lang(b):
                ids = p.ids(plain)
                count = len(ids) - n + 1
                if count <= 0:
                    continue
                inner = permuted([ids[k : len(ids) - n + 2 + k] for k in range(n - 1)])  # of all runs of n - 1 words
                ok = bitmap.has(lang, inner)
                at = np.flatnonzero(ok[:-1] & ok[1:] & (p.piece[:count] == p.piece[n - 1 :]))
                if len(at):
                    held[lang].append([ids[at + k] for k in range(n)])
                    size += 8 * n * len(at)
                if size > FLUSH_BYTES:
                    yield from drain(held)
                    size = 0
        yield from drain(held)

    def drain(held):
        while held:
            lang, parts = held.popitem()
            lanes = [np.concatenate(x) for x in zip(*parts, strict=True)]
            del parts
            first, rest = permuted(lanes), lanes[1:]
            del lanes
            first, rest, k = counted(first, rest)
            bucket = (first >> np.uint64(64 - skip)).astype(np.int64) if skip else np.zeros(len(first), np.int64)
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            rows = [packed(first[a:z], [x[a:z] for x in rest], k[a:z], skip) for a, z in zip(cuts, [*cuts[1:], len(first)], strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(cuts), pa.string()), pa.array(bucket[cuts], pa.int32()), pa.array(rows, pa.binary())],
                names=["lang", "bucket", "filter"])

    return scan


def _merge(n: int, skip: int, least: int):
    def merge(key, table):
        lang, bucket = key[0].as_py(), key[1].as_py()
        parts = [unpacked(f, n, bucket, skip) for f in table.column("filter").to_pylist()]
        first, rest, k = counted(
            np.concatenate([p[0] for p in parts]), [np.concatenate([p[1][i] for p in parts]) for i in range(n - 1)],
            np.concatenate([p[2] for p in parts]))
        often = k >= least
        first, rest, k = first[often], [x[often] for x in rest], k[often]
        ids = np.stack([restored(first, rest), *rest], axis=1).astype(">u8")
        return pa.table({
            "lang": pa.array([lang] * len(k), pa.string()), "phrase": pa.array([r.tobytes() for r in ids], pa.binary()),
            "first": pa.array(first.view(np.int64)), "f": pa.array(k)})

    return merge


def _bitmap(often: DataFrame) -> bytes:
    """The bitmap of ``often(lang, first)``: built in pieces by Spark, 32 MB at most."""
    wide = min(MAP_BITS, max(15, (16 * max(1, often.count()) - 1).bit_length()))

    def spots(batches):
        for b in batches:
            langs, first = b.column(0).to_pylist(), np.asarray(b.column(1)).view(np.uint64)
            at = np.zeros(len(first), np.uint64)
            names = np.asarray(langs, dtype=object)
            for lang in set(langs):
                at[names == lang] = spot(lang, first[names == lang])
            yield pa.RecordBatch.from_arrays([pa.array((at & np.uint64((1 << wide) - 1)).astype(np.int64))], names=["at"])

    rows = often.select("lang", "first").mapInArrow(spots, "at long").groupBy((F.col("at") / 32768).cast("int").alias("part")).agg(
        F.bitmap_construct_agg((F.col("at") % 32768)).alias("bits"))
    out = bytearray(1 << (wide - 3))
    for r in rows.toLocalIterator():
        out[r.part * 4096 : r.part * 4096 + 4096] = r.bits
    return bytes(out)


def _mixed(words: DataFrame) -> DataFrame:
    """Adds ``first``, the permuted id of a single word."""
    def scan(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(mix(np.asarray(b.column(1)).view(np.uint64)).view(np.int64))], names=["lang", "first"])

    return words.select("lang", "id").mapInArrow(scan, "lang string, first long")


def phrases(docs: DataFrame, least: int = 30, text: str = "text", lang: str = "lang", longest: int = LONGEST):
    """(words, counts, totals): exact counts of all frequent words and phrases.

    words(lang, id, word, f): frequent words; counts(lang, size, phrase, f): phrases of 1 to ``longest`` words as
    packed ids; totals(lang, n): all word occurrences.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    for plain in (False, True):
        words = stage(rows.mapInArrow(_word_counts(plain), "lang string, id long, word binary, n long").groupBy("lang", "id").agg(
            F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("f")), "words")
        if words.where("word <> other").isEmpty():
            break
    else:
        raise RuntimeError("two words of one language share their id under both hashes")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    total = totals.agg(F.sum("n")).first()[0] or 0
    skip = max(0, (total // BUCKET_ENTRIES).bit_length())
    words = words.where(F.col("f") >= least).select("lang", "id", "word", "f")
    packed_id = F.unhex(F.lpad(F.hex("id"), 16, "0"))
    counts = words.select("lang", F.lit(1).alias("size"), packed_id.alias("phrase"), "f")
    often = _mixed(words)
    for n in range(2, longest + 1):
        known = spark.sparkContext.broadcast(_bitmap(often))
        filters = rows.mapInArrow(_filters(n, plain, known, skip), "lang string, bucket int, filter binary")
        often = stage(filters.groupBy("lang", "bucket").applyInArrow(
            _merge(n, skip, least), "lang string, phrase binary, first long, f long"), f"phrases{n}")
        counts = counts.unionByName(often.select("lang", F.lit(n).alias("size"), "phrase", "f"))
    return words, counts, totals


def _part(at, size):
    """``size`` word ids of a packed phrase from word ``at`` (from 0) on."""
    return F.substring("phrase", at * 8 + 1, size * 8)


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, scale: int = 2_000_000, inside: tuple[int, int] = (80, 100), **columns) -> DataFrame:
    """The ``top`` phrases of 2 to 4 words of each language, by their weakest cut.

    A phrase scores floor(scale * f / (f(first part) + f(rest))) at its lowest cut. One that lies inside a longer
    phrase with at least inside[0] / inside[1] of its count is dropped. Columns: lang, rank (from 1), phrase,
    a (its count), l, r (of the parts), n (words of the language), score.
    """
    words, counts, totals = phrases(docs, least, **columns)
    cands = counts.where("size > 1")
    cuts = cands.select("lang", "size", "phrase", F.col("f").alias("a"), F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "size", "phrase", "a", "k", _part(F.lit(0), F.col("k")).alias("first"), _part(F.col("k"), F.col("size") - F.col("k")).alias("rest"))
    left, right = (counts.select("lang", F.col("phrase").alias(c), F.col("f").alias(v)) for c, v in (("first", "l"), ("rest", "r")))
    score = F.expr(f"(cast(a AS decimal(19,0)) * {scale}) div cast(l + r AS decimal(20,0))")
    best = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).groupBy("lang", "size", "phrase").agg(
        F.min(F.struct(score.alias("score"), "k", "l", "r", "a")).alias("cut"))
    # The most frequent longer phrase around each phrase.
    spans = F.expr("flatten(transform(sequence(2, size - 1), w -> transform(sequence(0, size - w), i -> struct(i, w))))")
    around = cands.where("size > 2").select("lang", "phrase", "f", F.explode(spans).alias("s")).select(
        "lang", _part(F.col("s.i"), F.col("s.w")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (inside[1] * F.col("longer") < inside[0] * F.col("cut.a")))
    kept = stage(kept.select("lang", "size", "phrase", "cut"), "kept")
    spelt = kept.select("lang", "size", "phrase", "cut", F.posexplode(F.expr("transform(sequence(0, size - 1), i -> substring(phrase, i * 8 + 1, 8))")))
    spelt = spelt.join(words.select("lang", F.unhex(F.lpad(F.hex("id"), 16, "0")).alias("col"), "word"), ["lang", "col"]).groupBy(
        "lang", "phrase").agg(F.first("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("ws"))
    spelt = spelt.select("lang", "cut", F.array_join(F.transform("ws.word", lambda w: F.decode(w, "UTF-8")), " ").alias("text"))
    order = [F.desc("cut.score"), F.desc("cut.a"), F.asc("text")]
    # Each part of a language offers its first ones, so that none is sorted whole by one task.
    dealt = spelt.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parallel(docs))))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "cut.a", "cut.l", "cut.r", "n", "cut.score")
