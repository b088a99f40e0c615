"""Best-fit packing of tokenised documents by bin completion on lengths.

Documents become token ids with an end id; only those longer than a sequence are
cut. How pieces share sequences depends on their lengths alone, and there are at
most ``capacity`` different lengths however many pieces there are. The plan is
therefore made once, on the histogram of lengths: a few thousand patterns ("this
many sequences, each holding these lengths"). Pieces then look up their place by
their rank among the pieces of their length.

The plan is found by bin completion: take the largest remaining length, enumerate
undominated fillings of what is left of its sequence (an exact single piece
dominates every other filling, an exact pair every finer split of it, and so on),
use one as often as the counts allow, and go on. A branch is cut when its waste
exceeds what the incumbent allows; the first incumbent is best-fit decreasing.
The search ends at the lower bound on sequences or after ``NODES`` branches, with
the best plan found.

Defined cases: a null or empty text is its end id alone; repeated rows are packed
each; an empty table gives an empty result; further columns of the input are not
carried.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lobloom.session import stage

from .tables import ranked
from .textbatch import column_chunks
from .tokens import encoder

CAPACITY = 2048
NODES = 20_000
WIDTH = 4  # fillings tried at a branch
ENCODE_BYTES = 2 << 20

Pattern = tuple[int, tuple[int, ...]]  # how many sequences, lengths in each, largest first


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
           doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    fields = [T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if keep_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    names = [f.name for f in fields]
    end, step = int(end_id).to_bytes(4, "little"), 4 * capacity

    def cut(batches):
        model = encoder(tokenizer)
        for b in batches:
            for at, raw_texts in column_chunks(b.column(1), ENCODE_BYTES):
                texts = [t.decode() for t in raw_texts]
                row, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(model.encode(texts), at):
                    raw += end
                    for k, lo in enumerate(range(0, len(raw), step)):
                        part = raw[lo : lo + step]
                        row.append(i)
                        piece.append(k)
                        start.append(lo // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, T.StructType(fields))


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The first incumbent: longest first, each onto the fullest sequence with room."""
    open_bins: dict[int, list[list]] = {}  # room left -> [how many, lengths]
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            k = bisect_left(rooms, length)
            if k == len(rooms):
                # No open sequence has room: each new one takes as many as fit.
                fit = min(capacity // length, left)
                n, held = left // fit, (length,) * fit
                room = capacity - fit * length
            else:
                room = rooms[k]
                group = open_bins[room][-1]
                fit = min(room // length, left)
                n = min(group[0], left // fit)
                held = group[1] + (length,) * fit
                group[0] -= n
                if not group[0]:
                    open_bins[room].pop()
                    if not open_bins[room]:
                        del open_bins[room]
                        rooms.pop(k)
                room -= fit * length
            left -= n * fit
            if room not in open_bins:
                open_bins[room] = []
                rooms.insert(bisect_left(rooms, room), room)
            open_bins[room].append([n, held])
    return [(n, held) for groups in open_bins.values() for n, held in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Sequences needed at least: total length, and for each cut the long pieces with what cannot join them."""
    lengths = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        lengths[length] = n
    n_upto, sum_upto = np.cumsum(lengths), np.cumsum(lengths * np.arange(capacity + 1))
    best = -(-int(sum_upto[-1]) // capacity)
    for cut in range(capacity // 2 + 1):
        # Longer than capacity - cut: alone among pieces of at least cut; above half: one each.
        alone = int(n_upto[-1] - n_upto[capacity - cut])
        half = int(n_upto[capacity - cut] - n_upto[capacity // 2])
        room = half * capacity - int(sum_upto[capacity - cut] - sum_upto[capacity // 2])
        small = int(sum_upto[capacity // 2] - (sum_upto[cut - 1] if cut else 0))
        best = max(best, alone + half + max(0, -(-(small - room) // capacity)))
    return best


def fillings(have: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """Up to ``width`` undominated fillings of ``room``, least waste first; ``have[l]`` pieces of length l."""
    if room <= 0:
        return [()]
    if have[room]:
        return [(room,)]  # dominates every other filling
    out: list[tuple[int, ...]] = []
    lengths = np.flatnonzero(have[: room + 1])[::-1]
    if len(lengths) == 0:
        return [()]
    # Exact pairs, most uneven first: the rest stays flexible.
    other = room - lengths
    ok = (lengths >= other) & (have[other] > (lengths == other))
    out += [(int(a), int(room - a)) for a in lengths[ok][:width]]
    if len(out) < width:
        # Exact triples that no pair found above dominates.
        for a in lengths:
            rest = room - int(a)
            if len(out) >= width:
                break
            b = lengths[lengths <= min(rest, int(a))]
            c = rest - b
            used = (b == a).astype(np.int64)
            ok = (c >= 1) & (b >= c) & (have[b] > used) & (have[c] > (c == b).astype(np.int64) + (c == a))
            found = b[ok]
            if len(found):
                out.append((int(a), int(found[0]), int(rest - found[0])))
    if not out:
        out.append(_fullest(have, room))
    return out[:width]


def _fullest(have: np.ndarray, room: int) -> tuple[int, ...]:
    """A filling with the least waste, by reachable sums (large pieces preferred)."""
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in np.flatnonzero(have[: room + 1])[::-1].tolist():
        for _ in range(min(int(have[length]), room // length)):
            new = (reach | (reach << length)) & mask
            if new == reach:
                break
            steps.append((length, new & ~reach))
            reach = new
        if reach >> room & 1:
            break
    left = reach.bit_length() - 1
    held = []
    for length, gained in reversed(steps):
        if gained >> left & 1:
            held.append(length)
            left -= length
    return tuple(sorted(held, reverse=True))


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES, width: int = WIDTH) -> list[Pattern]:
    """Patterns that hold every piece, with as few sequences as the search finds."""
    counts = {int(k): int(n) for k, n in counts.items() if n > 0}
    best = best_fit_decreasing(counts, capacity)
    most = sum(n for n, _ in best)
    bound, total = lower_bound(counts, capacity), sum(k * n for k, n in counts.items())
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    made: list[Pattern] = []
    used = packed = 0
    open_branches: list[list[tuple[int, ...]]] = []
    tried = 0
    while most > bound and tried < nodes:
        longest = int(np.flatnonzero(have)[-1]) if have.any() else 0
        if longest == 0:
            if used < most:
                best, most = list(made), used
            options: list[tuple[int, ...]] = []
        elif used + -(-(total - packed) // capacity) >= most:
            options = []  # even without further waste no better than the incumbent
        else:
            have[longest] -= 1
            options = [(longest, *f) for f in fillings(have, capacity - longest, width)][::-1]
            have[longest] += 1
        open_branches.append(options)
        # Back up to the last branch that has an option left.
        while open_branches and not open_branches[-1]:
            open_branches.pop()
            if made and open_branches:
                n, held = made.pop()
                used -= n
                packed -= n * sum(held)
                for length in held:
                    have[length] += n
        if not open_branches:
            break
        held = open_branches[-1].pop()
        need: dict[int, int] = {}
        for length in held:
            need[length] = need.get(length, 0) + 1
        n = min(int(have[length]) // k for length, k in need.items())
        for length in held:
            have[length] -= n
        made.append((n, held))
        used += n
        packed += n * sum(held)
        tried += 1
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length and pattern: from which rank on, how many in a sequence, first sequence, offset in it."""
    rows, taken, sequence = [], {}, 0
    for n, held in patterns:
        offset, at = 0, 0
        while at < len(held):
            length = held[at]
            same = held.count(length)
            lo = taken.get(length, 0)
            rows.append((length, lo, same, sequence, offset))
            taken[length] = lo + n * same
            offset += same * length
            at += same
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return dict(zip(("length", "lo", "same", "sequence", "offset"), table.T, strict=True))


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length`` of 1 to ``capacity``.

    ``cut`` is a written table (it is read more than once).
    """
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = places(plan(counts, capacity))
    key = (table["length"] << 48) + table["lo"]  # lengths and ranks in one order
    salt = F.xxhash64(*[c for c in cut.columns if c != "ids"])
    numbered = ranked(cut, "length", [F.col(c) for c in cut.columns if c not in ("ids", "length")], salt, "__rank")
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at, rank_at = cut.columns.index("length"), len(cut.columns)

    def place(batches):
        for b in batches:
            length, rank = np.asarray(b.column(at)), np.asarray(b.column(rank_at))
            i = np.searchsorted(key, (length << 48) + rank, side="right") - 1
            within = rank - table["lo"][i]
            sequence = table["sequence"][i] + within // table["same"][i]
            offset = table["offset"][i] + within % table["same"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:rank_at], pa.array(sequence), pa.array(offset)], names=schema.names)

    return numbered.select(*cut.columns, "__rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, keep_ids: bool = False,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenises and packs: pieces with sequence_id and offset, and with their ids if wanted."""
    return pack(stage(pieces(docs, tokenizer, capacity, end_id, keep_ids, doc_id, text), "pieces"), capacity)
