"""Operator 13: documents packed whole into few sequences by bin completion, a branch-and-bound.

A document's ids and its end id stay together unless they are longer than a sequence; only then are they cut, into full
pieces and a rest.  Piece descriptions are written first and dealt at random, by a hash of the row's place, into groups
of about group_docs documents, so that repeated rows and documents of one length don't meet in one group; each group is
packed alone and only descriptions are shuffled, never texts or ids.  The number of groups grows with the input, and a
group can leave at most one more sequence than it would have as part of a larger one.

Within a group best-fit decreasing gives the first solution, and the total and a bound over thresholds (rests too long
to share, and what must stand beside them) the least number of sequences there can be.  While the solution has more,
sequences are filled one by one: the longest piece that is left opens one, and the undominated fillings around it are
enumerated.  A filling is dominated if a piece outside it could take the place of some of its pieces (or of none) without
being shorter than they are together, and one piece that fills the rest exactly dominates all other ways to fill it.  A
filling is pruned where the waste so far passes what a better solution may waste in all.  Fillings with the least waste
go first; while many pieces are left, fillings that waste something are only tried where none is found that doesn't.
Work is bounded by documented parameters: probes of one enumeration, width of fillings tried a sequence, and steps
(fillings placed beyond one descent) a group; where they run out the best solution so far stays, which is never worse
than best-fit decreasing.  Where at most `exact` pieces are left, all fillings are tried, within a hundred times the
bounds.

Null text is empty: its document is the end id alone.  Repeated rows, equal ids and null ids are packed as they are.  A
very long text is many full pieces and a rest.  Columns other than doc_id and text aren't read, whatever their names; an
empty table gives no piece.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.llm.common import table, tokenizer_path, written
from concordia.llm.packing import PIECES, pieces_of

PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The sizes of each bin; each size goes where the least room stays."""
    bins, rooms = [], []  # rooms: (room, bin), sorted
    for s in sorted(sizes, reverse=True):
        at = bisect_left(rooms, (s, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(s)
        if room > s:
            insort(rooms, (room - s, b))
    return bins


def least_bins(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: by the total, and for each threshold by what is too long to share a bin with more."""
    if not sizes:
        return 0
    s = np.sort(np.array(sizes, np.int64))
    total = np.concatenate([[0], np.cumsum(s)])
    most = -(-int(total[-1]) // capacity)
    small = np.unique(s[2 * s <= capacity])
    for a in (0, *small.tolist()):
        lone, half = np.searchsorted(s, capacity - a, "right"), np.searchsorted(s, capacity // 2, "right")
        low = np.searchsorted(s, a, "left")
        room = (lone - half) * capacity - (total[lone] - total[half])
        rest = int(total[half] - total[low] - room) if half > low else 0
        most = max(most, len(s) - int(half) + max(0, -(-rest // capacity)))
    return most


class Left:
    """The pieces that are left: a count for each size, and the sizes that there are, sorted."""

    def __init__(self, sizes: list[int], capacity: int):
        self.count = np.bincount(np.array(sizes, np.int64), minlength=capacity + 1).tolist()
        self.sizes = sorted(set(sizes))
        self.pieces = len(sizes)

    def take(self, filling: tuple[int, ...]) -> None:
        self.pieces -= len(filling)
        for s in filling:
            self.count[s] -= 1
            if not self.count[s]:
                del self.sizes[bisect_left(self.sizes, s)]

    def give(self, filling: tuple[int, ...]) -> None:
        self.pieces += len(filling)
        for s in filling:
            if not self.count[s]:
                insort(self.sizes, s)
            self.count[s] += 1


def dominated(filling: tuple[int, ...], waste: int, left: Left) -> bool:
    """Whether a piece that is left beside the filling can take the place of some of it (or stand beside all of it)
    without being shorter than what it replaces; of one piece, longer."""
    sums = [(0, 1)]  # of some of the filling, and the least size that replaces them
    for s in filling[:10]:
        sums += [(t + s, t + s + (t == 0)) for t, _ in sums]
    sizes, count = left.sizes, left.count
    for t, least in sums:
        for at in range(bisect_left(sizes, least), len(sizes)):
            if (s := sizes[at]) > t + waste:
                break
            if count[s] > filling.count(s):
                return True
    return False


def fillings(left: Left, room: int, waste: int, probes: int, width: int) -> list[tuple[int, ...]]:
    """Undominated ways, of pieces that are left, to fill a room up to that waste, the least waste first."""
    count, sizes, found, chosen, used, probed = left.count, left.sizes, [], [], {}, 0

    def down(room: int, upto: int) -> bool:
        """Fills the room with pieces from the sizes before that place; False when the search shall end."""
        nonlocal probed
        probed += 1
        if probed > probes:
            return False
        if room <= sizes[-1] and count[room] > used.get(room, 0):  # one piece that fills it exactly dominates what else would
            if room <= sizes[upto - 1]:
                found.append((0, (*chosen, room)))
            return waste > 0 or len(found) < width
        some, at = False, min(upto, bisect_left(sizes, room))
        for i in range(at - 1, -1, -1):
            s = sizes[i]
            if count[s] <= (n := used.get(s, 0)):
                continue
            some = True
            chosen.append(s)
            used[s] = n + 1
            going = down(room - s, i + 1)
            used[s] = n
            chosen.pop()
            if not going:
                return False
        if not some and room <= waste:
            found.append((room, tuple(chosen)))
        return True

    if room == 0 or not sizes:
        return [()] if room <= waste else []
    down(room, len(sizes))
    found.sort(key=lambda x: x[0])
    out = []
    for w, f in dict.fromkeys(found):
        if not dominated(f, w, left):
            out.append(f)
            if len(out) >= width:
                break
    return out


def bin_completion(sizes: list[int], capacity: int, probes: int = 150, width: int = 4, steps: int = 500, exact: int = 24) -> list[list[int]]:
    """The sizes of each bin, in as few bins as the bounded search finds; never more than best-fit decreasing."""
    best = best_fit_decreasing(sizes, capacity)
    bound, total = least_bins(sizes, capacity), sum(sizes)
    if len(best) <= bound:
        return best
    left, placed, tried = Left(sizes, capacity), [], []  # tried: for each bin the waste before it and the fillings still to try
    steps += len(best)

    def branch(waste: int) -> None:
        first = (left.sizes[-1],)
        left.take(first)
        room, allowed = capacity - first[0], (len(best) - 1) * capacity - total - waste
        ways = []
        if left.pieces <= exact:
            ways = fillings(left, room, allowed, 100 * probes, 100 * width)
        else:
            for most in (0, min(allowed, capacity // 256), allowed):
                if ways := fillings(left, room, most, probes, width):
                    break
        left.give(first)
        tried.append((waste, iter([first + f for f in ways])))

    branch(0)
    while tried and steps:
        waste, ways = tried[-1]
        way = next(ways, None)
        if way is None:
            tried.pop()
            if placed:
                left.give(placed.pop())
            continue
        steps -= 1
        wasted = waste + capacity - sum(way)
        if wasted > (len(best) - 1) * capacity - total and len(way) < left.pieces:
            continue
        left.take(way)
        placed.append(way)
        if left.pieces:
            branch(wasted)
            continue
        if len(placed) < len(best):
            best = [list(f) for f in placed]
            if len(best) <= bound:
                break
        left.give(placed.pop())
    return best


def pack_lengths(lengths: np.ndarray, capacity: int, **bounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item.  Full items have bins of their own."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths == capacity)
    bins[full] = np.arange(len(full))
    rest = np.flatnonzero(lengths < capacity)
    items: dict[int, list[int]] = {}
    for i in rest[::-1].tolist():
        items.setdefault(int(lengths[i]), []).append(i)
    for b, sizes in enumerate(bin_completion(lengths[rest].tolist(), capacity, **bounds), len(full)):
        at = 0
        for s in sizes:
            i = items[s].pop()
            bins[i], offsets[i] = b, at
            at += s
    return bins, offsets


def pack(docs: DataFrame, path: str, capacity: int = 4096, group_docs: int = 4096, end_id: int = 1, **bounds: int) -> DataFrame:
    """Every piece with its sequence_id and its offset there; bounds: probes, width and steps of the search."""
    pieces = written(pieces_of(docs, path, capacity, end_id), "best-fit-pieces", docs.count(), spread=True)
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    pieces = pieces.withColumn("g", F.pmod("dealt", F.lit(groups).cast("long"))).drop("dealt")

    def fit(key, g):
        import pyarrow as pa

        g = g.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = pack_lengths(g.column("length").to_numpy(), capacity, **bounds)
        ids = (key[0].as_py() << 32) + bins
        return g.drop_columns(["g"]).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets))

    out = pieces.groupBy("g").applyInArrow(fit, PIECES + ", sequence_id long, offset long")
    return out.select("doc_id", (F.col("start") / capacity).cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
