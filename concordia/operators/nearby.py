"""Pairs of like strings, found through shared segments and scored once each.

A score of at least t leaves two strings of lengths a and b at most (a + b) (100 - t) / 100 insertions and deletions apart.
Cut into one segment more than that, a string has one which the edits leave whole, so it stands in the other string, at a
place that they can have shifted by no more than the segments before and behind it have edits to give.  Segments of the
one side are joined to substrings of the other by equality of both lengths, number and content; what meets, and doesn't differ in more characters than it may, is scored.
Nothing that reaches the score is lost, and no pair of strings without a common segment is looked at.

Segments are as long as the score is high (about two and a half characters at 82).  Strings of over LONG characters would
have a segment for each of very many lengths; where either string is that long, lengths alone are joined, in bands.
"""

from __future__ import annotations

import functools
import math
import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordia.functions import lanes
from concordia.functions.similarity import ratio

LONG = 48
#: Scores from which segments tell more than lengths do.
LEAST = 70.0

#: Pairs of one batch that are looked at at once.
PAIRS = 1 << 20

register_pickle_by_value(sys.modules[__name__])  # plans travel with their functions, so that workers need no import of this package


@functools.cache
def plan(n: int, least: float, cut: bool) -> list[tuple[str, int, int]]:
    """What to look at in a string of length n: its own segments (cut), or the substrings that may be another's segments;
    each as a mark of both lengths and the segment's number, and from where to where."""
    low, high = max(1, math.ceil(n * least / (200 - least) - 1e-9)), math.floor(n * (200 - least) / least + 1e-9)
    out = []
    for other in range(low, min(high, LONG) + 1) if n <= LONG else ():
        mine, theirs = (n, other) if cut else (other, n)  # lengths of the string that is cut and of the one that is looked up
        edits = math.floor((n + other) * (100 - least) / 100 + 1e-9)
        edits -= (edits + n + other) % 2  # insertions and deletions have the parity of both lengths
        delta = theirs - mine
        for j in range(edits + 1):
            start, end = j * mine // (edits + 1), (j + 1) * mine // (edits + 1)
            mark = f"{mine}.{theirs}.{j}."
            if cut:
                out.append((mark, start, end))
                continue
            # A segment has shifted by no more than the edits before it, those behind it, and one kind of edits alone.
            down = max(-j, delta - (edits - j), -((edits - delta) // 2), -start)
            up = min(j, delta + (edits - j), (edits + delta) // 2, theirs - end)
            out += [(mark, start + k, end + k) for k in range(down, up + 1)]
    if max(n, high) > LONG:  # by bands of lengths
        band = lambda m: math.floor(math.log(m) / 0.2)
        out += [(f"band {b}", 0, 0) for b in (range(band(n), band(n) + 1) if cut else range(band(low), band(max(low, high)) + 1))]
    return out


def letters(text: str) -> int:
    """64 bits of which characters a string has, and how often.  An insertion or deletion changes one of them at most, so
    strings that are so many edits apart differ in no more bits."""
    out, seen = 0, {}
    for c in text:
        k = seen[c] = seen.get(c, -1) + 1
        out |= 1 << (ord(c) * 7 + k * 29) % 64
    return out - (out >> 63 << 64)


def _keyed(rows: DataFrame, text: str, cut: bool) -> DataFrame:
    """rows (with least) once for each key by which their text meets others, and the text's letters."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            keys = [{mark + t[x:y] for mark, x, y in plan(len(t), least, cut)} for t, least in zip(b.column(text).to_pylist(), b.column("least").to_pylist())]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            own = b.append_column(f"__{text}", pa.array(map(letters, b.column(text).to_pylist()), pa.int64()))
            yield own.take(pa.array(at)).append_column("__key", pa.array([k for own in keys for k in own], pa.string()))

    return rows.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + f", __{text} long, __key string")


def like_pairs(asked: DataFrame, known: DataFrame, keys: tuple[str, ...], least: float | Column) -> DataFrame:
    """keys, w, seen, score: of strings w of asked and seen of known with equal keys, those that score at least so much.

    Both have distinct rows of keys and a string.  least: at least LEAST; a column is one of the keys alone.
    """
    bound = F.lit(float(least)) if not isinstance(least, Column) else least.cast("double")
    left = _keyed(asked.where(F.length("w") > 0).select(*keys, "w", bound.alias("least")), "w", False)
    right = _keyed(known.where(F.length("seen") > 0).select(*keys, "seen", bound.alias("least")), "seen", True).drop("least")
    edits = F.floor((F.length("w") + F.length("seen")) * (100 - F.col("least")) / 100 + 1e-9)
    met = left.join(right, [*keys, "__key"]).where(F.bit_count(F.col("__w").bitwiseXOR(F.col("__seen"))) <= edits)
    pairs = met.select(*keys, "w", "seen", "least").distinct()
    return pairs.withColumn("score", ratio(F.col("w"), F.col("seen"))).where(F.col("score") >= F.col("least")).drop("least")


def _signs(strings: list[str]):
    """Lengths, and 64 bits of which characters each string has; an insertion or deletion changes one of them at most."""
    import numpy as np

    c = lanes.Codes(strings)
    bits = np.uint64(1) << (c.code.astype(np.uint64) * np.uint64(7) % np.uint64(64))
    out = np.zeros(len(strings), np.uint64)
    some = np.flatnonzero(c.size)
    if len(some):
        out[some] = np.bitwise_or.reduceat(bits, c.start[some])
    return c.size, out


def _likes(asked, seen, least: float):
    """Of each row's array of asked strings those that one of the row's seen strings is like; both are Arrow arrays of lists."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    row, words = pc.list_parent_indices(asked).to_numpy(zero_copy_only=False), pc.list_flatten(asked).to_pylist()
    n_seen = pc.fill_null(pc.list_value_length(seen), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, flat = np.cumsum(n_seen) - n_seen, pc.list_flatten(seen)
    long_seen = pc.fill_null(pc.utf8_length(flat), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    long_words, sign = _signs([w or "" for w in words])
    held = np.zeros(len(words), bool)
    sizes = n_seen[row]
    upto = np.cumsum(sizes)
    a = 0
    while a < len(words):  # as many asked strings as meet a bounded number of pairs, one at least
        z = max(a + 1, int(np.searchsorted(upto, upto[a] - sizes[a] + PAIRS, "right")))
        w = np.repeat(np.arange(a, z), sizes[a:z])
        s = np.arange(len(w)) - np.repeat(upto[a:z] - sizes[a:z] - (upto[a] - sizes[a]), sizes[a:z]) + np.repeat(first[row[a:z]], sizes[a:z])
        la, lb = long_words[w], long_seen[s]
        near = (la > 0) & (lb > 0) & (200.0 * np.minimum(la, lb) / np.maximum(la + lb, 1) >= least)  # what the score can be at most
        w, s = w[near], s[near]
        own, at = np.unique(s, return_inverse=True)
        texts = flat.take(pa.array(own)).to_pylist()
        size, signs = _signs(texts)
        edits = np.floor((long_words[w] + size[at]) * (100 - least) / 100 + 1e-9)
        met = np.flatnonzero(np.bitwise_count(sign[w] ^ signs[at]) <= edits)
        score = lanes.ratios([words[i] for i in w[met].tolist()], [texts[i] for i in at[met].tolist()])
        held[w[met[score >= least]]] = True
        a = z
    hits = np.bincount(row[held], minlength=len(asked))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hits)), pa.int32()), pa.array([words[i] for i in np.flatnonzero(held).tolist()], pa.string()))


@functools.cache
def _likes_of(least: float):
    import pyarrow as pa

    def run(asked: pa.Array, seen: pa.Array) -> pa.Array:
        return _likes(asked, seen, least)

    run.__annotations__ = {"asked": pa.Array, "seen": pa.Array, "return": pa.Array}  # as types, which the UDF's kind is told from
    # So that Spark keeps it in a step of its own, and puts it in no function over arrays that uses its outcome.
    return F.arrow_udf(run, "array<string>").asNondeterministic()


def own_likes(asked: Column, seen: Column, least: float) -> Column:
    """Of an array of strings those that score at least so much with one of another array of the same row.

    A row's strings meet each other where they lie, so the work grows with the rows and nothing is shuffled; pairs whose
    lengths or characters are too far apart aren't scored.  Rows that ask nothing, or have nothing to ask, send nothing.
    """
    some = (F.size(asked) > 0) & (F.size(seen) > 0)
    none = F.array().cast("array<string>")
    sent = lambda c: F.when(some, c).otherwise(none)  # noqa: E731  (empty, as the size of a batch is asked for at each row, and every null since the last array is gone through again for it)
    return F.when(some, _likes_of(float(least))(sent(asked), sent(seen))).otherwise(none)
