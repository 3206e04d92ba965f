"""Where in a text a phrase may stand four times or more in a row.

Without white space, commas, semicolons and middle dots, a phrase that stands so, whatever of these stands between, is a
run of characters equal to those p places on, p being what is left of the phrase, and the run is 3 p long at least.  Such
runs are looked for in a whole Arrow batch at once, for each p.  Only what lies around one, with the words beside it, is
given to a pattern; nothing that the pattern finds lies anywhere else.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may stand between the phrases, and other white space.
BETWEEN = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x2C, 0x3B, 0x85, 0xA0, 0xB7, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The longest phrase, and how often it stands at least.
LONGEST, TIMES = 40, 4
#: Characters that are looked at at once; a longer text alone.
CHARS = 1 << 18

register_pickle_by_value(sys.modules[__name__])  # plans travel with their functions, so that workers need no import of this package


def _runs(a, p: int):
    """Starts and ends of the parts of an array that are a run at distance p of TIMES periods at least."""
    import numpy as np

    none = np.zeros(0, np.int64)
    least = (TIMES - 1) * p
    if len(a) < least + p:
        return none, none
    on, width = a[p:] == a[:-p], 1
    while 2 * width <= min(least, 8):
        on = on[:-width] & on[width:]  # so many equal ones in a row from here
        width *= 2
    at = np.flatnonzero(on)
    if not len(at):
        return none, none
    cut = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    long = last - first + width >= least
    return first[long], last[long] + width + p


def _windows(texts: list[str]) -> list[list[tuple[int, int]]]:
    """For each text the ranges in which loops may lie, apart from each other and in order."""
    import numpy as np

    size = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(size)
    code = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    code[ends - 1] = 0x110000 + np.arange(len(texts), dtype=np.uint32)  # no text's end is like another's, nor like a character
    table = np.zeros(max(BETWEEN) + 2, bool)
    table[BETWEEN] = True
    between = table[np.minimum(code, len(table) - 1)]
    kept = np.flatnonzero(~between)
    a = code[kept]
    mark = np.zeros(len(a) + 1, np.int64)
    for p in range(1, LONGEST + 1):
        first, end = _runs(a, p)
        np.add.at(mark, first, 1)
        np.add.at(mark, end, -1)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    inside = np.cumsum(mark[:-1]) > 0
    if not inside.any():
        return out
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    breaks = np.flatnonzero(between | (code >= 0x110000))
    for k, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        i = int(np.searchsorted(ends, kept[k], "right"))
        start, stop = int(ends[i] - size[i]), int(ends[i]) - 1  # of the text; no run goes over its end
        before, after = int(kept[k - 1]) if k else -1, int(kept[e])
        if before >= start:
            b = int(np.searchsorted(breaks, before))
            start = max(start, int(breaks[b - 1]) + 1 if b else 0)
        if after < stop:
            stop = int(breaks[np.searchsorted(breaks, after)])
        base = int(ends[i] - size[i])
        mine = out[i]
        if mine and mine[-1][1] >= start - base:
            mine[-1] = (mine[-1][0], max(mine[-1][1], stop - base))
        else:
            mine.append((start - base, stop - base))
    return out


def pieces(texts: list[str | None]) -> list[list[str] | None]:
    """Each text in pieces that, joined, are the text: every second one may hold loops, the others hold none."""
    out: list[list[str] | None] = [None if t is None else [t] for t in texts]
    some = [i for i, t in enumerate(texts) if t]
    at = 0
    while at < len(some):
        end, n = at, 0
        while end < len(some) and (n == 0 or n + len(texts[some[end]]) <= CHARS):
            n += len(texts[some[end]]) + 1
            end += 1
        for i, found in zip(some[at:end], _windows([texts[j] for j in some[at:end]])):
            if found:
                t, parts, last = texts[i], [], 0
                for a, b in found:
                    parts += [t[last:a], t[a:b]]
                    last = b
                out[i] = [*parts, t[last:]]
        at = end
    return out


def cut_loops(rows: DataFrame, name: str, pattern: str, to: str) -> DataFrame:
    """rows with what the pattern finds in the column replaced; it finds loops alone."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, StringType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = pa.array(pieces(b.column(name).to_pylist()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([parts if c == name else b.column(c) for c in b.schema.names], b.schema.names)

    cut = rows.mapInArrow(run, StructType([StructField(f.name, ArrayType(StringType())) if f.name == name else f for f in rows.schema.fields]))
    return cut.withColumn(name, F.array_join(F.transform(name, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, pattern, to)).otherwise(x)), ""))
