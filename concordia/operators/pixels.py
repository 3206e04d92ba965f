"""What a page's pixels tell: threshold, local contrast, its inked rows, and by how much it is turned.

Pages are tables of pixels (page, x, y, v), of inked points (page, x, y), or of rows of inked runs.  Histograms, votes and
extreme points are aggregated by Spark, partially in the tasks that read them; the few points of a page's outline, those
that vote for its lines, and the pixels whose contrast is evened out go to a function, a page at a time.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

register_pickle_by_value(sys.modules[__name__])  # functions travel with what they call, so that workers need no import of this package


def threshold(pixels: DataFrame) -> DataFrame:
    """page, threshold: the value that parts a page's pixels so that the variance between both parts is greatest (the first
    of several); a page of one value has that one."""
    n = pixels.groupBy("page", "v").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("page").orderBy("v")
    whole = Window.partitionBy("page")
    c = n.select(
        "page", "v", F.sum("n").over(upto).cast("double").alias("n0"), F.sum(F.col("v") * F.col("n")).over(upto).cast("double").alias("s0"),
        F.sum("n").over(whole).cast("double").alias("n"), F.sum(F.col("v") * F.col("n")).over(whole).cast("double").alias("s"),
    )
    n0, s0, rest, total = F.col("n0"), F.col("s0"), F.col("n") - F.col("n0"), F.col("n")
    apart = s0 / n0 - (F.col("s") - s0) / F.when(rest > 0, rest)
    between = F.coalesce((n0 / total) * (rest / total) * apart * apart, F.lit(0.0))
    return c.groupBy("page").agg(F.max_by("v", F.struct(between.alias("b"), -F.col("v"))).alias("threshold"))


def _tiles(size: int, tiles: int) -> int:
    """The edge of a tile, of which so many cover the page."""
    return -(-size // tiles)


#: Pixels of a page that are counted or blended at once.
PIXELS = 1 << 18


def _half_even(a: np.ndarray, b: int) -> np.ndarray:
    """a / b of whole numbers to the nearest one, of two the even."""
    n, rest = np.divmod(a, b)
    return n + ((2 * rest > b) | ((2 * rest == b) & (n % 2 == 1)))


def _evened(x: np.ndarray, y: np.ndarray, v: np.ndarray, size: tuple[int, int], clip: float, tiles: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (y * width + x) of one page's pixels and their values, evened out by contrast()."""
    width, height = size
    tw, th = _tiles(width, tiles), _tiles(height, tiles)
    area = tw * th
    parts = [slice(a, a + PIXELS) for a in range(0, len(x), PIXELS)]

    def mirrored(c: np.ndarray, size: int, edge: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Which pixels have a place on the continued page, and where: their own, and that of the mirror image beyond the edge."""
        other = 2 * (size - 1) - c
        beyond = np.flatnonzero((other >= size) & (other < edge * tiles))
        return [(np.arange(len(c)), c), (beyond, other[beyond])]

    n = np.zeros(tiles * tiles * 256, np.int64)
    for p in parts:
        for own, wide in mirrored(x[p], width, tw):
            for more, high in mirrored(y[p][own], height, th):
                n += np.bincount((high // th * tiles + wide[more] // tw) * 256 + v[p][own][more], minlength=len(n))
    n = n.reshape(-1, 256)
    limit = max(int(clip * area / 256), 1)
    over = np.maximum(n - limit, 0).sum(1, keepdims=True)
    left, at = over % 256, np.arange(256)
    step = np.maximum(256 // np.maximum(left, 1), 1)
    n = np.minimum(n, limit) + over // 256 + ((at % step == 0) & (at // step < left))
    table = np.minimum(_half_even(np.cumsum(n, 1) * 255, area), 255)

    def around(c: np.ndarray, edge: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """The two tiles beside a pixel's place, and the weight of each in parts of twice the edge."""
        low, rest = np.divmod(2 * c - edge, 2 * edge)
        return [(np.clip(low, 0, tiles - 1), 2 * edge - rest), (np.clip(low + 1, 0, tiles - 1), rest)]

    blend, seen = np.zeros((2, width * height), np.int64)
    for p in parts:
        place, value = y[p] * width + x[p], v[p]
        sums = sum(wx * wy * table[ty * tiles + tx, value] for tx, wx in around(x[p], tw) for ty, wy in around(y[p], th))
        np.add.at(blend, place, sums)
        seen[place] = 1
    place = np.flatnonzero(seen)
    return place, _half_even(blend[place], 4 * area)


def contrast(pixels: DataFrame, width: int, height: int, clip: float = 2.5, tiles: int = 16) -> DataFrame:
    """page, x, y, v with the contrast of each tile evened out, its histogram being clipped, and tiles blended into one
    another.

    A tile's counts over the limit are dealt to all 256 values, what is left of them to values in even steps; a value's
    share of the counts up to it is its new value.  A pixel blends those of the four tiles whose centres lie around it.
    Pages whose size tiles don't divide are continued by their mirror image.  All is reckoned in whole numbers.

    Pixels are dealt by page, and a page's go to one function: tiles' tables of 256 values meet no rows of pixels by
    joins.  Pixels without a page, off the page or without a value of 0 to 255 have no part.
    """
    import pyarrow as pa

    kinds = {c: pixels.schema[c].dataType.simpleString() for c in ("page", "x", "y")}

    def even(key, g):
        place, v = _evened(*(g.column(c).to_numpy().astype(np.int64) for c in ("x", "y", "v")), (width, height), clip, tiles)
        of = lambda c, a: pa.array(a).cast(g.schema.field(c).type)
        return pa.table({"page": pa.repeat(key[0], len(v)), "x": of("x", place % width), "y": of("y", place // width), "v": pa.array(v.astype(np.int32))})

    on = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("v").between(0, 255) & F.col("page").isNotNull()
    return pixels.where(on).select("page", "x", "y", "v").groupBy("page").applyInArrow(even, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", v int")


def opened(runs: Column, width: Column, share: float = 0.15) -> Column:
    """The ink that an opening by a line of that share of the width leaves of a row of runs (start, length): runs as long as
    the line, and at the page's edges, beyond which all counts as ink, those that hold the line's part on the page."""
    k = F.greatest(F.floor(width * share), F.lit(1))
    half = F.floor(k / 2)
    long_ = lambda r: (r["length"] >= k) | ((r["start"] == 0) & (r["length"] >= k - half)) | ((r["start"] + r["length"] == width) & (r["length"] > half))
    return F.aggregate(F.filter(runs, long_), F.lit(0).cast("long"), lambda s, r: s + r["length"])


def content(means: Column, least: float = 100.0) -> Column:
    """struct(first, last) of the places whose mean brightness is over the least: where a page lies in its scan; null if
    nowhere."""
    places = F.filter(F.transform(means, lambda m, i: F.when(m > least, i)), lambda i: i.isNotNull())
    return F.when(F.size(places) > 0, F.struct(F.array_min(places).alias("first"), F.array_max(places).alias("last")))


def angles_table(steps: int = 360) -> list[tuple[int, float, float]]:
    """Angle number, cosine and sine of each direction of lines."""
    return [(t, math.cos(t * math.pi / steps), math.sin(t * math.pi / steps)) for t in range(steps)]


#: Points times directions of a page that are voted for at once.
VOTES = 1 << 20


def _lines(x: np.ndarray, y: np.ndarray, least: int, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Direction, distance and votes of the lines of one page's points that have more than the least and than their
    neighbours; some directions at once, with those beside them."""
    cos, sin = np.array([a[1:] for a in angles_table(steps)]).T
    few = max(1, VOTES // max(1, len(x)))
    for first in range(0, steps, few):
        t = np.arange(max(first - 1, 0), min(first + few + 1, steps))
        rho = np.floor(x[:, None] * cos[t] + y[:, None] * sin[t] + 0.5).astype(np.int64)
        low = rho.min() - 1
        wide = int(rho.max() - low) + 2  # a free place at either end, so that no line has a neighbour in another direction
        key = ((t - t[0] + 1) * wide + (rho - low)).ravel()
        if wide * (len(t) + 2) <= 16 * len(key):
            n = np.bincount(key)
            key = np.flatnonzero(n)
            n = n[key]
        else:
            key, n = np.unique(key, return_counts=True)
        strong = np.flatnonzero(n > least)
        line, votes = key[strong], n[strong]

        def beside(other: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(key, other), len(key) - 1)  # noqa: B023
            return np.where(key[at] == other, n[at], 0)  # noqa: B023

        fine = (votes > beside(line - 1)) & (votes >= beside(line + 1)) & (votes > beside(line - wide)) & (votes >= beside(line + wide))
        at = line // wide - 1 + t[0]
        fine &= (at >= first) & (at < first + few)
        yield at[fine], (line % wide + low)[fine], votes[fine]


def strongest(points: DataFrame, least: int, steps: int = 360) -> DataFrame:
    """page, t, rho, n: the lines, by direction and distance, on which more than the least of a page's points lie, and more
    than on their neighbours.

    Points are dealt by page; their votes, many times as many, are counted where they meet and are written nowhere.
    """
    import pyarrow as pa

    kind = points.schema["page"].dataType.simpleString()

    def count(key, g):
        found = list(_lines(g.column("x").to_numpy(), g.column("y").to_numpy(), least, steps))
        t, rho, n = (np.concatenate(c).astype(np.int64) for c in zip(*found))
        return pa.table({"page": pa.repeat(key[0], len(t)).cast(g.schema.field("page").type), "t": t, "rho": rho, "n": n})

    some = points.where("x IS NOT NULL AND y IS NOT NULL").select("page", "x", "y")
    return some.groupBy("page").applyInArrow(count, f"page {kind}, t long, rho long, n long")


def line_angle(points: DataFrame, least: int = 200, first: int = 500, steps: int = 360) -> DataFrame:
    """page, angle: the median turn in degrees, within 45 to either side, of a page's strongest lines.

    A line has more votes than the least and than its neighbours in direction and distance (of equal ones the later in
    either doesn't count); the first so many by votes are taken.  Pages without lines are left out.
    """
    lines = strongest(points, least, steps)
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("n"), "t", "rho"))
    deg = F.col("t") * (180.0 / steps) - 90
    taken = lines.withColumn("k", rank).where(F.col("k") <= first).withColumn("deg", deg).where(F.abs("deg") <= 45)
    return taken.groupBy("page").agg(F.expr("percentile(deg, 0.5)").alias("angle"))


def rectangle_angle(points: DataFrame, least: int = 50) -> DataFrame:
    """page, angle: the turn of the smallest rectangle around a page's points, in degrees over -45 to 45; pages of fewer
    points than the least are left out.

    Only each row's first and last point can be on the outline, so they are what is gathered of a page.
    """
    rows = points.groupBy("page", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count_distinct("x").alias("n"))
    kind = points.schema["page"].dataType.simpleString()

    def turn(key, g):
        import numpy as np
        import pyarrow as pa

        if sum(g.column("n").to_pylist()) < least:
            return pa.table({"page": pa.array([], g.schema.field("page").type), "angle": pa.array([], pa.float64())})
        y, a, b = (g.column(c).to_pylist() for c in ("y", "a", "b"))
        p = sorted({*zip(a, y), *zip(b, y)})

        def chain(points):
            out = []
            for q in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]):
                    out.pop()
                out.append(q)
            return out[:-1]

        hull = np.array(chain(p) + chain(p[::-1]) or p, float)
        best = None
        for dx, dy in np.roll(hull, -1, 0) - hull:  # the smallest rectangle has a side along the outline
            r = math.hypot(dx, dy)
            if r:
                u, v = hull @ (dx / r, dy / r), hull @ (-dy / r, dx / r)
                angle = math.degrees(math.atan2(dy, dx)) % 90
                angle = angle - 90 if angle > 45 else angle
                found = (round((u.max() - u.min()) * (v.max() - v.min()), 6), abs(round(angle, 9)), round(angle, 9))
                best = found if best is None else min(best, found)
        return pa.table({"page": pa.array([key[0].as_py()], g.schema.field("page").type), "angle": pa.array([0.0 if best is None else best[2]], pa.float64())})

    return rows.groupBy("page").applyInArrow(turn, f"page {kind}, angle double")
