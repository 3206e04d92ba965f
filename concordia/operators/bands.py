"""Row bands of a page from the positions of its rules: clustering, gap filling, fallback.  Numbers only, no images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordia.functions.text import let
from concordia.sources.stage import dealt

PITCH = 790.0
#: Positions that a task sorts, whatever the input.
POSITIONS_A_TASK = 500_000


def cluster(positions: DataFrame, key: str = "page", pos: str = "y", gap: int = 35) -> DataFrame:
    """key, pos: the mean, cut to an integer, of each run of distinct sorted positions whose gaps are at most gap.

    Positions are dealt by key once, to as many tasks as their number asks for.
    """
    positions = dealt(positions.select(key, pos), key, POSITIONS_A_TASK)
    w = Window.partitionBy(key).orderBy(pos)
    fresh = F.coalesce((F.col(pos) - F.lag(pos).over(w) > gap).cast("int"), F.lit(0))
    run = F.sum("__fresh").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    runs = positions.select(key, pos).distinct().withColumn("__fresh", fresh).withColumn("__run", run)
    return runs.groupBy(key, "__run").agg(F.floor(F.avg(pos)).cast("long").alias(pos)).drop("__run")


def clustered(positions: Column, gap: int = 35) -> Column:
    """The same of one page's sorted positions in an array: every run's mean, cut to an integer."""

    def means(p: Column, starts: Column) -> Column:
        end = lambda k: F.coalesce(F.get(starts, k + 1), F.size(p))
        mean = lambda run: F.floor(F.aggregate(run, F.lit(0).cast("long"), lambda s, x: s + x) / F.size(run)).cast("long")
        return F.transform(starts, lambda s, k: let(F.slice(p, s + 1, end(k) - s), mean))

    none = F.array().cast("array<bigint>")
    places = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i) - F.get(p, i - 1) > gap))
    return let(positions.cast("array<bigint>"), lambda p: F.when(F.size(p) > 0, let(places(p), lambda starts: means(p, starts))).otherwise(none))


def rules(sums: Column, share: float = 0.4, edge: float = 0.015, gap: int = 35) -> Column:
    """The rules of a page from the ink of each of its pixel rows: rows over 0.4 of the most, clustered, without those at
    the edges.  A page without ink has none.  All of it stays in the page's own row."""

    def inked(s: Column, most: Column) -> Column:
        return F.filter(F.transform(s, lambda x, y: F.when((most > 0) & (x > share * most), y.cast("long"))), lambda y: y.isNotNull())

    within = lambda h: lambda y: (y > edge * h) & (y < h - edge * h)
    return let(sums, lambda s: let(F.array_max(s), lambda most: F.filter(clustered(inked(s, most), gap), within(F.size(s)))))


def rules_of(pages: DataFrame, key: str = "page", sums: str = "sums", share: float = 0.4, edge: float = 0.015) -> DataFrame:
    """key, y: the rules of each page."""
    return pages.select(key, F.explode(rules(F.col(sums), share, edge)).alias("y"))


def deskew(rect: Column, hough: Column) -> tuple[Column, Column, Column]:
    """Angle, method and whether to rotate, from two estimates either of which may be missing."""
    close = rect.isNotNull() & hough.isNotNull() & (F.abs(rect - hough) < 5)
    angle = F.bround(F.when(close, (rect + hough) / 2).otherwise(F.coalesce(rect, hough, F.lit(0.0))), 3)
    method = F.when(close, "minAreaRect+hough").when(rect.isNotNull(), "minAreaRect").when(hough.isNotNull(), "hough").otherwise("none")
    return angle, method, F.abs(angle) >= 0.1


def _median(a: Column) -> Column:
    mid = lambda s, i: F.get(s, i.cast("int")).cast("double")
    return let(F.array_sort(a), lambda s: (mid(s, F.floor((F.size(s) - 1) / 2)) + mid(s, F.floor(F.size(s) / 2))) / 2)


def _gaps(p: Column) -> Column:
    return F.when(F.size(p) > 1, F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.get(p, i) - F.get(p, i - 1))).otherwise(F.array().cast("array<bigint>"))


def bands_of(positions: Column, top: Column) -> Column:
    """Bands (top, bottom) between sorted positions, moved by top.

    The usual pitch is the median of the gaps over 400, if there are three; a gap of several pitches is cut in equal
    parts, to the nearest even integer; a first gap under 0.6 of the pitch loses its first line.
    """
    none = F.expr("CAST(array() AS array<struct<top:bigint,bottom:bigint>>)")

    def cut(a: Column, b: Column, med: Column) -> Column:
        n = F.greatest(F.bround((b - a) / med), F.lit(1)).cast("int")
        at = lambda k, n: (F.bround(a + (b - a) * k / n).cast("long") + top).cast("long")
        return let(n, lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(at(k - 1, n).alias("top"), at(k, n).alias("bottom"))))

    def between(p: Column, med: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(p) - 1, F.lit(1))), lambda i: cut(F.get(p, i - 1), F.get(p, i), med))
        return F.when(F.size(p) >= 2, F.flatten(pairs)).otherwise(none)

    def pitched(p: Column, med: Column) -> Column:
        short = F.coalesce(F.get(p, F.lit(1)) - F.get(p, F.lit(0)) < 0.6 * med, F.lit(False))
        return let(F.when(short, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))).otherwise(p), lambda lines: between(lines, med))

    def pitch(g: Column) -> Column:
        usual = lambda u: F.when(F.size(u) > 0, u).otherwise(g)
        return let(let(F.filter(g, lambda x: x > 400), usual), lambda u: F.when(F.size(u) >= 3, _median(u)).otherwise(F.lit(PITCH)))

    return let(positions, lambda p: let(let(_gaps(p), pitch), lambda med: F.when(F.size(p) >= 2, pitched(p, med)).otherwise(none)))


def fill(pages: DataFrame, positions: str = "positions", top: str = "top") -> DataFrame:
    """pages (with sorted positions) with bands, an array of (top, bottom)."""
    return pages.withColumn("bands", bands_of(F.col(positions), F.col(top)))


def with_fallback(pages: DataFrame, top: str = "top", first: int = 390, count: int = 4) -> DataFrame:
    """pages with bands replaced by four of the usual pitch, where there are none or one is far from it."""
    near = lambda b: ((b["bottom"] - b["top"]) >= 0.6 * PITCH) & ((b["bottom"] - b["top"]) <= 1.4 * PITCH)
    start = lambda k: (F.col(top) + first + k * int(PITCH)).cast("long")
    fixed = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.struct(start(k).alias("top"), start(k + 1).alias("bottom")))
    kept = lambda b: F.when((F.size(b) > 0) & F.forall(b, near), F.struct(F.lit(False).alias("fallback"), b.alias("bands"))).otherwise(F.struct(F.lit(True).alias("fallback"), fixed.alias("bands")))
    own = [c for c in pages.columns if c not in ("fallback", "bands")]
    return pages.withColumn("__b", let(F.col("bands"), kept)).select(*own, "__b.fallback", "__b.bands")


def crops(pages: DataFrame, height: str = "height", stem: str = "stem", pad: int = 8) -> DataFrame:
    """stem, name, top, bottom of each band, padded within the page."""
    rows = pages.select(stem, height, F.posexplode("bands").alias("i", "b"))
    return rows.select(
        stem, F.concat(F.col(stem), F.lit("_row"), (F.col("i") + 1).cast("string"), F.lit(".png")).alias("name"),
        F.greatest(F.col("b.top") - pad, F.lit(0)).alias("top"), F.least(F.col("b.bottom") + pad, F.col(height)).alias("bottom"),
    )
