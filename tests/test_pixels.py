"""Pixel operators against plain versions, and their queries' inputs at odd sizes."""

import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from concordia.operators import bands, pixels


def image(spark, pages):
    """A table of pixels from {page: rows of values}."""
    rows = [(p, x, y, v) for p, img in pages.items() for y, row in enumerate(img) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "page long, x int, y int, v int")


def drawn(rng, w, h):
    return [[min(255, max(0, rng.choice((40, 200)) + rng.randrange(-30, 31))) for _ in range(w)] for _ in range(h)]


def plain_threshold(img):
    n = Counter(v for row in img for v in row)
    total, whole = sum(n.values()), sum(v * c for v, c in n.items())
    best, at = -1.0, None
    for t in sorted(n):
        n0, s0 = sum(c for v, c in n.items() if v <= t), sum(v * c for v, c in n.items() if v <= t)
        d = 0.0 if n0 == total else (n0 / total) * ((total - n0) / total) * (s0 / n0 - (whole - s0) / (total - n0)) ** 2
        if d > best:
            best, at = d, t
    return at


def test_threshold(spark):
    rng = random.Random(1)
    pages = {p: drawn(rng, 9, 7) for p in range(6)} | {90: [[7] * 3] * 3, 91: [[0, 255]]}
    got = {r.page: r.threshold for r in pixels.threshold(image(spark, pages)).collect()}
    assert got == {p: plain_threshold(img) for p, img in pages.items()}
    assert pixels.threshold(image(spark, pages).limit(0)).count() == 0


def plain_contrast(img, clip, tiles):
    h, w = len(img), len(img[0])
    tw, th = -(-w // tiles), -(-h // tiles)
    at = lambda i, n: i if i < n else 2 * (n - 1) - i
    luts = {}
    for ty, tx in itertools.product(range(tiles), repeat=2):
        n = [0] * 256
        for y, x in itertools.product(range(ty * th, ty * th + th), range(tx * tw, tx * tw + tw)):
            n[img[at(y, h)][at(x, w)]] += 1
        limit = max(int(clip * tw * th / 256), 1)
        gone = sum(max(c - limit, 0) for c in n)
        n = [min(c, limit) + gone // 256 for c in n]
        rest = gone % 256
        if rest:
            step, i = max(256 // rest, 1), 0
            while i < 256 and rest:
                n[i] += 1
                rest, i = rest - 1, i + step
        luts[ty, tx] = [min(255, round(sum(n[: v + 1]) * 255.0 / (tw * th))) for v in range(256)]
    out = {}
    for y, x in itertools.product(range(h), range(w)):
        fx, fy = x / tw - 0.5, y / th - 0.5
        x1, y1 = math.floor(fx), math.floor(fy)
        a, b = fx - x1, fy - y1
        lut = lambda ty, tx: luts[min(max(ty, 0), tiles - 1), min(max(tx, 0), tiles - 1)][img[y][x]]  # noqa: B023, E731
        v = (lut(y1, x1) * (1 - a) + lut(y1, x1 + 1) * a) * (1 - b) + (lut(y1 + 1, x1) * (1 - a) + lut(y1 + 1, x1 + 1) * a) * b
        out[x, y] = round(round(v, 9))
    return out


def test_contrast(spark):
    rng = random.Random(2)
    for w, h, tiles in ((16, 16, 4), (13, 10, 4), (20, 9, 3)):
        pages = {p: drawn(rng, w, h) for p in range(2)} | {5: [[9] * w] * h}
        got = {(r.page, r.x, r.y): r.v for r in pixels.contrast(image(spark, pages), w, h, tiles=tiles).collect()}
        assert got == {(p, x, y): v for p, img in pages.items() for (x, y), v in plain_contrast(img, 2.5, tiles).items()}


def test_contrast_meets_no_tables_by_joins(spark, monkeypatch):
    rng = random.Random(6)
    pages = {p: drawn(rng, 13, 10) for p in range(3)}
    monkeypatch.setattr(pixels, "PIXELS", 17)
    odd = spark.createDataFrame([(None, 1, 1, 9), (0, 13, 0, 9), (0, 0, 10, 9), (0, -1, 0, 9)], "page long, x int, y int, v int")
    made = pixels.contrast(image(spark, pages).union(odd), 13, 10, tiles=4)
    assert {(r.page, r.x, r.y): r.v for r in made.collect()} == {(p, x, y): v for p, img in pages.items() for (x, y), v in plain_contrast(img, 2.5, 4).items()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert pixels.contrast(odd.where("page IS NULL"), 13, 10, tiles=4).count() == 0


def plain_opened(row, k):
    """By the definition: a pixel stays if some place of the line that covers it holds ink alone; beyond the edges all is ink."""
    n, before = len(row), k // 2
    ink = lambda i: not 0 <= i < n or row[i]
    fits = [all(ink(x - before + j) for j in range(k)) for x in range(n)]
    return sum(any(fits[x] for x in range(n) if x - before <= i <= x - before + k - 1) for i in range(n))


def test_opening(spark):
    rng = random.Random(3)
    rows = [[int(rng.random() < p) for _ in range(n)] for n in (7, 20, 41) for p in (0.5, 0.8, 0.95, 1.0, 0.0) for _ in range(6)]
    runs = lambda row: [(i, len(list(g))) for v, g in ((k, list(g)) for k, g in itertools.groupby(range(len(row)), lambda i: row[i])) if v for i in g[:1]]
    df = spark.createDataFrame([(i, len(r), runs(r)) for i, r in enumerate(rows)], "i int, width int, runs array<struct<start:int,length:int>>")
    for share in (0.15, 0.3):
        got = {r.i: r.n for r in df.select("i", pixels.opened(F.col("runs"), F.col("width"), share).alias("n")).collect()}
        assert got == {i: plain_opened(r, max(int(len(r) * share), 1)) for i, r in enumerate(rows)}


def test_content_and_rules(spark):
    df = spark.createDataFrame([(1, [10.0, 200.0, 50.0, 101.0, 100.0]), (2, [1.0]), (3, [])], "page int, means array<double>")
    got = {r.page: r.c and tuple(r.c) for r in df.select("page", pixels.content(F.col("means")).alias("c")).collect()}
    assert got == {1: (1, 3), 2: None, 3: None}
    sums = [0] * 400
    sums[3], sums[100], sums[120], sums[200], sums[398] = 90, 100, 80, 41, 99
    df = spark.createDataFrame([(1, sums), (2, [0] * 50), (3, [])], "page int, sums array<long>")
    assert sorted((r.page, r.y) for r in bands.rules_of(df).collect()) == [(1, 110), (1, 200)]


def test_lines(spark):
    flat = [(1, x, 40) for x in range(100)] + [(1, 50, y) for y in range(30)]
    turned = [(2, x, round(200 + x * math.tan(math.radians(3)))) for x in range(300)]
    df = spark.createDataFrame(flat + turned + [(3, 1, 1)], "page long, x long, y long")
    got = {r.page: r.angle for r in pixels.line_angle(df, least=60).collect()}
    assert got.keys() == {1, 2} and got[1] == 0.0 and abs(got[2] - 3) <= 0.5


def plain_lines(points, least, steps):
    """Votes of all lines, and those that have more than their neighbours."""
    n = Counter((t, math.floor(x * c + y * s + 0.5)) for x, y in points for t, c, s in pixels.angles_table(steps))
    return {(t, r, k) for (t, r), k in n.items() if k > least and k > n[t, r - 1] and k >= n[t, r + 1] and k > n[t - 1, r] and k >= n[t + 1, r]}


def test_votes_are_written_nowhere(spark, monkeypatch):
    rng = random.Random(5)
    pages = {p: {(rng.randrange(60), rng.randrange(40)) for _ in range(150)} for p in range(4)} | {7: {(x * 100_000, x % 3) for x in range(40)}, 8: {(-5, 2)}}
    df = spark.createDataFrame([(p, x, y) for p, pts in pages.items() for x, y in pts] + [(8, None, 1)], "page long, x long, y long")
    want = {p: plain_lines(pts, 5, 90) for p, pts in pages.items()}
    for at_once in (1, 1000, 1 << 20):
        monkeypatch.setattr(pixels, "VOTES", at_once)
        lines = pixels.strongest(df, 5, 90)
        got = lines.collect()
        assert {p: {(r.t, r.rho, r.n) for r in got if r.page == p} for p in pages} == want and len(got) == sum(map(len, want.values()))
    plan = pixels.line_angle(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def smallest(points):
    """Over the directions of all pairs of points, those that leave all points on one side."""
    best = None
    for (ax, ay), (bx, by) in itertools.combinations(sorted(set(points)), 2):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
        if min(side) < 0 < max(side):
            continue
        r = math.hypot(bx - ax, by - ay)
        u, v = [((bx - ax) * x + (by - ay) * y) / r for x, y in points], [s / r for s in side]
        angle = math.degrees(math.atan2(by - ay, bx - ax)) % 90
        found = (round((max(u) - min(u)) * (max(v) - min(v)), 6), abs(round(angle - 90 if angle > 45 else angle, 6)))
        best = found if best is None else min(best, found)
    return best


def test_rectangles(spark):
    rng = random.Random(4)
    pages = {p: [(rng.randrange(30), rng.randrange(20)) for _ in range(70)] for p in range(8)}
    turn = math.radians(10)
    pages[20] = [(round(1000 * (x * math.cos(turn) - y * math.sin(turn))), round(1000 * (x * math.sin(turn) + y * math.cos(turn)))) for x in range(30) for y in (0, 5)]
    pages[30], pages[31] = [(x, 3) for x in range(60)], [(1, 1)] * 60
    df = spark.createDataFrame([(p, x, y) for p, pts in pages.items() for x, y in pts], "page long, x long, y long").distinct()
    got = {r.page: r.angle for r in pixels.rectangle_angle(df, least=20).collect()}
    assert got.keys() == set(pages) - {31} and got[30] == 0.0 and abs(got[20] - 10) < 0.05
    for p in range(8):
        assert abs(abs(got[p]) - smallest(pages[p])[1]) < 1e-5
    assert pixels.rectangle_angle(df, least=10_000).count() == 0


def test_pages_are_dealt_before_they_grow(spark, tmp_path, monkeypatch):
    from concordia.plans import catalogue

    spark.range(1, 101).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(catalogue, "PAGES_A_TASK", 10)
    for f in (catalogue.page_threshold, catalogue.page_rectangle):
        made = f(spark, str(tmp_path))
        assert made.rdd.getNumPartitions() == 10 and made.count() == 100
        plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange hashpartitioning") == 1
