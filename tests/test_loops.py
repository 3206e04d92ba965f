"""Loops of phrases: the parts that a pattern is given, against the pattern on whole texts."""

import random

from pyspark.sql import functions as F

from concordia.functions import loops, text
from tests.test_goldens import plain_cut

ODD = ["a", "b", "la", "é", " ", ", ", "\n", "ab", "-", "·", "la la la la ", "é", "́", "\U0001f600", " ", "x", "non lu non lu non lu non lu", ", a, a, a, a"]


def odd_texts(n):
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(n)]


def test_parts_hold_all_loops():
    texts = odd_texts(4000)
    for t, parts in zip(texts, loops.pieces(texts)):
        assert "".join(parts) == t and parts == loops.pieces([t])[0]
        assert "".join(plain_cut(p) if i % 2 else p for i, p in enumerate(parts)) == plain_cut(t)
    rng = random.Random(8)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(20_000))
    parts = loops.pieces([long + " non lu non lu non lu non lu fin"])[0]
    assert sum(map(len, parts[1::2])) < len(long) / 100
    assert loops.pieces([None, ""]) == [None, [""]]


def test_tables_as_columns(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "[?] " * 5000, "la " * 50_000, *odd_texts(1500)])], "i int, t string")
    for table, column in ((text.phrase_loops_cut, text.cut_phrase_loops), (text.transcripts_cleaned, text.clean_transcript)):
        got = table(rows, "t").select("i", F.col("t").alias("got")).join(rows.select("i", column(F.col("t")).alias("want")), "i")
        assert got.count() == rows.count() and got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0


def test_lines_are_split_once(spark):
    plan = spark.range(1).select(text.collapse_lines(F.col("id").cast("string")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
