"""Both phases in one against one after the other, and what their plans hold."""

import re

import pytest
from pyspark.sql import functions as F

from concordia.operators import reconcile, vocabulary
from concordia.plans import catalogue, engine

ROOT = "/root/testdata/sf0.001"


def odd_inputs(spark):
    """Repeated cells, fields that nobody knows, what a third reader alone has, nulls, and records without a transcript."""
    vision = [
        ("a", "Birth Year", "1880", "HIGH", "seen"), ("a", "Birth Year", "1875", "", ""), ("a", "Classe Year", "1870", "LOW", ""), ("a", "Surname", "Dupont", "HIGH", ""),
        ("a", "Event Type", "couverture", "LOW", "e"), ("b_row1.png", "Event Type", "cover", "LOW", ""), ("b_row1.png", "Birth Month", " 8bre", "", None),
        ("c", "Unknown", "x", "HIGH", ""), ("d", "Height", "1 m. 66 cent.", None, ""), ("d", "Regiment", "125e d'Infanterie", "HIGH", ""), ("d", "Birth Day", "1er", "", ""),
        ("e", "Surname", None, "LOW", ""), ("e", "Event Type", "militaire", "LOW", ""), ("e", None, "y", "", ""), ("f", "Surname", "Xq", "HIGH", ""), ("f", "Death Year", "1790", "HIGH", ""),
        ("f", "Birth Year", "1850", "HIGH", ""),
    ]
    texts = [
        ("a", "Birth Year", " 1880 "), ("a", "Surname", "DUPOND"), ("b_row1.png", "Birth Month", "octobre"), ("d", "Surname", "Zzyzx"), ("e", "Surname", "Élie"), ("e", "Surname", "Abel"),
        ("f", "Death Year", "1790"), ("g", "Enlistment Departement", "L'Aude"), ("g", "Surname", " "), ("f", "Unknown", None), ("e", "Birth Year", None),
    ]
    third = [("a", "Classe Year", "1870"), ("a", "Surname", "dupond"), ("e", "Event Type", "Militaire"), ("z", "Surname", "Nobody"), ("f", "Height", "2m"), ("d", "Surname", "zzyzx"), ("d", "Surname", None)]
    pages = [("a", "Répertoire, volume: Dupond, classe 1870"), ("b_row1.png", "né en octobre 1860"), ("d", "Signalement, campagnes, 1 m 66, Zzyzw"), ("f", "1850 et 1791"), ("g", None)]
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))
    return make(texts, "record_id label value"), make(vision, "record_id label value confidence evidence"), make(pages, "record_id text"), make(third, "record_id label value")


@pytest.mark.parametrize("settings", [engine.Settings(), engine.Settings(strict=True), engine.Settings(mode="fast"), engine.Settings(third_reader=False)])
def test_both_phases_in_one(spark, settings):
    texts, vision, pages, third = odd_inputs(spark)
    known = vocabulary.build_dictionary(spark.createDataFrame([("surname", "Dupont", 0, 0), ("surname", "Martin", 0, 1)], "dictkey string, value string, src int, ord int"))
    silver = engine.read_phase(texts, vision, settings, pages)
    want = engine.post_phase(silver, pages, settings, known, third)
    got = engine.run(texts, vision, pages, settings, known, third)
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    some = want.where((F.col("value") != "") | (F.col("label") == "Event Type"))
    short = engine.run(texts, vision, pages, settings, known, third, blanks=False)
    assert sorted(map(repr, short.where((F.col("value") != "") | (F.col("label") == "Event Type")).collect())) == sorted(map(repr, some.collect()))
    assert sorted(map(tuple, reconcile.batch_items(texts.select(F.col("record_id").alias("name")), short).collect())) == sorted(map(tuple, reconcile.batch_items(texts.select(F.col("record_id").alias("name")), want).collect()))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cells_stay_rows(spark):
    """No list of a record's cells is gathered or gone through, and its rows meet one other table of records."""
    got = plan(catalogue.phases(spark, ROOT))
    assert "collect_list" not in got and "ObjectHashAggregate" not in got
    assert len(re.findall(r"\bSortMergeJoin\b", got)) <= 1


def test_rows_that_ask_nothing_send_empty_arrays(spark):
    """At each row the size of its batch is asked for, for which all nulls since the last array are gone through."""
    from concordia.operators import nearby

    rows = spark.createDataFrame([(["abcdef"], ["abcdeg"]), (["abcdef"], None), (None, ["abcdef"]), ([], [])], "asked array<string>, seen array<string>")
    out = rows.select(nearby.own_likes(F.col("asked"), F.col("seen"), 82.0).alias("o"))
    assert [r.o for r in out.collect()] == [["abcdef"], [], [], []]
    sent = re.search(r"ArrowEvalPython \[(.*)\], \[", plan(out)).group(1)
    assert sent.count("ELSE []") == 2 or sent.count("CASE") == 0 and plan(out).count("ELSE []") >= 2


def test_batch_items_makes_gold_once(spark):
    got = plan(catalogue.batch_items(spark, ROOT))
    assert len(re.findall(r"FileScan parquet .*silver-", got)) == 1
