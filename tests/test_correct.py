"""Cells and the answers to their values."""

from concordia.plans import catalogue

SMALLEST = "/root/testdata/sf0.001"


def test_few_answers_go_to_the_cells(spark, monkeypatch):
    """A value that very many cells hold gathers them in no task; where answers are many, the join's rows are the same."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = catalogue.correction_pipeline(spark, SMALLEST)
        assert "SortMergeJoin" not in few._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(catalogue.correct, "FEW", 0)
        many = catalogue.correction_pipeline(spark, SMALLEST)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert few.count() > 0 and few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
