"""Stores that several writers change, and batches whose items arrive as a stream."""

import pytest

from concordia.operators import select
from concordia.sources import store, versions
from concordia.streaming import status


def rows(spark, x):
    return spark.createDataFrame(x, "name string, n int")


def held(spark, path, **k):
    return sorted(tuple(r) for r in versions.read(spark, path, **k).collect())


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert versions.latest(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    seen = versions.upsert(spark, path, rows(spark, [("a", 1), ("b", 1), ("c", 1)]))
    one = versions.prepare(rows(spark, [("a", 2), ("b", 2)]), path)
    two = versions.prepare(rows(spark, [("b", 3), ("d", 3)]), path)
    assert versions.publish(spark, path, two, seen) == 2 and versions.publish(spark, path, one, seen) == 3
    assert held(spark, path) == [("a", 2), ("b", 2), ("c", 1), ("d", 3)]
    assert held(spark, path, version=2) == [("a", 1), ("b", 3), ("c", 1), ("d", 3)] and held(spark, path, version=1) == [("a", 1), ("b", 1), ("c", 1)]
    with pytest.raises(versions.Conflict):
        versions.upsert(spark, path, rows(spark, [("a", 9)]), expect=2)
    assert versions.compact(spark, path) == 4 and versions.compact(spark, path) == 4 and len(versions.manifest(spark, path, 4)["deltas"]) == 1
    assert held(spark, path) == [("a", 2), ("b", 2), ("c", 1), ("d", 3)]
    assert versions.upsert(spark, path, rows(spark, [("e", 1), ("e", 5)]), order="n", tag="x") == 5 and versions.upsert(spark, path, rows(spark, [("e", 6)]), tag="x") == 5
    assert ("e", 5) in held(spark, path) and not list((tmp_path / "store" / "_versions").glob(".[0-9a-f]*[0-9a-f]"))


def test_a_name_is_given_once(spark, tmp_path):
    path = str(tmp_path / "store")
    assert versions._publish(spark, path, 1, {"deltas": ["a"], "tags": []}) and not versions._publish(spark, path, 1, {"deltas": ["b"], "tags": []})
    assert versions.manifest(spark, path, 1)["deltas"] == ["a"]


def event(job, seq, kind="item", error=None):
    return (job, seq, float(seq), kind, f"n{seq}", error, seq, 1, 0, 0, 0, 0)


def test_status_of_running_batches(spark, tmp_path):
    events = [event(1, 0), event(1, 1, error="bad"), event(1, 2), event(2, 3), event(2, 4, "stop"), event(2, 5), event(2, 6, error="late"), event(3, 7, "stop"), event(4, 8)]
    for n, part in enumerate((events[:3], events[3:])):
        spark.createDataFrame(part, status.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        status.track(spark, str(tmp_path / "in"), str(tmp_path / "s"), str(tmp_path / "cp"), files_at_once=1).awaitTermination()
    state = versions.read(spark, str(tmp_path / "s"), "job")
    asked = spark.createDataFrame([(1, 4), (2, 9), (3, 2), (4, 1), (5, 6)], "job long, total long")
    got = {r.job: r for r in status.status(state, asked).collect()}
    assert (got[1].running, got[1].done, got[1].ok, got[1].failed, got[1].pct, got[1].eta, got[1].current, got[1].filled) == (True, 3, 2, 1, 75.0, 1, "n2", 2)
    assert (got[2].running, got[2].stopped, got[2].done, got[2].pct, got[2].eta) == (False, True, 1, 100.0, 0)
    assert (got[3].stopped, got[3].done) == (True, 0) and (got[4].running, got[4].pct) == (False, 100.0) and (got[5].running, got[5].done, got[5].pct, got[5].eta) == (True, 0, 0.0, None)
    assert [tuple(r) for r in status.errors_of(state, str(tmp_path / "s")).collect()] == [(1, 1, "n1", "bad")]


def test_reads_and_selections(spark, tmp_path):
    results = rows(spark, [("a.png", 1)])
    assert select.result_of(results, "a.png").head().n == 1
    with pytest.raises(select.NotProcessed):
        select.result_of(results, "b.png")
    with pytest.raises(select.EmptySelection):
        select.require_some(results.limit(0))
    results.write.json(str(tmp_path / "r.json"))
    results.write.parquet(str(tmp_path / "r"))
    assert store.read_results(spark, str(tmp_path / "r.json")).select("name", "n").collect() == store.read_results(spark, str(tmp_path / "r")).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read_results(spark, str(tmp_path / "none"))
    for n in ("a.png", "b.png"):
        (tmp_path / "i").mkdir(exist_ok=True)
        (tmp_path / "i" / n).write_bytes(b"1")
    found = spark.read.format("binaryFile").load(str(tmp_path / "i"))
    assert store.newest(found).head().newest == max(r.modificationTime for r in found.collect())
