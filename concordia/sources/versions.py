"""A store that several writers change at once: rows are only ever added, and numbered manifests say which count.

Each write puts its rows (a delta) into a folder of its own and then publishes a manifest, the next version, which lists the
deltas of the version before and its own.  A manifest takes its name only if nobody has it, so of two writers that saw the
same version one comes second: it reads the other's manifest and publishes after it.  Nothing is lost, as no writer writes
the rows of another; of a key that both wrote the later version counts.  Readers see whole versions.  A run that stops
before it publishes leaves a folder that nobody lists.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """The store has another version than the one that a change was made for."""


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def latest(spark: SparkSession, path: str) -> int:
    """The last version's number; 0 for a store that isn't there."""
    fs, place = _place(spark, f"{path}/_versions")
    if not fs.exists(place):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """deltas, oldest first, and tags of what has been taken in."""
    if version == 0:
        return {"deltas": [], "tags": []}
    text = spark.read.text(f"{path}/_versions/{version:020d}.json", wholetext=True).head()[0]
    return json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, content: dict) -> bool:
    """Gives the manifest its number, unless another has it."""
    fs, folder = _place(spark, f"{path}/_versions")
    fs.mkdirs(folder)
    _, draft = _place(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    _, name = _place(spark, f"{path}/_versions/{version:020d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # where a rename would replace the other's
            try:
                os.link(draft.toUri().getPath(), name.toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark._jvm.org.apache.hadoop.fs
        none = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 0)
        if fs.exists(name):
            return False
        try:
            jvm.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, name, none)
        except Exception:
            if fs.exists(name):
                return False
            raise
        return True
    finally:
        fs.delete(draft, False)


def prepare(rows: DataFrame, path: str, key: str = "name", order: str | None = None) -> str:
    """Writes the rows as a delta that doesn't count yet; of several rows of a key the last by order (any, without one)."""
    if order:
        last = Window.partitionBy(key).orderBy(F.desc(order))
        rows = rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    else:
        rows = rows.dropDuplicates([key])
    delta = uuid.uuid4().hex
    rows.write.parquet(f"{path}/data/{delta}")
    return delta


def publish(spark: SparkSession, path: str, delta: str, seen: int | None = None, expect: int | None = None, tag: str | None = None, attempts: int = 50) -> int:
    """The version in which the delta counts.  seen: the version from which to go; expect: if the store has another one, the
    change is off (Conflict); tag: what the rows were made from, which counts once however often it is published."""
    at = latest(spark, path) if seen is None else seen
    for _ in range(attempts):
        if expect is not None and at != expect:
            raise Conflict(f"the store has version {at}, not {expect}")
        held = manifest(spark, path, at)
        if tag is not None and tag in held["tags"]:
            return at
        tags = held["tags"] + ([tag] if tag is not None else [])
        if _publish(spark, path, at + 1, {"deltas": [*held["deltas"], delta], "tags": tags}):
            return at + 1
        at = latest(spark, path)
    raise Conflict("other writers were always first")


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "name", order: str | None = None, expect: int | None = None, tag: str | None = None) -> int:
    """The version in which the rows stand in place of those of their keys."""
    if tag is not None and tag in manifest(spark, path, latest(spark, path))["tags"]:
        return latest(spark, path)
    return publish(spark, path, prepare(rows, path, key, order), expect=expect, tag=tag)


def read(spark: SparkSession, path: str, key: str = "name", version: int | None = None) -> DataFrame:
    """The rows of a version, the last one unless it is named: of each key those of its latest delta."""
    deltas = manifest(spark, path, latest(spark, path) if version is None else version)["deltas"]
    if not deltas:
        raise FileNotFoundError(path)
    parts = [spark.read.parquet(f"{path}/data/{d}").withColumn("__seq", F.lit(i)) for i, d in enumerate(deltas)]
    if len(parts) == 1:
        return parts[0].drop("__seq")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    own = [c for c in rows.columns if c not in (key, "__seq")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), "__seq").alias("__r")).select(key, *(F.col("__r")[c].alias(c) for c in own))


def compact(spark: SparkSession, path: str, key: str = "name", attempts: int = 5) -> int:
    """The version in which one delta holds all rows; it only takes the place of the version that it was made of."""
    for _ in range(attempts):
        at = latest(spark, path)
        held = manifest(spark, path, at)
        if len(held["deltas"]) < 2:
            return at
        delta = prepare(read(spark, path, key, at), path, key)
        if _publish(spark, path, at + 1, {"deltas": [delta], "tags": held["tags"]}):
            return at + 1
    raise Conflict("other writers were always first")
