"""The status of running batches from their items as they arrive: totals, progress, time left, stop flags and errors.

What arrives is added up by batch before it meets the state, so that a batch with very many items is one row there.  The
state is a versioned store; a micro-batch that is run again counts once, by its tag.  An item counts if no stop with a
smaller number has been seen; a batch's events may come in any number of micro-batches, in the order of their numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from concordia.sources import versions

EVENTS = "job long, seq long, moment double, kind string, name string, error string, filled long, high long, medium long, low long, conflicts long, flagged long"
TOTALS = ("filled", "high", "medium", "low", "conflicts", "flagged")
STATE = "job long, stop long, done long, ok long, failed long, started double, last double, seq long, current string, " + ", ".join(f"{t} long" for t in TOTALS)


def _folded(state: DataFrame, arrived: DataFrame) -> DataFrame:
    """The state of the jobs that something arrived for."""
    stops = arrived.groupBy("job").agg(F.min(F.when(F.col("kind") == "stop", F.col("seq"))).alias("stops"))
    known = stops.join(state.select("job", "stop"), "job", "left").select("job", F.least("stops", "stop").alias("until"))
    items = arrived.where("kind = 'item'").join(known, "job").where("until IS NULL OR seq < until")
    ok = F.col("error").isNull()
    sums = [F.sum(F.when(ok, F.col(t)).otherwise(0)).alias(t) for t in TOTALS]
    new = items.groupBy("job").agg(
        F.count("*").alias("done"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.min("moment").alias("started"), F.max("moment").alias("last"),
        F.max("seq").alias("seq"), F.max_by("name", "seq").alias("current"), *sums,
    )
    old = state.select("job", *(F.col(c).alias(f"old_{c}") for c in state.columns if c != "job"))
    both = known.join(new, "job", "left").join(old, "job", "left")
    add = lambda c: (F.coalesce(c, F.lit(0)) + F.coalesce(f"old_{c}", F.lit(0))).cast("long").alias(c)
    current = F.when(F.coalesce("seq", F.lit(-1)) >= F.coalesce("old_seq", F.lit(-1)), F.col("current")).otherwise(F.col("old_current"))
    return both.select(
        "job", F.col("until").alias("stop"), add("done"), add("ok"), add("failed"), F.least("started", "old_started").alias("started"),
        F.greatest("last", "old_last").alias("last"), F.greatest("seq", "old_seq").alias("seq"), current.alias("current"), *map(add, TOTALS),
    )


def track(spark: SparkSession, inbox: str, store: str, checkpoint: str, files_at_once: int = 1000) -> StreamingQuery:
    """Takes the events that lie in inbox (Parquet of EVENTS) into the store: a row a job, and its failed items beside it."""
    arriving = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).parquet(inbox)

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = versions.latest(session, store)
        state = versions.read(session, store, "job") if before else session.createDataFrame([], STATE)
        batch = batch.persist()
        errors = batch.where("kind = 'item' AND error IS NOT NULL").select("job", "seq", "name", "error")
        errors.write.mode("overwrite").parquet(f"{store}-errors/batch={number}")  # a batch that is run again replaces itself
        versions.upsert(session, store, _folded(state, batch), "job", tag=f"batch {number}")
        batch.unpersist()
        if len(versions.manifest(session, store, versions.latest(session, store))["deltas"]) > 16:
            versions.compact(session, store, "job")

    return arriving.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def status(state: DataFrame, asked: DataFrame) -> DataFrame:
    """job, running, stopped, total, done, ok, failed, pct, eta, current and the totals; asked has job and total.

    pct and eta are those of the last item: the share done, and the seconds left at the pace so far, once 2 % are done.  A
    job that is done or was stopped is complete.
    """
    s = asked.join(state, "job", "left").na.fill(0, ["done", "ok", "failed", *TOTALS])
    stopped = F.col("stop").isNotNull()
    over = stopped | (F.col("done") >= F.col("total"))
    share = F.col("done") / F.greatest(F.lit(1), F.col("total"))
    elapsed = F.col("last") - F.col("started")
    left = F.when(share > 0.02, F.bround(elapsed / share - elapsed).cast("long"))
    return s.select(
        "job", (~over).alias("running"), stopped.alias("stopped"), "total", "done", "ok", "failed", F.when(over, 100.0).otherwise(F.bround(share * 100, 1)).alias("pct"),
        F.when(over, F.lit(0)).otherwise(left).cast("long").alias("eta"), F.when(~over, F.col("current")).alias("current"), *TOTALS,
    )


def errors_of(state: DataFrame, store: str) -> DataFrame:
    """job, seq, name, error of the failed items that count."""
    found = state.sparkSession.read.schema("job long, seq long, name string, error string, batch int").parquet(f"{store}-errors")
    kept = found.join(state.select("job", "stop"), "job").where("stop IS NULL OR seq < stop")
    return kept.select("job", "seq", "name", "error")
