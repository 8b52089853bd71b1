"""Polling of a folder of evidence with a state that survives failures, and its run log as a table.

A poll takes what is new, stores it once, and then syncs if anything is pending. What is pending stands
in a table before the evidence is stored, and is taken back only by a sync that leaves no
record without a link; so neither a failed sync, nor an end of the program between any two
steps, can lose it. Errors of a poll are written down, and the next poll goes on.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from purseflow.sources.files import new_evidence

#: step: noted (evidence came, before it is stored), synced (after a sync), polled (the end of a poll), ticked (a scheduler's run).
STATE = "poll long, at timestamp, day string, step string, fetched long, added long, unreconciled long, pending boolean, error string"


def _order():
    return F.struct("poll", F.expr("case step when 'noted' then 0 when 'synced' then 1 else 2 end"), "at")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may not have been written yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


class Supervisor:
    """``sync(new, store)`` is given the evidence that no sync has settled yet and a function that reads all; it returns
    how many records are left without a link. ``store`` is kept by the first two letters of the
    digest, so what is known is looked for only among digests that begin alike."""

    def __init__(self, spark: SparkSession, stream: Callable[[], DataFrame], store: str, state: str, checkpoint: str, sync: Callable[[DataFrame, Callable[[], DataFrame]], int]):
        self.spark, self.stream, self.store, self.state_path, self.checkpoint, self.sync = spark, stream, store, state, checkpoint, sync
        last = self.log().agg(F.max("poll")).first()[0]
        self.polls = 0 if last is None else last

    def log(self) -> DataFrame:
        """Every step of every poll, a row each; a folder a day."""
        return _read(self.spark, self.state_path, STATE)

    def _stored(self) -> DataFrame:
        schema = self.stream().schema.simpleString()[len("struct<") : -1].replace(":", " ")
        return _read(self.spark, self.store, schema + ", poll long, bucket string").drop("bucket")

    def evidence(self) -> DataFrame:
        return self._stored().drop("poll")

    def pending(self) -> bool:
        row = self.log().where("pending is not null").agg(F.max_by("pending", _order())).first()
        return bool(row[0])

    def _note(self, step: str, fetched=None, added=None, unreconciled=None, pending=None, error=None) -> None:
        now = datetime.now(timezone.utc)
        row = (self.polls, now, now.strftime("%Y-%m-%d"), step, fetched, added, unreconciled, pending, error)
        self.spark.createDataFrame([row], STATE).coalesce(1).write.mode("append").partitionBy("day").parquet(self.state_path)

    def _take(self, batch: DataFrame, _epoch: int, counts: dict) -> None:
        """A micro-batch: note that something is pending, then store what is new. Repeating it adds nothing twice."""
        batch = batch.withColumns({"poll": F.lit(self.polls).cast("long"), "bucket": F.substring("digest", 1, 2)})
        seen, fresh = Observation(), Observation()
        known = _read(self.spark, self.store, batch.schema.simpleString()[len("struct<") : -1].replace(":", " "))
        known = known.join(batch.select("bucket").distinct(), "bucket", "left_semi").select("digest")
        new = new_evidence(batch.observe(seen, F.count("*").alias("n")), known)
        self._note("noted", pending=True)
        new.observe(fresh, F.count("*").alias("n")).write.mode("append").partitionBy("bucket").parquet(self.store)
        counts["fetched"] += seen.get["n"]
        counts["added"] += fresh.get["n"]

    def poll_once(self) -> dict:
        """One poll: acquire, sync if anything is pending, log. Never raises for what goes wrong in them."""
        self.polls += 1
        counts, error, unreconciled, synced = {"fetched": 0, "added": 0}, None, None, False
        try:
            query = self.stream().writeStream.foreachBatch(lambda b, n: self._take(b, n, counts)).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            query.awaitTermination()
            if self.pending():
                synced = True
                unreconciled = int(self.sync(self.unsettled(), self.evidence))
                self._note("synced", unreconciled=unreconciled, pending=unreconciled > 0)
        except Exception as e:  # noqa: BLE001 - a poll's failure is a row of the log
            error = f"{type(e).__name__}: {e}"[:2000]
        self._note("polled", counts["fetched"], counts["added"], unreconciled, None, error)
        return counts | {"synced": synced, "unreconciled": unreconciled, "error": error}

    def unsettled(self) -> DataFrame:
        """Evidence of the polls since the last sync that left nothing pending."""
        settled = self.log().where("step = 'synced' and not pending").agg(F.max("poll")).first()[0]
        return self._stored().where(F.col("poll") > (0 if settled is None else settled)).drop("poll")

    def tick(self, run: Callable[[], object]) -> bool:
        """A scheduler's run, logged as a poll is."""
        error = None
        try:
            run()
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:2000]
        self._note("ticked", error=error)
        return error is None

    def run(self, seconds: float, polls: int | None = None, stop: Callable[[], bool] = lambda: False) -> None:
        """Poll after poll, ``seconds`` apart, until told to stop."""
        if seconds <= 0:
            raise ValueError("the interval must be above 0")
        done = 0
        while not stop() and (polls is None or done < polls):
            self.poll_once()
            done += 1
            if polls is None or done < polls:
                time.sleep(seconds)


def operational(log: DataFrame) -> DataFrame:
    """One row of what runs: the last poll and its error, the last sync that went through, the last tick and its
    error, polls, errors, evidence added, whether anything is pending."""
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("at")))
    error = lambda step: F.max_by(F.when(F.col("step") == step, F.col("error")), F.when(F.col("step") == step, _order()))
    return log.agg(
        at("polled").alias("last_poll_at"), error("polled").alias("last_poll_error"), at("synced").alias("last_sync_at"), at("ticked").alias("last_tick_at"), error("ticked").alias("last_tick_error"), F.count_if(F.col("step") == "polled").alias("polls"),
        F.count_if(F.col("error").isNotNull()).alias("errors"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.max_by(F.col("pending"), F.when(F.col("pending").isNotNull(), _order())), F.lit(False)).alias("pending"),
    )
