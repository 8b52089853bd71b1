"""Evidence that arrives in a folder, through Structured Streaming."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from purseflow.functions import ids
from purseflow.sources.files import new_evidence

POLL = "900 seconds"


def mail_stream(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.eml").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(ids.evidence_digest().alias("digest"), "content")


def ingest(stream: DataFrame, store: str, checkpoint: str, sync: Callable[[DataFrame, int], None] | None = None, poll: str | None = None) -> StreamingQuery:
    """Append what is new to ``store`` and hand it to ``sync``. A batch that is repeated after
    a failure adds nothing twice: digests that are stored already are dropped. Without
    ``poll`` the query reads what there is and ends."""

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(store).select("digest")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "digest string")
        fresh = new_evidence(batch, known)
        fresh.write.mode("append").parquet(store)
        if sync is not None:
            sync(spark.read.parquet(store), epoch)

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=poll) if poll else writer.trigger(availableNow=True)).start()


class RunLog(StreamingQueryListener):
    """Progress of queries as rows: name, batch, rows, seconds, and the error that ended one. The driver
    holds the last ``held``; ``flush`` appends them to a table."""

    SCHEMA = "query string, event string, batch long, input_rows long, duration_ms long, error string"

    def __init__(self, held: int = 10_000):
        self.rows: deque[tuple] = deque(maxlen=held)

    def onQueryStarted(self, event):
        self.rows.append((str(event.id), "started", None, None, None, None))

    def onQueryProgress(self, event):
        p = event.progress
        self.rows.append((str(p.id), "progress", p.batchId, p.numInputRows, p.batchDuration, None))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.rows.append((str(event.id), "ended", None, None, None, event.exception))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.rows], self.SCHEMA)

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append what is held to a table, and forget it."""
        rows = [self.rows.popleft() for _ in range(len(self.rows))]
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return len(rows)


def acquire_counts(batch: DataFrame, known: DataFrame) -> tuple[int, int]:
    """How many rows were fetched and how many of them are new."""
    fetched = batch.agg(F.count("*")).first()[0]
    return fetched, new_evidence(batch, known).agg(F.count("*")).first()[0]
