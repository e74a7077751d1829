"""A review queue that lives: an append-only log of events, folded by key into versioned snapshots.

An event either queues a chunk or labels it. The state of a chunk is that of its latest event, by time, then label
before queue, then event id. The fold is a maximum: events may come in any order, late or twice, and in any split into
batches, and the state is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: at is the event's own time; label is null for an event that queues.
EVENT = "event_id string, chunk_id string, at timestamp, label string, reviewer string"
_ORDER = ["at", "labelled", "event_id"]


def _last(events: DataFrame) -> DataFrame:
    """(chunk_id, last): the latest event of each chunk. An event without chunk, id or time is none."""
    rows = events.where("event_id is not null and chunk_id is not null and at is not null")
    body = F.struct("at", F.col("label").isNotNull().alias("labelled"), "event_id", "label", "reviewer")
    return rows.groupBy("chunk_id").agg(F.max(body).alias("last"))


def _state(folded: DataFrame) -> DataFrame:
    status: Column = F.when(F.col("last.labelled"), "labelled").otherwise("queued")
    return folded.select("chunk_id", status.alias("status"), "last.label", "last.reviewer", "last.at", "last.event_id")


def state(events: DataFrame) -> DataFrame:
    """(chunk_id, status, label, reviewer, at, event_id) from all events."""
    return _state(_last(events))


class ReviewLog:
    """Events and snapshots in one folder that all executors share.

    `append` adds events, `compact` folds what came since the last snapshot into a new one, `state` reads the last
    snapshot and what came after it. A snapshot is a folder of its own that becomes visible with its success marker,
    so a compaction that fails, or runs twice, leaves the state as it was. An event that was folded already may come
    again: the maximum does not change.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _versions(self, kind: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        whole = lambda p: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path) if s.getPath().getName().isdigit() and whole(s.getPath()))

    def append(self, events: DataFrame, batch: int | None = None) -> int:
        """Adds events as one batch and returns its number. A given number that is there already is written again: a stream may repeat its last batch."""
        number = batch if batch is not None else max(self._versions("events"), default=-1) + 1
        names = [f.split()[0] for f in EVENT.split(", ")]
        events.select(*names).write.mode("overwrite").parquet(f"{self.folder}/events/{number:012d}")
        return number

    def _read(self, kind: str, numbers: list[int]) -> DataFrame | None:
        if not numbers:
            return None
        return self.spark.read.parquet(*(f"{self.folder}/{kind}/{n:012d}" for n in numbers))

    def _folded(self) -> tuple[DataFrame | None, list[int]]:
        snapshots, events = self._versions("snapshots"), self._versions("events")
        base = self._read("snapshots", snapshots[-1:])
        # A late batch may have a smaller number than one that was folded: a snapshot names the batches it holds.
        held = set(self.spark.read.json(f"{self.folder}/folded/{snapshots[-1]:012d}").first()["batches"]) if snapshots else set()
        fresh = self._read("events", [n for n in events if n not in held])
        parts = [p for p in (base, _last(fresh) if fresh is not None else None) if p is not None]
        if not parts:
            return None, events
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return rows.groupBy("chunk_id").agg(F.max("last").alias("last")), events

    def state(self) -> DataFrame:
        """The state of every chunk."""
        folded, _ = self._folded()
        return _state(folded) if folded is not None else state(self.spark.createDataFrame([], EVENT))

    def compact(self) -> int | None:
        """Writes a new snapshot of all events so far and returns its number; None if there are none."""
        folded, events = self._folded()
        if folded is None:
            return None
        number = max(self._versions("snapshots"), default=-1) + 1
        self.spark.createDataFrame([(events,)], "batches array<long>").coalesce(1).write.mode("overwrite").json(f"{self.folder}/folded/{number:012d}")
        folded.write.mode("overwrite").parquet(f"{self.folder}/snapshots/{number:012d}")
        return number

    def follow(self, stream: DataFrame, checkpoint: str, every: int = 10):
        """A streaming query that appends each micro-batch of events and compacts after every so many; a repeated batch is written again under its number."""

        def put(events: DataFrame, number: int) -> None:
            self.append(events, number)
            if number % every == every - 1:
                self.compact()

        return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def queue(log: DataFrame) -> DataFrame:
    """What still waits for a label, the oldest first."""
    return log.where("status = 'queued'").orderBy("at", "chunk_id")
