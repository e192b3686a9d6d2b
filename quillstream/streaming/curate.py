"""The consolidation loop as a stream of micro-batches, and event rates under a watermark.

Each batch appends new events to the log, and then, until none is pending, claims a prefix of bounded content, applies a
plan function and publishes. A claim is written as the manifest of its run before anything is done with it; the version
that a run publishes and its entry in the run log are one file. Whatever step a batch stopped after, its replay finds the
events in the log, the manifest of each run and the version of each published run, and goes on with what is missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstream.operators import inbox
from quillstream.sinks.shared import SharedFolder
from quillstream.sinks.snapshots import Snapshots, append_events

EVENT_SCHEMA = "id string, source string, writer string, event_key string, kind string, confidence string, content_sha256 string, body string"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 32) -> DataFrame:
    """New event files of a folder, in parquet."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Runs:
    """The log, manifests and published notes of one home folder."""

    def __init__(self, spark: SparkSession, home: str):
        self.spark, self.home, self.shared = spark, home.rstrip("/"), SharedFolder(spark, home)
        self.notes = Snapshots(spark, f"{self.home}/notes")

    def log(self) -> DataFrame:
        at = f"{self.home}/log"
        return self.spark.read.schema(EVENT_SCHEMA).parquet(at) if self.shared.exists("log") else self.spark.createDataFrame([], EVENT_SCHEMA)

    def manifests(self) -> list[str]:
        """Runs whose manifest is whole, in order."""
        return [n for n in self.shared.names("manifests") if self.shared.exists(f"manifests/{n}/_SUCCESS")]

    def claimed(self, *runs: str) -> DataFrame:
        """run, pos, id of the events that runs have claimed, in their order."""
        return self.spark.read.schema("run string, pos int, id string").parquet(*(f"{self.home}/manifests/{r}" for r in runs))

    def events_of(self, run: str) -> DataFrame:
        """The events of a run with pos, their place in its manifest."""
        return self.log().join(self.claimed(run).select("id", "pos"), "id")

    def pending(self) -> DataFrame:
        held = self.manifests()
        return self.log().join(self.claimed(*held).select("id"), "id", "left_anti") if held else self.log()

    def status(self) -> DataFrame:
        """id, run, status (inbox, processing, processed) of every event."""
        held = self.manifests()
        none = self.spark.createDataFrame([], "id string, run string")
        claimed = self.claimed(*held).select("id", "run") if held else none
        done = self.notes.published().select("run").distinct().withColumn("done", F.lit(True))
        status = F.when(F.col("done"), "processed").when(F.col("run").isNotNull(), "processing").otherwise("inbox")
        return self.log().select("id").join(claimed, "id", "left").join(done, "run", "left").select("id", "run", status.alias("status"))

    def claim(self, run: str, cap: int) -> bool:
        """Write the manifest of a run, unless it is there; false if nothing is pending."""
        if run not in self.manifests():
            own = inbox.claim(self.pending(), cap)
            if own.isEmpty():
                return False
            # places within blocks of the order, so that no task holds all events of a large claim
            order = own.select("id").orderBy("id").rdd.map(lambda r: r.id).zipWithIndex()
            rows = self.spark.createDataFrame(order.map(lambda x: (run, int(x[1]), x[0])), "run string, pos int, id string")
            rows.write.mode("overwrite").parquet(f"{self.home}/manifests/{run}")
        return True

    def finish(self, run: str, plan: Callable[[DataFrame], DataFrame]) -> None:
        """Publish what a run's events give, unless it has been."""
        if self.notes.version_of(run) is None:
            self.notes.publish(plan(self.events_of(run).drop("pos")), self.notes.current(), run, append=True)

    def recover(self, plan: Callable[[DataFrame], DataFrame]) -> list[str]:
        """Publish the runs that have a manifest and no version, in order, and return them."""
        open_ = [r for r in self.manifests() if self.notes.version_of(r) is None]
        for run in open_:
            self.finish(run, plan)
        return open_


def curate(stream: DataFrame, home: str, plan: Callable[[DataFrame], DataFrame], cap: int = inbox.CLAIM_CAP) -> StreamingQuery:
    """Start the loop over what is there now. plan turns claimed events into (basename, source) rows of the corpus."""

    def batch(events: DataFrame, batch_id: int) -> None:
        runs = Runs(events.sparkSession, home)
        append_events(events, f"{runs.home}/log")
        part = 0
        while runs.claim(run := f"run-{batch_id:08d}-{part:05d}", cap):
            runs.finish(run, plan)
            part += 1

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{home.rstrip('/')}/checkpoint").trigger(availableNow=True).start()


def event_rates(stream: DataFrame, at: str = "ts", window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, n: events per window, late ones counted while the watermark allows."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window).start.alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
