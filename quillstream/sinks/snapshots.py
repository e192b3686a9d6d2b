"""Versioned snapshots with a compare-and-swap pointer, an idempotent event log, upserts and markdown export.

Parquet has no merge: a version is a list of folders, and a new one is written beside the old. Pointers are numbered
files that are created only if they do not exist, so of two writers that start from one version one fails. A folder that
no pointer names is never read. The pointers, each with its run, are the run log: one entry per published run.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators.inbox import first_deliveries, undelivered
from quillstream.sinks.shared import SharedFolder

#: Folders of a version from which the next one is written as a single folder.
MAX_PARTS = 64


class Conflict(RuntimeError):
    """The pointer names another version than expected."""


class Snapshots:
    """Versions of one table below root, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.shared = spark, root.rstrip("/"), SharedFolder(spark, root)

    def _pointers(self) -> list[str]:
        return [n for n in self.shared.names("pointers") if n.isdigit()]

    def _last(self) -> tuple[int, dict | None]:
        names = self._pointers()
        return (int(names[-1]), json.loads(self.shared.read(f"pointers/{names[-1]}"))) if names else (-1, None)

    def current(self) -> str | None:
        found = self._last()[1]
        return found["version"] if found else None

    def published(self) -> DataFrame:
        """version, run, parts, n_rows of every publication, in order of number: the run log."""
        schema = "number bigint, version string, run string, parts array<string>, note string"
        rows = self.spark.read.schema(schema).json(f"{self.root}/pointers") if self._pointers() else self.spark.createDataFrame([], schema)
        return rows.where("version is not null")

    def version_of(self, run: str) -> str | None:
        found = self.published().where(F.col("run") == run).first()
        return found.version if found else None

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/{p}" for p in parts))

    def read(self, version: str | None = None) -> DataFrame:
        found = self._last()[1] if version is None else self.published().where(F.col("version") == version).first()
        if found is None:
            raise FileNotFoundError(f"no version in {self.root}")
        return self._read(found["parts"])

    def publish(self, df: DataFrame, expected: str | None, run: str | None = None, append: bool = False, note: str = "") -> str:
        """Write df as a version, or as rows beside those of the expected one, and point to it if the pointer still names expected.

        A run published before, even long ago, is left alone: its version is returned and nothing is written.
        """
        if run and (held := self.version_of(run)):
            return held
        number, last = self._last()
        version = f"v-{run or 'x'}-{uuid.uuid4().hex[:12]}"
        parts = [*last["parts"], version] if append and last else [version]
        if len(parts) > MAX_PARTS:
            df, parts = self._read(last["parts"]).unionByName(df), [version]
        df.write.parquet(f"{self.root}/{version}")
        now = last["version"] if last else None
        if now != expected:
            raise Conflict(f"expected {expected}, found {now}")
        entry = {"number": number + 1, "version": version, "run": run, "parts": parts, "note": note}
        if not self.shared.create(f"pointers/{number + 1:012d}", json.dumps(entry)):
            raise Conflict("another publication came first")
        return version


def append_events(events: DataFrame, path: str) -> int:
    """Append events whose (writer, event_key), or id, the log does not hold yet; returns how many."""
    spark = events.sparkSession
    new = first_deliveries(events)
    if SharedFolder(spark, path).exists(""):
        held = spark.read.schema(events.schema).parquet(path)
        new = undelivered(new, held.where("event_key is not null")).join(held.select("id"), "id", "left_anti")
    n = new.count()
    if n:
        new.select(*events.columns).write.mode("append").parquet(path)
    return n


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row per key of both frames."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return old.unionByName(new).withColumn("__r", last).where("__r = 1").drop("__r")


def markdown(notes: DataFrame) -> DataFrame:
    """path, text: notes (path, frontmatter map, body) as markdown with a fence of their frontmatter."""
    lines = F.array_join(F.transform(F.map_entries("frontmatter"), lambda e: F.concat(e.key, F.lit(": "), e.value)), "\n")
    return notes.select("path", F.concat(F.lit("---\n"), lines, F.lit("\n---\n\n"), "body", F.lit("\n")).alias("text"))
