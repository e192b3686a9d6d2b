"""The event log: idempotent delivery, claims, candidates, attempts, retries and requeues.

Whatever is first, last or counted per key is found by aggregation (combined before the shuffle), not by a window over
the key, so that one writer, key or content may hold most events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("capture", "candidate")
# Sources that need no name.
SOURCES = ("claude-code", "codex", "qwen", "gemini", "opencode", "hermes", "manual")
CONFIDENCE = ("low", "medium", "high")
#: Distinct contents of a run, related notes of a candidate, attempts before an event has failed.
CLAIM_CAP, RELATED, MAX_ATTEMPTS = 32, 8, 3
ID_PATTERN = r"\A\d{4}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}\.\d{3}Z--[0-9a-f]{6}\z"


def valid_events(events: DataFrame) -> DataFrame:
    """Events with a well-formed id and source."""
    named = F.col("source").rlike(r"\A(?:(?:web|harvest):.+|team:[A-Za-z0-9][A-Za-z0-9._-]*)\z")
    return events.where(F.col("id").rlike(ID_PATTERN) & (F.col("source").isin(*SOURCES) | named))


def first_deliveries(events: DataFrame) -> DataFrame:
    """Events without those that repeat the key of an earlier one of their writer; an event without a key is kept."""
    keyed = events.where("event_key is not null").groupBy("writer", "event_key").agg(F.min("id").alias("id")).select("id")
    return events.where("event_key is null").unionByName(events.where("event_key is not null").join(keyed, "id", "left_semi"))


def undelivered(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events whose (writer, event_key) is not in the ledger."""
    return events.join(ledger.select("writer", "event_key").distinct(), ["writer", "event_key"], "left_anti")


def claim(events: DataFrame, cap: int = CLAIM_CAP) -> DataFrame:
    """The longest prefix by id with at most cap distinct contents: all before the first event of content cap + 1."""
    firsts = events.groupBy("content_sha256").agg(F.min("id").alias("first")).orderBy("first").limit(cap + 1)
    bound = firsts.agg(F.count(F.lit(1)).alias("n"), F.max("first").alias("last"))
    return events.join(F.broadcast(bound), how="inner").where((F.col("n") <= cap) | (F.col("id") < F.col("last"))).drop("n", "last")


def candidates(claimed: DataFrame) -> DataFrame:
    """candidate_id (c1, c2, ... by first event), content_sha256, n_events, first_id, worst kind and confidence, is_gated.

    claimed holds at most a claim's contents, so the numbering ranks a bounded number of rows.
    """
    rank = F.when(F.col("kind") == "candidate", 1).otherwise(0)
    sure = F.when(F.col("confidence") == "low", 0).when(F.col("confidence") == "medium", 1).when(F.col("confidence") == "high", 2)
    grouped = claimed.groupBy("content_sha256").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_events"), F.max(rank).alias("k"), F.min(sure).alias("c"))
    number = F.row_number().over(Window.orderBy("first_id"))
    return grouped.select(
        F.concat(F.lit("c"), number.cast("string")).alias("candidate_id"), "content_sha256", "n_events", "first_id",
        F.when(F.col("k") == 1, "candidate").otherwise("capture").alias("kind"), F.get(F.array(*(F.lit(c) for c in CONFIDENCE)), F.col("c")).alias("confidence"), ((F.col("k") == 1) | (F.coalesce("c", F.lit(2)) == 0)).alias("is_gated"),
    )


def provenance(claimed: DataFrame, found: DataFrame) -> DataFrame:
    """candidate_id, event_id, source, writer of every event of every candidate."""
    return claimed.join(F.broadcast(found.select("content_sha256", "candidate_id")), "content_sha256").select("candidate_id", F.col("id").alias("event_id"), "source", "writer")


def attempt_counts(attempts: DataFrame) -> DataFrame:
    """event_id, attempts: one per record and mention."""
    return attempts.select(F.explode("event_ids").alias("event_id")).groupBy("event_id").agg(F.count(F.lit(1)).alias("attempts"))


def retry(failed: DataFrame, counts: DataFrame, most: int = MAX_ATTEMPTS) -> DataFrame:
    """event_id, attempt, disposition: back to the inbox while attempts remain, else failed."""
    n = F.coalesce(F.col("attempts"), F.lit(0)) + 1
    return failed.join(counts, "event_id", "left").select("event_id", n.alias("attempt"), F.when(n < most, "inbox").otherwise("failed").alias("disposition"))


def requeue(spooled: DataFrame, delivered: DataFrame, pending: DataFrame) -> DataFrame:
    """path, id, verdict of failed events: unreadable, delivered, occupied (by the inbox or an earlier claimant), movable."""
    taken = pending.select("id").distinct().withColumn("__busy", F.lit(True))
    done = delivered.select("writer", "event_key").distinct().withColumn("__done", F.lit(True))
    ok = F.col("id").rlike(ID_PATTERN)
    rows = spooled.join(done, ["writer", "event_key"], "left").join(taken, "id", "left")
    base = rows.withColumn("verdict", F.when(~F.coalesce(ok, F.lit(False)), "unreadable").when(F.col("__done"), "delivered").when(F.col("__busy"), "occupied").otherwise("movable"))
    first = base.where("verdict = 'movable'").groupBy("id").agg(F.min("path").alias("__first"))
    verdict = F.when((F.col("verdict") == "movable") & (F.col("path") != F.col("__first")), "occupied").otherwise(F.col("verdict"))
    return base.join(first, "id", "left").select("path", "id", verdict.alias("verdict"))


def depth(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("inbox_depth"), F.max("id").alias("last_id"))


def trigger(depth: Column, idle_minutes: Column, cron_due: Column, threshold: int, idle_after: int) -> Column:
    """Why a run is due: threshold, idle, cron (only with events waiting), or null."""
    return F.when(depth >= threshold, "threshold").when((depth > 0) & (idle_minutes >= idle_after), "idle").when((depth > 0) & cron_due, "cron")


def backoff_seconds(failures: Column, interval: int, most: int = 900) -> Column:
    """The interval doubled per failure (10 at most), up to the larger of it and most."""
    return F.least(F.lit(float(max(interval, most))), F.lit(float(interval)) * F.pow(F.lit(2.0), F.least(failures, F.lit(10)).cast("double")))
