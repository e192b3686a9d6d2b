"""The whole engine behind one object: what its tools, handlers and resources answer, each as a frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import redact as R
from quillstream.functions import text as X
from quillstream.operators import curation, graph, inbox, lint, notes, packs, ranking
from quillstream.sinks.snapshots import append_events
from quillstream.streaming.curate import Runs


class Desk:
    """notes: a corpus view (as operators.notes.corpus gives it); home: the folder of the event log and its runs."""

    def __init__(self, spark: SparkSession, own: DataFrame, home: str | None = None):
        self.spark, self.notes = spark, own
        self.runs = Runs(spark, home) if home else None

    def remember(self, facts: DataFrame) -> int:
        """Append facts (id, writer, source, text, event_key) as events; returns how many were new. Secrets are redacted first."""
        safe = R.redact(F.col("text"))
        rows = facts.select("id", "source", "writer", "event_key", F.lit("capture").alias("kind"), F.lit("high").alias("confidence"), X.content_sha(safe).alias("content_sha256"), safe.alias("body"))
        return append_events(inbox.valid_events(rows), f"{self.runs.home}/log")

    def query(self, questions: list[str], limit: int = ranking.MAX_HITS) -> DataFrame:
        return ranking.rank(self.notes, ranking.questions_frame(self.spark, questions), max(0, limit))

    def browse(self, domain: str | None = None, kind: str | None = None) -> DataFrame:
        """path, basename, title, type, status, domain, updated, summary of notes, by path."""
        rows = self.notes.select(
            "path", "basename", F.coalesce("title", F.replace("basename", F.lit("-"), F.lit(" "))).alias("title"), "type", "status", X.path_domain(F.col("path")).alias("domain"), "updated",
            F.coalesce(F.get_json_object("frontmatter", "$.summary"), X.first_paragraph(F.col("body"))).alias("summary"),
        )
        if domain is not None:
            rows = rows.where(F.col("domain") == domain)
        return (rows if kind is None else rows.where(F.col("type") == kind)).orderBy("path")

    def note(self, path: str) -> DataFrame:
        """The note of exactly this path, or none."""
        return self.notes.where(F.col("path") == path).select("path", "title", "frontmatter", "body")

    def neighbors(self, path: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
        """Nodes around a note with their distance, and the links among them."""
        links = notes.edges(self.notes)
        centre = self.notes.where(F.col("path") == path).select("note_id").first()
        return graph.ego(links, centre.note_id if centre else -1, depth)

    def graph(self, domain: str | None = None, most: int = graph.MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes (with orphan, which is of the whole corpus), links and totals, of a domain or of all."""
        alone = lint.orphan_themes(self.notes).withColumn("orphan", F.lit(True))
        nodes = self.notes.select(F.col("note_id").alias("node"), "path", "basename", "type").join(alone, "basename", "left").withColumn("orphan", F.coalesce("orphan", F.lit(False)))
        nodes = nodes if domain is None else nodes.where(X.path_domain(F.col("path")) == domain)
        links = notes.edges(self.notes)
        return graph.overview(nodes, links if domain is None else graph.induced(links, nodes), most)

    def health(self) -> DataFrame:
        return lint.health(self.notes)

    def status(self, today: str) -> DataFrame:
        """inbox_depth, processing, processed, and the last run."""
        rows = self.runs.status().agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("inbox", "processing", "processed")))
        return rows.join(F.broadcast(self.runs.notes.published().agg(F.max("run").alias("last_run"))), how="inner").withColumn("today", F.lit(today))  # one row

    def context(self, scored: DataFrame, name: str = "main", version: str = "v1", budget: int = packs.BUDGET) -> DataFrame:
        """The pack of scored lines (path, score, line, tokens, content_sha256) as one row of text and counts."""
        return packs.pack_text(packs.fill_budget(scored, budget, packs.frame_cost(name)), name, version)

    def curate(self, plan: Callable[[DataFrame], DataFrame], cap: int = inbox.CLAIM_CAP) -> list[str]:
        """Recover open runs, then claim and publish until nothing is pending; returns the runs."""
        done = self.runs.recover(plan)
        number = len(self.runs.manifests())
        while self.runs.claim(run := f"desk-{number:08d}", cap):
            self.runs.finish(run, plan)
            done.append(run)
            number += 1
        return done

    def related(self, candidates: DataFrame) -> DataFrame:
        return curation.related(self.notes, candidates)
