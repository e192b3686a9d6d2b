"""What a consolidation run needs and leaves behind: related notes, harvest counters, failures, status and the work log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators import inbox, ranking

#: Rejected, and neither accepted nor rejected, operations of a plan.
REJECTED, SKIPPED = "DROP", "NOOP"


def related(notes: DataFrame, candidates: DataFrame, most: int = inbox.RELATED) -> DataFrame:
    """candidate_id, pos, note_id, path, score: the best notes of each candidate (candidate_id, text), its text asked as a question.

    A run's candidates are bounded by its claim, so they are one batch of questions.
    """
    asked = candidates.select(F.col("candidate_id").alias("qid"), F.col("text").alias("question"))
    return ranking.rank(notes, asked, limit=most).select(F.col("qid").alias("candidate_id"), "pos", "note_id", "path", "score")


def harvest_deltas(plan: DataFrame, provenance: DataFrame, connectors: DataFrame) -> DataFrame:
    """connector, accepted, rejected: one per harvested event of a candidate that a plan (candidate_id, op) disposes of.

    provenance: candidate_id, source of every event. connectors: connector, named <type>:<agent>; a source harvest:<agent>
    of an agent without one counts nowhere.
    """
    agents = connectors.select("connector", F.regexp_extract("connector", "^[^:]*:(.*)$", 1).alias("agent")).where("agent <> ''").groupBy("agent").agg(F.max("connector").alias("connector"))
    tuples = provenance.where(F.col("source").startswith("harvest:")).select("candidate_id", F.substring("source", 9, 10_000).alias("agent"))
    held = plan.where(F.col("op") != SKIPPED).select("candidate_id", "op").join(tuples, "candidate_id").join(agents, "agent")
    return held.groupBy("connector").agg(F.count_if(F.col("op") != REJECTED).alias("accepted"), F.count_if(F.col("op") == REJECTED).alias("rejected"))


def apply_deltas(cursors: DataFrame, deltas: DataFrame) -> DataFrame:
    """Cursors (connector, proposed, accepted, rejected) with deltas added; a connector without a cursor gets none."""
    d = deltas.select("connector", F.col("accepted").alias("__a"), F.col("rejected").alias("__r"))
    return cursors.join(d, "connector", "left").withColumns({c: F.col(c) + F.coalesce(x, F.lit(0)) for c, x in (("accepted", "__a"), ("rejected", "__r"))}).drop("__a", "__r")


def dispositions(plan: DataFrame, candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """candidate_id, op, content_sha256, event_id, source, writer: every event with what was decided of it."""
    return plan.select("candidate_id", "op").join(candidates.select("candidate_id", "content_sha256"), "candidate_id").join(provenance, "candidate_id")


def roll_up(plan: DataFrame, failed: Column | int = 0) -> DataFrame:
    """ingested, merged, dropped, failed: what a run adds to the counters."""
    op = F.col("op")
    return plan.agg(F.count_if(op.isin("CREATE_THEME", "APPEND_DAILY")).alias("ingested"), F.count_if(op.isin("MERGE_INTO_THEME", "MARK_CONTESTED")).alias("merged"), F.count_if(op.isin(REJECTED, SKIPPED)).alias("dropped")).withColumn("failed", F.lit(failed).cast("long"))


def under_delivered(plan: DataFrame) -> DataFrame:
    """candidate_id of daily entries that ask for no prose."""
    return plan.where((F.col("op") == "APPEND_DAILY") & ~F.coalesce("needs_prose", F.lit(False))).select("candidate_id")


def failure_is_current(last_failure: Column, last_run: Column) -> Column:
    """Whether a failure has not been followed by a publication; at the same second it stands."""
    return last_failure.isNotNull() & (last_run.isNull() | (last_failure >= last_run))


def failure_streaks(runs: DataFrame, by: str, at: str, ok: str) -> DataFrame:
    """by, at, failures: failed runs without a break up to each run, 0 after a good one."""
    w = Window.partitionBy(by).orderBy(at)
    island = F.sum(F.col(ok).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = runs.withColumn("__i", island)
    n = F.sum((~F.col(ok)).cast("int")).over(Window.partitionBy(by, "__i").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(by, at, n.alias("failures"))


def read_attempts(lines: DataFrame, text: str = "value") -> DataFrame:
    """run_id, event_ids of attempt records, one JSON object a line; a single id is a list of one, what is no object is left out."""
    v = F.try_parse_json(F.col(text))
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    rows = lines.select(v.alias("v")).where(F.col("v").isNotNull() & F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select(get("$.run_id", "string").alias("run_id"), F.coalesce(get("$.event_ids", "array<string>"), F.array(get("$.event_ids", "string")), F.array().cast("array<string>")).alias("event_ids"))


def selected(spooled: DataFrame, kind: str, value: str | None = None) -> DataFrame:
    """Failed events (path, id, run_id) of a selector: all, run, or event - by file name first, by id only if no name is it."""
    if kind == "all":
        return spooled
    if kind == "run":
        return spooled.where(F.col("run_id") == value)
    if kind != "event":
        raise ValueError("select all, run or event")
    stem = spooled.where(F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", "") == value)
    return stem if not stem.isEmpty() else spooled.where(F.col("id") == value)


def settled_records(records: DataFrame, remaining: DataFrame) -> DataFrame:
    """record_id of attempt records (record_id, event_ids) none of whose events remains failed (event_id): those that may be put away."""
    open_ = records.select("record_id", F.explode("event_ids").alias("event_id")).join(remaining.select("event_id").distinct(), "event_id", "left_semi").select("record_id").distinct()
    return records.select("record_id").distinct().join(open_, "record_id", "left_anti")


def parse_ops(c: Column) -> Column:
    """op=n, op=n as a map; no-op and tokens without a whole number are left out."""
    pairs = F.filter(F.transform(F.split(c, ","), lambda t: F.struct(F.trim(F.substring_index(t, "=", 1)).alias("k"), F.when(t.contains("="), F.trim(F.regexp_replace(t, r"^[^=]*=", ""))).try_cast("int").alias("v"))), lambda p: p.v.isNotNull())
    return F.when(c.isNull() | (c == "") | (c == "no-op"), F.create_map().cast("map<string,int>")).otherwise(F.map_from_entries(pairs))


def work_log(text: DataFrame, most: int = 10) -> DataFrame:
    """pos, run, fields of the newest sections of work logs (text), each a heading "## run" and bullets "- key: value"; newest last in the text, first here."""
    parts = F.filter(F.split("text", r"(?m)^(?=## )"), lambda p: p.startswith("## "))
    newest = text.select(F.posexplode(F.slice(F.reverse(parts), 1, most)).alias("pos", "part"))
    bullets = F.filter(F.split("part", "\n"), lambda x: x.rlike(r"^- [^:]+:"))
    entry = F.transform(bullets, lambda b: F.struct(F.trim(F.regexp_extract(b, r"^- ([^:]+):", 1)).alias("k"), F.trim(F.regexp_replace(b, r"^- [^:]+:", "")).alias("v")))
    return newest.select("pos", F.trim(F.regexp_extract("part", r"^## ([^\n]*)", 1)).alias("run"), F.map_from_entries(entry).alias("fields"))


def status(inbox_events: DataFrame, processed: DataFrame, failed: DataFrame, runs: DataFrame, today: str) -> DataFrame:
    """One row: inbox_depth, processed_today, failed, last_consolidation, last_run and the counters of all runs.

    processed: id, at. runs: run_id, at, ingested, merged, dropped, failed.
    """
    parts = [
        inbox_events.agg(F.count(F.lit(1)).alias("inbox_depth")),
        processed.agg(F.count_if(F.to_date("at") == F.lit(today).cast("date")).alias("processed_today")),
        failed.agg(F.count(F.lit(1)).alias("failed_events")),
        runs.agg(X.iso_z(F.max("at")).alias("last_consolidation"), F.max_by("run_id", F.struct("at", "run_id")).alias("last_run"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("ingested", "merged", "dropped", "failed"))),
    ]
    out = parts[0]
    for one in parts[1:]:
        out = out.join(F.broadcast(one), how="inner")  # one row each
    return out
