"""Plans of a consolidation run: checks, counts, and their effect on the corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The closed vocabulary of operations.
OPS = ("CREATE_THEME", "APPEND_DAILY", "MERGE_INTO_THEME", "MARK_CONTESTED", "DROP", "NOOP")
KEBAB = r"\A[a-z0-9]+(-[a-z0-9]+)*\z"


def _errors(df: DataFrame, check: str, message) -> DataFrame:
    return df.select(F.lit(check).alias("check"), message.alias("message"), F.col("pos").cast("long").alias("pos"))


def validate(plan: DataFrame, claimed: DataFrame, themes: DataFrame, tags: DataFrame, gated: DataFrame) -> DataFrame:
    """check, message, pos of every rule that a plan breaks.

    plan: pos, candidate_id, event_ids, op, basename, target_basename, status, tags. claimed: event_id. themes:
    basename. tags: tag. gated: candidate_id of candidates that may not become pages of their own.
    """
    covered = plan.select("pos", F.explode("event_ids").alias("event_id"))
    twice = covered.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos")).where("n > 1")
    known = themes.select(F.col("basename").alias("target_basename")).distinct()
    made = plan.where("op = 'CREATE_THEME'")
    again = made.groupBy("basename").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("pos")).where("n > 1")
    none = F.lit(None).cast("long").alias("pos")
    checks = [
        _errors(claimed.select("event_id").distinct().join(covered.select("event_id"), "event_id", "left_anti").withColumn("pos", none), "COVERAGE", F.concat(F.lit("uncovered "), "event_id")),
        _errors(covered.join(claimed.select("event_id"), "event_id", "left_anti"), "PROVENANCE", F.concat(F.lit("unknown event "), "event_id")),
        _errors(twice, "COVERAGE", F.concat(F.lit("covered twice "), "event_id")),
        _errors(plan.where(~F.coalesce(F.col("op").isin(*OPS), F.lit(False))), "CLOSED-VOCAB", F.concat(F.lit("op "), F.coalesce("op", F.lit("null")))),
        _errors(plan.select("pos", F.explode("tags").alias("tag")).join(tags.select("tag").distinct(), "tag", "left_anti"), "TAXONOMY", F.concat(F.lit("tag "), "tag")),
        _errors(made.where(~F.coalesce(F.col("basename").rlike(KEBAB), F.lit(False))), "BASENAME", F.concat(F.lit("basename "), F.coalesce("basename", F.lit("null")))),
        _errors(made.join(themes.select("basename").distinct(), "basename", "left_semi"), "BASENAME", F.concat(F.lit("exists "), "basename")),
        _errors(again, "BASENAME", F.concat(F.lit("made twice "), "basename")),
        _errors(plan.where(F.col("op").isin("MERGE_INTO_THEME", "MARK_CONTESTED")).join(known, "target_basename", "left_anti"), "LINK-RESOLVABILITY", F.concat(F.lit("target "), F.coalesce("target_basename", F.lit("null")))),
        _errors(plan.where(F.col("status").isNotNull() & ~F.col("status").isin("active", "stub", "contested")), "STATUS", F.concat(F.lit("status "), "status")),
        _errors(made.join(gated.select("candidate_id"), "candidate_id", "left_semi"), "CANDIDATE-GATE", F.concat(F.lit("gated "), "candidate_id")),
    ]
    return reduce(DataFrame.unionByName, checks)


def counts(plan: DataFrame) -> DataFrame:
    """op, n."""
    return plan.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


def apply_themes(themes: DataFrame, plan: DataFrame, run_date: str) -> DataFrame:
    """The themes after a plan: new ones inserted; merges extend sources and tags (first seen first) and set the date;
    contested ones change status. themes: basename, title, status, tags, sources, updated. plan also: title, source.
    """
    created = plan.where("op = 'CREATE_THEME'").select("basename", "title", F.coalesce("status", F.lit("active")).alias("status"), "tags", F.array("source").alias("sources"), F.lit(run_date).cast("date").alias("updated"))
    touched = plan.where(F.col("op").isin("MERGE_INTO_THEME", "MARK_CONTESTED")).groupBy(F.col("target_basename").alias("basename")).agg(
        F.transform(F.array_sort(F.collect_set(F.struct("pos", "source"))), lambda s: s.source).alias("__sources"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("pos", "tags"))), lambda s: F.coalesce(s.tags, F.array().cast("array<string>"))))).alias("__tags"),
        F.max(F.col("op") == "MARK_CONTESTED").alias("__contested"),
    )
    joined = themes.join(touched, "basename", "left")
    hit = F.col("__sources").isNotNull()
    merged = joined.select(
        "basename", "title", F.when(F.col("__contested"), "contested").otherwise(F.col("status")).alias("status"),
        F.when(hit, F.array_union(F.coalesce("tags", F.array().cast("array<string>")), "__tags")).otherwise(F.col("tags")).alias("tags"),
        F.when(hit, F.array_union(F.coalesce("sources", F.array().cast("array<string>")), "__sources")).otherwise(F.col("sources")).alias("sources"),
        F.when(hit, F.lit(run_date).cast("date")).otherwise(F.col("updated")).alias("updated"),
    )
    return merged.unionByName(created)


def append_dailies(dailies: DataFrame, plan: DataFrame, run_date: str) -> DataFrame:
    """basename, sections of daily notes keyed <domain>-<date>, with the sections that a plan appends in event order."""
    new = plan.where("op = 'APPEND_DAILY'").groupBy(F.concat_ws("-", "domain", F.lit(run_date)).alias("basename")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("event_ids", 1).alias("first"), "candidate_id", "summary"))), lambda s: s.summary).alias("__new"))
    return dailies.join(new, "basename", "full").select("basename", F.concat(F.coalesce("sections", F.array().cast("array<string>")), F.coalesce("__new", F.array().cast("array<string>"))).alias("sections"))


def author_diff(base: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """path, problem: what authoring may not do - add, remove or touch files outside expected (path), or empty one."""
    a, b = base.select("path", F.col("text").alias("old")), after.select("path", F.col("text").alias("new"))
    allowed = expected.select("path").distinct().withColumn("__ok", F.lit(True))
    problem = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when((F.col("old") != F.col("new")) & F.col("__ok").isNull(), "outside").when((F.col("old") != F.col("new")) & (F.trim("new") == ""), "emptied")
    return a.join(b, "path", "full").join(allowed, "path", "left").withColumn("problem", problem).where("problem is not null").select("path", "problem")
