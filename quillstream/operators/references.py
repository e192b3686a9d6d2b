"""References to records that do not exist.

References are grouped by null mask (which key columns are null); each group is anti-joined to the parent keys on its
non-null columns, under declared match semantics. Keys that do exist are then held against the parents' validity spans
by a sweep over (key, hour), of one row per key and instant, so that neither a hot key on either side nor a long history
lands in one task.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_US = 3_600_000_000
#: More key columns than this would mean more than 64 masks.
MAX_KEYS = 6


def _masked(refs: DataFrame, keys: list[str], mask: tuple[bool, ...]) -> DataFrame:
    tests = [F.col(k).isNull() if null else F.col(k).isNotNull() for k, null in zip(keys, mask)]
    return refs.where(reduce(Column.__and__, tests))


def _dead_in_time(refs: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Of references whose key exists: those at whose instant no parent row is valid.

    refs: keys, __at (microseconds, may be null), __row. spans: keys, __from, __to (microseconds). A parent row holds from
    __from (inclusive) to __to (exclusive; null: for ever). The number of rows that hold at t is what began up to t less
    what ended up to t, so counts per hour, carried forward, and the order inside one hour decide.
    """
    begun = spans.where("__from is not null")
    holds = F.col("__to").isNull() | (F.col("__to") > F.col("__from"))
    edges = (
        begun.select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col("__from").alias("t"), F.when(holds, 1).otherwise(0).cast("long").alias("d"), F.lit(1).cast("long").alias("s")),
                    F.struct(F.when(holds, F.col("__to")).alias("t"), F.lit(-1).cast("long").alias("d"), F.lit(0).cast("long").alias("s")),
                )
            ).alias("e"),
        )
        .where("e.t is not null")
        .groupBy(*keys, F.col("e.t").alias("__at"))
        .agg(F.sum("e.d").alias("__d"), F.sum("e.s").alias("__s"))
        .withColumn("__b", F.floor(F.col("__at") / BUCKET_US))
    )
    # however many references name one key at one instant, they are one row in the windows
    dated = refs.where("__at is not null").select(*keys, "__at").distinct().withColumn("__b", F.floor(F.col("__at") / BUCKET_US))
    hours = (
        edges.select(*keys, "__b", "__d", "__s")
        .unionByName(dated.select(*keys, "__b").distinct().withColumns({"__d": F.lit(0).cast("long"), "__s": F.lit(0).cast("long")}))
        .groupBy(*keys, "__b")
        .agg(F.sum("__d").alias("__d"), F.sum("__s").alias("__s"))
    )
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select(
        *keys,
        "__b",
        F.lit(None).cast("long").alias("__at"),
        F.lit(0).alias("__kind"),
        F.coalesce(F.sum("__d").over(before), F.lit(0)).alias("__d"),
        F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__s"),
    )
    rows = carried.unionByName(edges.withColumn("__kind", F.lit(1))).unionByName(dated.withColumns({"__kind": F.lit(2), "__d": F.lit(0).cast("long"), "__s": F.lit(0).cast("long")}))
    up_to = Window.partitionBy(*keys, "__b").orderBy(F.col("__at").asc_nulls_first(), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({"__alive": F.sum("__d").over(up_to), "__begun": F.sum("__s").over(up_to)})
    dead_keys = seen.where("__kind = 2 and __alive <= 0").select(*keys, "__at", F.when(F.col("__begun") > 0, "deleted").otherwise("late").alias("__reason"))
    dead = refs.where("__at is not null").join(dead_keys, [*keys, "__at"]).select("__row", "__reason")
    undated = refs.where("__at is null").select("__row", F.lit("late").alias("__reason"))
    return dead.unionByName(undated)


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    on: list[tuple[str, str]],
    match: str = "simple",
    at: str | None = None,
    valid: tuple[str, str] | None = None,
    reason: str = "reason",
) -> DataFrame:
    """Rows of refs that refer to no row of parents, with a reason column.

    on: (reference column, parent column) pairs of the composite key. match, as in the SQL standard: "simple" - a key
    with any null refers to nothing and is never an orphan; "full" - all null is fine, some null is an orphan
    ("partial_null"), none null is looked up; "partial" - what is not null is looked up. at and valid: the reference's
    timestamp and the parent's (from, to) timestamps; then a parent row counts only if from <= at and (to is null or
    to > at).

    Reasons: "missing" (no parent row has the key), "deleted" (one had begun, none holds at that time), "late" (none had
    begun, or the reference has no time), "partial_null". Repeated reference rows each come out. Empty refs give an
    empty result; empty parents make every looked-up reference missing. Other columns of either side, whatever their
    names, neither clash nor change; reason replaces a reference column of that name.
    """
    if match not in ("simple", "full", "partial"):
        raise ValueError("match is simple, full or partial")
    if not on or len(on) > MAX_KEYS:
        raise ValueError(f"give 1 to {MAX_KEYS} key columns")
    keys = [f"__k{i}" for i in range(len(on))]
    us = lambda df, c: F.unix_micros(df[c].cast("timestamp"))
    own = refs.select(
        *(refs[r].alias(k) for k, (r, _) in zip(keys, on)),
        (us(refs, at) if at else F.lit(None).cast("long")).alias("__at"),
        F.struct(*(refs[c] for c in refs.columns)).alias("__row"),
    )
    theirs = parents.select(
        *(parents[p].alias(k) for k, (_, p) in zip(keys, on)),
        (us(parents, valid[0]) if valid else F.lit(0).cast("long")).alias("__from"),
        (us(parents, valid[1]) if valid else F.lit(None).cast("long")).alias("__to"),
    )
    found = []
    for mask in product((False, True), repeat=len(keys)):
        held = [k for k, null in zip(keys, mask) if not null]
        group = _masked(own, keys, mask)
        if not held or (len(held) < len(keys) and match == "simple"):
            continue
        if len(held) < len(keys) and match == "full":
            found.append(group.select("__row", F.lit("partial_null").alias("__reason")))
            continue
        spans = theirs.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in held]))
        known = spans.select(*held).distinct()
        found.append(group.join(known, held, "left_anti").select("__row", F.lit("missing").alias("__reason")))
        if at and valid:
            found.append(_dead_in_time(group.join(known, held, "left_semi").select(*held, "__at", "__row"), spans, held))
    if not found:
        found = [own.where("false").select("__row", F.lit("").alias("__reason"))]
    rows = reduce(DataFrame.unionByName, found)
    return rows.select(*(F.col("__row")[c].alias(c) for c in refs.columns if c != reason), F.col("__reason").alias(reason))


def link_target(link: Column) -> Column:
    """The basename that a link means: before any | label and # anchor, without blanks around it, folders and a final .md."""
    said = F.regexp_replace(F.regexp_replace(link, r"(?s)[|#].*$", ""), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(said, r"(?s)^.*/", ""), r"\.md$", "")


def note_links(parsed_notes: DataFrame) -> DataFrame:
    """note_id, target, parsed_at: each link once per note; null lists and empty targets give none."""
    return (
        parsed_notes.select("note_id", "parsed_at", F.explode("outlinks").alias("link"))
        .select("note_id", link_target(F.col("link")).alias("target"), "parsed_at")
        .where("target is not null and target <> ''")
        .distinct()
    )


def dead_links(parsed_notes: DataFrame, note_files: DataFrame) -> DataFrame:
    """note_id, target, parsed_at, reason of every link of a parsed note that no note answers at the time of parsing."""
    return orphan_references(note_links(parsed_notes), note_files, [("target", "basename")], "simple", "parsed_at", ("first_seen", "removed_at"))


def dead_link_report(dead: DataFrame, referring: str) -> DataFrame:
    """tab, month, reason, n: dead links per referring table, month of parsing (null if undated) and reason."""
    return dead.groupBy(F.lit(referring).alias("tab"), F.date_format("parsed_at", "yyyy-MM").alias("month"), "reason").agg(F.count(F.lit(1)).alias("n"))
