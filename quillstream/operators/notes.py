"""The note corpus: snapshot views, line parsing and link surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X


def composed(df: DataFrame, *columns: str) -> DataFrame:
    """df with string columns in canonical composition; only texts that hold a character it may change leave the JVM."""
    return df.withColumns({c: F.coalesce(X.nfc(F.when(F.col(c).rlike(X.UNCOMPOSED), F.col(c))), F.col(c)) for c in columns})


def corpus(note_files: DataFrame, parsed_notes: DataFrame) -> DataFrame:
    """One row per note: its parsed form with type, frontmatter fields and life span; repeated deliveries count once."""
    files = note_files.dropDuplicates(["note_id"]).select("note_id", "rel_path", "type", "frontmatter", "body", "first_seen", "removed_at")
    parsed = parsed_notes.dropDuplicates(["note_id"])
    return parsed.join(files, "note_id").select(
        "note_id", F.col("rel_path").alias("path"), "basename", "type", "is_moc", "is_index", "title", "title_line", "headings", "tags",
        F.lower(X.trim(F.col("status"))).alias("status"), "body_lines", "outlinks", "body", "frontmatter",
        F.get_json_object("frontmatter", "$.updated").try_cast("date").alias("updated"), "first_seen", "removed_at", "parsed_at",
    )


def alive(notes: DataFrame) -> DataFrame:
    """Notes that have not been removed."""
    return notes.where("removed_at is null")


def lines(notes: DataFrame, key: str = "note_id", body: str = "body") -> DataFrame:
    """key, line (1-based), text, fenced (inside a code fence), delimiter (a fence line itself)."""
    rows = notes.select(key, F.posexplode(F.split(body, "\n")).alias("line", "text"))
    mark = rows.select(key, (F.col("line") + 1).alias("line"), "text", F.col("text").rlike(X.FENCE).alias("delimiter"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return mark.withColumn("fenced", (F.sum(F.col("delimiter").cast("int")).over(w) % 2 == 1) & ~F.col("delimiter"))


def headings(line_table: DataFrame, key: str = "note_id") -> DataFrame:
    """key, line, level, text, slug: headings outside fences; repeated slugs get -1, -2, ..., empty ones nothing."""
    found = line_table.where(~F.col("fenced") & ~F.col("delimiter") & F.col("text").rlike(X.HEADING)).select(
        key, "line", F.length(F.regexp_extract("text", X.HEADING, 1)).alias("level"), F.regexp_extract("text", X.HEADING, 2).alias("text")
    )
    base = found.withColumn("base", X.slug(F.col("text")))
    n = F.row_number().over(Window.partitionBy(key, "base").orderBy("line")) - 1
    return base.withColumn("slug", F.when((n == 0) | (F.col("base") == ""), F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string")))).drop("base")


def enclosing_heading(line_table: DataFrame, heading_rows: DataFrame, key: str = "note_id") -> DataFrame:
    """line_table with anchor: the slug of the nearest heading at or above the line."""
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return line_table.join(heading_rows.select(key, "line", "slug"), [key, "line"], "left").withColumn("anchor", F.last("slug", ignorenulls=True).over(w)).drop("slug")


def body_links(notes: DataFrame, key: str = "note_id", body: str = "body", strip_anchor: bool = True) -> DataFrame:
    """key, target: link keys in a body, wikilinks and markdown links; images are none; repeats are kept."""
    wiki = F.transform(F.regexp_extract_all(body, F.lit(X.WIKILINK), 1), X.wikilink_key)
    md = F.filter(F.transform(F.regexp_extract_all(body, F.lit(X.MDLINK), 1), lambda t: X.mdlink_key(t, strip_anchor)), lambda t: t.isNotNull())
    return notes.select(key, F.explode(F.concat(wiki, md)).alias("target")).where("target <> ''")


def links(notes: DataFrame, last: bool = True) -> DataFrame:
    """src, dst: resolved links between notes by basename, each once, links to itself included (as the ranking counts them).

    Of notes that share a basename the one with the last path answers, or the first.
    """
    found = notes.select(F.col("note_id").alias("src"), F.explode(F.array_distinct("outlinks")).alias("link")).select("src", X.wikilink_key(F.col("link")).alias("target"))
    at = F.struct("path", "note_id")
    names = notes.groupBy("basename").agg((F.max(at) if last else F.min(at)).alias("m")).select(F.col("basename").alias("target"), F.col("m.note_id").alias("dst"))
    return found.join(names, "target").select("src", "dst").distinct()


def edges(notes: DataFrame) -> DataFrame:
    """src, dst of the graph that is shown: without links to itself; of notes that share a basename the first path answers."""
    return links(notes, last=False).where("src <> dst")


def link_labels(notes: DataFrame) -> DataFrame:
    """src, target, words: tokens of what a link shows, after |, if it shows anything."""
    shown = notes.select(F.col("note_id").alias("src"), F.explode("outlinks").alias("link")).where(F.col("link").contains("|"))
    return shown.select("src", X.wikilink_key(F.col("link")).alias("target"), X.tokens(F.regexp_replace("link", r"(?s)^[^|]*\|", "")).alias("words"))


def broken_links(notes: DataFrame) -> DataFrame:
    """note_id, target of links whose key is neither a basename nor an alias."""
    found = notes.select("note_id", F.explode("outlinks").alias("link")).select("note_id", X.wikilink_key(F.col("link")).alias("target")).where("target <> ''").distinct()
    aliases = notes.select(F.explode(F.from_json(F.get_json_object("frontmatter", "$.aliases"), "array<string>")))
    return found.join(notes.select(F.col("basename").alias("target")).union(aliases).distinct(), "target", "left_anti").select("note_id", "target")


def duplicate_basenames(notes: DataFrame) -> DataFrame:
    """basename, n, first_path of names that several paths share."""
    return notes.groupBy("basename").agg(F.countDistinct("path").alias("n"), F.min("path").alias("first_path")).where("n > 1")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change (added, removed, changed) between two snapshots."""
    a, b = before.select(key, F.col(digest).alias("__a")), after.select(key, F.col(digest).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, key, "full").withColumn("change", change).where("change is not null").select(key, "change")
