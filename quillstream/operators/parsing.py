"""Notes from raw markdown: frontmatter, title, headings, tags and links, one pass over each note's lines without a shuffle."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.functions import text as X

#: Opening and closing line of frontmatter, each three hyphens and blanks.
FRONT = r"(?s)\A[ \t]*---[ \t\r]*\n(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\n|\z)"
INLINE_LINKS = r"(?m)^(\s*)([A-Za-z_][\w-]*):[ \t]*(\[\[[^\]\n]*\]\](?:[ \t]*,[ \t]*\[\[[^\]\n]*\]\])*)[ \t]*$"


def _plain(x: object) -> object:
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    return str(x)


def mapping_json(block: str | None) -> str | None:
    """A YAML mapping as JSON, dates as text; null for what is no mapping or no YAML; blank is the empty mapping."""
    if block is None:
        return None
    try:
        found = yaml.safe_load(block) if block.strip() else {}
        return json.dumps(found, ensure_ascii=False, sort_keys=True, default=_plain) if isinstance(found, dict) else None
    except (yaml.YAMLError, TypeError, ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _json(blocks: pd.Series) -> pd.Series:
    return blocks.map(mapping_json, na_action="ignore")


def split_frontmatter(df: DataFrame, text: str = "text") -> DataFrame:
    """df with frontmatter (JSON, null if there is none that can be read) and body (the whole text then).

    Only texts that open with a fence leave the JVM. A body has no line feeds at its ends.
    """
    block = F.when(F.col(text).rlike(FRONT), F.regexp_extract(text, FRONT, 1))
    open_ = df.withColumn("__b", block)
    fenced = open_.where("__b is not null").withColumn("frontmatter", _json("__b"))
    rows = fenced.unionByName(open_.where("__b is null").withColumn("frontmatter", F.lit(None).cast("string")))
    body = F.when(F.col("frontmatter").isNotNull(), F.regexp_replace(F.regexp_replace(text, FRONT, ""), r"\A\n+|\n+\z", "")).otherwise(F.col(text))
    return rows.withColumn("body", body).drop("__b")


def repaired(block: Column) -> Column:
    """A frontmatter block whose bare lists of wikilinks (key: [[a]], [[b]]) are lists of strings."""
    quoted = F.regexp_replace(block, INLINE_LINKS, "$1$2: [$3]")
    return F.when(block.rlike(INLINE_LINKS), F.regexp_replace(quoted, r"(\[\[[^\[\]\n]*\]\])(?=[ \t]*(?:,|\]))", "'$1'")).otherwise(block)


def split_foreign(df: DataFrame, text: str = "text") -> DataFrame:
    """split_frontmatter of notes of other vaults: with bare wikilink lists repaired (repaired), and an unreadable block dropped."""
    block = F.when(F.col(text).rlike(FRONT), F.regexp_extract(text, FRONT, 1))
    own = df.withColumn("__b", block).withColumn("__j", _json("__b")).withColumn("__r", F.when(F.col("__j").isNull() & F.col("__b").rlike(INLINE_LINKS), _json(repaired(F.col("__b")))))
    body = F.regexp_replace(F.when(F.col("__b").isNotNull(), F.regexp_replace(text, FRONT, "")).otherwise(F.col(text)), r"\A\n+|\n+\z", "")
    return own.select(*df.columns, F.coalesce("__j", "__r", F.lit("{}")).alias("frontmatter"), body.alias("body"), F.col("__r").isNotNull().alias("repaired"))


def scanned(body: Column) -> Column:
    """title, title_line and headings (levels 2 to 6, slugs numbered) of a body: what stands in or on a fence is none."""
    head = "array<struct<level:int,text:string,slug:string,line:int>>"
    start = F.struct(F.lit(False).alias("fenced"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("int").alias("title_line"), F.array().cast(head).alias("headings"))

    def step(a: Column, x: Column) -> Column:
        delimiter, level = x.text.rlike(X.FENCE), F.length(F.regexp_extract(x.text, X.HEADING, 1))
        said = X.trim(F.regexp_extract(x.text, X.HEADING, 2))
        is_head = ~delimiter & ~a.fenced & x.text.rlike(X.HEADING)
        base = X.slug(said)
        n = F.size(F.filter(a.headings, lambda h: X.slug(h.text) == base))
        slug = F.when((base == "") | (n == 0), base).otherwise(F.concat_ws("-", base, n.cast("string")))
        made = F.struct(level.alias("level"), said.alias("text"), slug.alias("slug"), x.line.alias("line"))
        first = is_head & (level == 1) & a.title_line.isNull()
        return F.struct(
            (a.fenced != delimiter).alias("fenced"),
            F.when(first, said).otherwise(a.title).alias("title"),
            F.when(first, x.line).otherwise(a.title_line).alias("title_line"),
            F.when(is_head & (level > 1), F.concat(a.headings, F.array(made))).otherwise(a.headings).cast(head).alias("headings"),
        )

    lines = F.transform(F.split(body, "\n"), lambda t, i: F.struct(t.alias("text"), (i + 1).cast("int").alias("line")))
    return F.aggregate(lines, start, step, lambda a: F.struct(a.title.alias("title"), a.title_line.alias("title_line"), a.headings.alias("headings")))


def front_links(frontmatter: str, key: str) -> Column:
    """Keys of the wikilinks in a list of the frontmatter; none if it is no list."""
    items = F.coalesce(F.from_json(F.get_json_object(frontmatter, f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
    return F.flatten(F.transform(items, lambda c: F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(X.WIKILINK), 1), X.wikilink_key)))


def text_links(body: Column) -> Column:
    """Keys of a body's links in order, of each line markdown links before wikilinks; a fence's own line has none."""
    lines = F.filter(F.split(body, "\n"), lambda x: ~x.rlike(X.FENCE))
    md = lambda x: F.filter(F.transform(F.regexp_extract_all(x, F.lit(X.MDLINK), 1), lambda t: X.mdlink_key(t)), lambda t: t.isNotNull())
    return F.flatten(F.transform(lines, lambda x: F.concat(md(x), F.transform(F.regexp_extract_all(x, F.lit(X.WIKILINK), 1), X.wikilink_key))))


def _strings(frontmatter: str, key: str) -> Column:
    """A list, or a text as a list of one; none otherwise."""
    said = F.get_json_object(frontmatter, f"$.{key}")
    return F.when(said.startswith("["), F.from_json(said, "array<string>")).when(said.isNotNull(), F.array(said)).otherwise(F.array().cast("array<string>"))


def parse_notes(df: DataFrame) -> DataFrame:
    """path, basename, is_moc, is_index, title, title_line, headings, tags, aliases, summary, status, outlinks, body_lines,
    frontmatter, body of notes (path, text).

    The title is the first heading of level 1, else that of the frontmatter, else the name. Links are those of the body
    and the frontmatter's related and children, each once; those inside code fences count. Texts that are null have no row.
    """
    own = split_frontmatter(df.where("text is not null").select("path", "text")).withColumn("s", scanned(F.col("body")))
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", "")
    links = F.concat(text_links(F.col("body")), front_links("frontmatter", "related"), front_links("frontmatter", "children"))
    said = lambda k: F.get_json_object("frontmatter", f"$.{k}")
    return own.select(
        "path", name.alias("basename"), X.is_moc_path(F.col("path")).alias("is_moc"), (F.col("path") == "index.md").alias("is_index"),
        F.coalesce("s.title", said("title"), F.replace(name, F.lit("-"), F.lit(" "))).alias("title"), F.coalesce("s.title_line", F.lit(1)).alias("title_line"), F.col("s.headings").alias("headings"),
        _strings("frontmatter", "tags").alias("tags"), _strings("frontmatter", "aliases").alias("aliases"), F.coalesce(said("summary"), F.lit("")).alias("summary"),
        F.coalesce(F.lower(X.trim(said("status"))), F.lit("neutral")).alias("status"), F.filter(F.array_distinct(links), lambda t: t != "").alias("outlinks"), F.split("body", "\n").alias("body_lines"), "frontmatter", "body",
    )


def parse_changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Notes of files (path, text) parsed, from the cache (path, source_digest and the parsed columns) where the digest is the same."""
    own = files.withColumn("source_digest", F.sha2("text", 256))
    held = own.select("path", "source_digest").join(cached, ["path", "source_digest"])
    missing = own.join(cached.select("path", "source_digest"), ["path", "source_digest"], "left_anti")
    fresh = parse_notes(missing).join(missing.select("path", "source_digest"), "path")
    return held.unionByName(fresh.select(*held.columns))
