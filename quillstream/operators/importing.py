"""Notes of other vaults made fit for this one: paths, tags, links, children, sources, and a summary of what was done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.lint import CHILD, child_bullets
from quillstream.operators.parsing import front_links

# Folders and file names of a vault that hold no notes.
SKIP_FOLDERS = ("_templates", "_meta", "_kb")
SKIP_NAMES = ("AGENTS", "CLAUDE", "GEMINI", "QWEN", "README", "SCHEMA", "log")
_BODY_LINK = r"(?<!!)\[\[([^\[\]\r\n]+)\]\]"


def is_note_path(path: Column) -> Column:
    """Whether a path of a vault is a note: markdown, in no hidden or reserved folder, of no reserved name."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    stem = F.regexp_extract(path, r"([^/]+)\.md$", 1)
    return (stem != "") & ~F.exists(folders, lambda f: f.startswith(".") | f.isin(*SKIP_FOLDERS)) & ~stem.startswith(".") & ~stem.isin(*SKIP_NAMES)


def kept_tags(notes: DataFrame, allowed: DataFrame) -> DataFrame:
    """note_id, tags (of the taxonomy, in their order), stripped (the others)."""
    tags = notes.select("note_id", F.posexplode("tags").alias("pos", "tag"))
    known = allowed.select("tag").distinct().withColumn("known", F.lit(True))
    marked = tags.join(known, "tag", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "tag")))), lambda s: s.tag)
    return marked.groupBy("note_id").agg(ordered(F.col("known")).alias("tags"), ordered(~F.col("known")).alias("stripped"))


def relative(path: Column, folder: Column) -> Column:
    """A path as seen from a folder, both from one root."""
    to, at = F.filter(F.split(path, "/"), lambda p: p != ""), F.filter(F.split(folder, "/"), lambda p: p != "")
    same = F.aggregate(F.sequence(F.lit(0), F.size(at)), F.lit(0), lambda n, i: F.when((i == n) & (i < F.size(at)) & (i < F.size(to) - 1) & (F.get(to, i) == F.get(at, i)), n + 1).otherwise(n))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(at) - same), F.slice(to, same + 1, F.size(to))), "/")


def import_links(notes: DataFrame) -> DataFrame:
    """note_id, body, converted, unresolved: [[name|shown]] of bodies as markdown links to the note of that name, seen from
    the linking note's folder; of notes (note_id, path, basename, body) of one name the last path answers. A link to no
    note stays as it is and is reported. Links inside one body are replaced one by one, by place.
    """
    names = notes.groupBy("basename").agg(F.max("path").alias("to"))
    cut = notes.where("body is not null").select("note_id", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"), F.split("body", _BODY_LINK).alias("gaps"), F.regexp_extract_all("body", F.lit(_BODY_LINK), 1).alias("links"))
    links = cut.select("note_id", "folder", F.posexplode("links").alias("pos", "inner")).withColumn("basename", X.trim(F.regexp_replace("inner", r"\|.*$", "")))
    shown = F.when(F.col("inner").contains("|"), X.trim(F.regexp_replace("inner", r"^[^|]*\|", ""))).otherwise(F.col("basename"))
    found = links.join(names, "basename", "left").withColumn("made", F.when(F.col("to").isNull(), F.concat(F.lit("[["), "inner", F.lit("]]"))).otherwise(F.concat(F.lit("["), shown, F.lit("]("), relative(F.col("to"), F.col("folder")), F.lit(")"))))
    per = found.groupBy("note_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "made"))), lambda s: s.made).alias("made"), F.count_if(F.col("to").isNotNull()).alias("converted"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("to").isNull() & (F.col("basename") != ""), F.struct("pos", "basename")))), lambda s: s.basename).alias("unresolved"),
    )
    none = F.array().cast("array<string>")
    joined = cut.join(per, "note_id", "left").withColumn("made", F.coalesce("made", none))
    body = F.array_join(F.zip_with("gaps", F.concat("made", F.array(F.lit(""))), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return joined.select("note_id", body.alias("body"), F.coalesce("converted", F.lit(0)).alias("converted"), F.coalesce("unresolved", none).alias("unresolved"))


def kept_links(notes: DataFrame, key: str) -> DataFrame:
    """note_id, kept, unresolved: a frontmatter link list (related or children) with what names a note, as [[name]], and the rest."""
    links = notes.select("note_id", F.posexplode(F.array_distinct(front_links("frontmatter", key))).alias("pos", "name")).where("name <> ''")
    known = notes.select(F.col("basename").alias("name")).distinct().withColumn("known", F.lit(True))
    marked = links.join(known, "name", "left")
    ordered = lambda test, what: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("pos", "name")))), what)
    return marked.groupBy("note_id").agg(ordered(F.col("known").isNotNull(), lambda s: F.concat(F.lit("[["), s["name"], F.lit("]]"))).alias("kept"), ordered(F.col("known").isNull(), lambda s: s["name"]).alias("unresolved"))


def synced_children(pages: DataFrame, names: DataFrame) -> DataFrame:
    """note_id, body, children, dropped of entry pages (note_id, body): list items that name no note (names: basename) go,
    children are those that are left, sorted."""
    found = pages.select("note_id", F.explode(child_bullets(F.col("body"))).alias("basename"))
    dead = found.join(names.select("basename").distinct(), "basename", "left_anti").groupBy("note_id").agg(F.array_sort(F.collect_set("basename")).alias("dropped"))
    rows = pages.join(dead, "note_id", "left").withColumn("dropped", F.coalesce("dropped", F.array().cast("array<string>")))
    child = lambda x: X.mdlink_key(F.regexp_extract(x, CHILD, 1), False)
    body = F.array_join(F.filter(F.split("body", "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("dropped"), child(x)), F.lit(False))), "\n")
    return rows.select("note_id", body.alias("body"), F.array_sort(F.array_except(child_bullets(F.col("body")), F.col("dropped"))).alias("children"), "dropped")


def raw_reference(source: Column) -> Column:
    """Whether a source names a file below raw/ without leaving it: plain parts, none of them . or .., no sidecar."""
    return source.rlike(r"\Araw/(?:(?!\.{1,2}(?:/|\z))[A-Za-z0-9._@+-]+/)*(?!\.{1,2}\z)[A-Za-z0-9._@+-]+\z") & ~source.endswith(".meta.yaml")


def grounded(themes: DataFrame, raw: DataFrame) -> DataFrame:
    """note_id, sources, how of themes (note_id, basename, body, sources): the raw files they cite that exist; else a snapshot
    of the body (snapshot), or nothing for an empty one (stub)."""
    cited = themes.select("note_id", F.posexplode("sources").alias("pos", "path")).where(raw_reference(F.col("path"))).join(raw.select("path").distinct(), "path", "left_semi")
    per = cited.groupBy("note_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "path"))), lambda s: s.path).alias("cited"))
    has_body = X.trim(F.coalesce("body", F.lit(""))) != ""
    own = F.concat(F.lit("raw/import/"), "basename", F.lit(".md"))
    rows = themes.join(per, "note_id", "left")
    how = F.when(F.col("cited").isNotNull(), "cited").when(has_body, "snapshot").otherwise("stub")
    return rows.select("note_id", F.when(F.col("cited").isNotNull(), F.array_distinct("cited")).when(has_body, F.array(own)).otherwise(F.array().cast("array<string>")).alias("sources"), how.alias("how"))


def raw_snapshots(themes: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """path, text, sha256 of the bodies that grounding made sources, without those held already (path): raw files are written once."""
    made = found.where("how = 'snapshot'").select("note_id", F.get("sources", F.lit(0)).alias("path"))
    return themes.join(made, "note_id").select("path", F.col("body").alias("text"), F.sha2("body", 256).alias("sha256")).join(held.select("path").distinct(), "path", "left_anti")


def summary(links: DataFrame, tags: DataFrame, grounding: DataFrame) -> DataFrame:
    """One row of counts: notes, converted and unresolved links, stripped tags, and sources by how they were found."""
    a = links.agg(F.count(F.lit(1)).alias("notes"), F.coalesce(F.sum("converted"), F.lit(0)).alias("converted"), F.coalesce(F.sum(F.size("unresolved")), F.lit(0)).alias("unresolved"))
    b = tags.agg(F.coalesce(F.sum(F.size("stripped")), F.lit(0)).alias("stripped_tags"))
    c = grounding.agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("cited", "snapshot", "stub")))
    return a.join(F.broadcast(b), how="inner").join(F.broadcast(c), how="inner")  # one row each
