"""Integrity rules: each a query of its violations (code, severity, path, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.regions import PLACEHOLDERS, regions

# Closed vocabularies, the callout of a contested note, and the list item that names a child.
STATUSES = ("active", "stub", "contested", "deprecated")
TYPES = ("theme", "daily", "moc", "index")
CONFIDENCE = ("high", "medium", "low")
ORIGINS = ("claude-code", "codex", "qwen", "gemini", "opencode", "hermes", "manual")
CALLOUT = r"(?m)^> \[!contested\]"
CHILD = r"^- \[[^\]\r\n]*\]\(([^)\r\n]+)\)(?:\s.*)?$"
SIDECAR = ".meta.yaml"
DATE = r"\A\d{4}-\d{2}-\d{2}\z"

_STRINGS = r'^\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]$'


def _said(key: str) -> Column:
    return F.get_json_object("frontmatter", f"$.{key}")


def _front(key: str) -> Column:
    return F.from_json(_said(key), "array<string>")


def _rows(df: DataFrame, code: str, message: Column, severity: str = "error") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "path", message.alias("message"))


def unique_names(notes: DataFrame) -> DataFrame:
    """L1-1: a basename that several paths share, one finding per path."""
    shared = notes.groupBy("basename").agg(F.countDistinct("path").alias("n")).where("n > 1").select("basename")
    return _rows(notes.join(shared, "basename", "left_semi").select("path", "basename").distinct(), "L1-1", F.concat(F.lit("duplicate basename "), "basename"))


def link_names(notes: DataFrame) -> DataFrame:
    """target: everything a link may mean, basenames and aliases."""
    return notes.select(F.col("basename").alias("target")).union(notes.select(F.explode(_front("aliases")))).distinct()


def unresolved_links(notes: DataFrame) -> DataFrame:
    """L1-2: a link whose key is neither a basename nor an alias."""
    links = notes.select("path", F.explode("outlinks").alias("link")).select("path", X.wikilink_key(F.col("link")).alias("target")).where("target <> ''").distinct()
    return _rows(links.join(link_names(notes), "target", "left_anti"), "L1-2", F.concat(F.lit("unresolved link "), "target"))


def required_keys(notes: DataFrame) -> DataFrame:
    """L1-4: a key that is missing or of the wrong kind: title, summary, status, created and updated for all; date and
    run_id of a daily note; children of a moc or an index; lists that are none; a confidence outside its vocabulary."""
    kind = F.coalesce(F.col("type"), F.lit(""))
    missing = {
        "title": F.col("title").isNull() | (X.trim(F.col("title")) == ""),
        "status": F.col("status").isNull() | (F.col("status") == ""),
        **{k: _said(k).isNull() for k in ("summary", "created", "updated")},
        **{k: (kind == "daily") & _said(k).isNull() for k in ("date", "run_id")},
        "children": kind.isin("moc", "index") & _said("children").isNull(),
    }
    lists = {k: F.lit(True) for k in ("tags", "aliases")} | {k: kind == "theme" for k in ("sources", "related")} | {"children": kind.isin("moc", "index")}
    wrong = {k: of & _said(k).isNotNull() & ~_said(k).rlike(_STRINGS) for k, of in lists.items()}
    wrong["confidence"] = (kind == "theme") & _said("confidence").isNotNull() & ~_said("confidence").isin(*CONFIDENCE)
    said = F.array(*(F.when(t, F.lit(f"missing {k}")) for k, t in missing.items()), *(F.when(t, F.lit(f"bad {k}")) for k, t in wrong.items()))
    return _rows(notes.select("path", F.explode(F.array_compact(said)).alias("m")), "L1-4", F.col("m"))


def taxonomy(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """L1-5: a tag outside the allowed ones (tag)."""
    used = notes.select("path", F.explode("tags").alias("tag")).distinct()
    return _rows(used.join(tags.select("tag").distinct(), "tag", "left_anti"), "L1-5", F.concat(F.lit("unknown tag "), "tag"))


def vocabularies(notes: DataFrame) -> DataFrame:
    """L1-11: a status outside its vocabulary, a type outside it or missing."""
    status = notes.where(F.col("status").isNotNull() & (F.col("status") != "") & ~F.col("status").isin(*STATUSES))
    kind = notes.where(F.col("type").isNull() | ~F.col("type").isin(*TYPES))
    return _rows(status, "L1-11", F.concat(F.lit("status "), "status")).unionByName(_rows(kind, "L1-11", F.concat(F.lit("type "), F.coalesce("type", F.lit("missing")))))


def dates(notes: DataFrame, run_date: str | None = None) -> DataFrame:
    """L1-12: created, updated and a daily note's date of another form than yyyy-MM-dd, or, given the run's date, after it."""
    keys = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.lit(True) if k != "date" else F.col("type") == "daily", _said(k)).alias("said")) for k in ("created", "updated", "date")))
    said = notes.select("path", F.explode(keys).alias("x")).select("path", "x.k", "x.said").where("said is not null")
    wrong = _rows(said.where(~F.col("said").rlike(DATE)), "L1-12", F.concat(F.lit("bad "), "k", F.lit(" "), "said"))
    return wrong if run_date is None else wrong.unionByName(_rows(said.where(F.col("said").rlike(DATE) & (F.col("said") > run_date)), "L1-12", F.concat(F.lit("future "), "k", F.lit(" "), "said")))


def single_index(notes: DataFrame) -> DataFrame:
    """L1-13: an index page besides the first."""
    first = notes.where("is_index").agg(F.min("path").alias("first"))
    return _rows(notes.where("is_index").join(F.broadcast(first), how="inner").where("path <> first"), "L1-13", F.lit("second index"))


def daily_dates(notes: DataFrame, run_date: str | None = None, run_id: str | None = None) -> DataFrame:
    """L1-14: a daily note whose name ends in no date, whose date differs from its name or the run's, or of another run."""
    named, date, run = F.nullif(F.regexp_extract("basename", r"-(\d{4}-\d{2}-\d{2})$", 1), F.lit("")), _said("date"), _said("run_id")
    found = [F.when(named.isNull(), "no date in the name").when(date != named, "date is not that of the name")]
    if run_date is not None:
        found.append(F.when(date != run_date, "date is not that of the run"))
        found.append(F.when((run != run_id) if run_id is not None else (F.substring(run, 1, 10) != run_date), "run_id is not that of the run"))
    problems = F.array_compact(F.array(*found))
    return _rows(notes.where((F.col("type") == "daily") & (F.size(problems) > 0)), "L1-14", F.concat(F.lit("daily: "), F.array_join(problems, "; ")))


def child_bullets(body: Column) -> Column:
    """Basenames that the unindented list items of a body name by one markdown link, each once."""
    found = F.filter(F.transform(F.split(body, X.LINE_BREAKS), lambda x: F.regexp_extract(x, CHILD, 1)), lambda t: t != "")
    return F.array_distinct(F.filter(F.transform(found, lambda t: X.mdlink_key(t, False)), lambda t: t.isNotNull() & (t != "")))


def children_shown(notes: DataFrame) -> DataFrame:
    """L1-6: a moc or index whose children are not those of its list items."""
    declared = F.array_distinct(F.flatten(F.transform(F.coalesce(_front("children"), F.array().cast("array<string>")), lambda c: F.transform(F.regexp_extract_all(c, F.lit(X.WIKILINK), 1), X.wikilink_key))))
    pages = notes.where(F.col("type").isin("moc", "index")).withColumns({"__d": F.array_sort(declared), "__b": F.array_sort(child_bullets(F.coalesce("body", F.lit(""))))})
    return _rows(pages.where("__d <> __b"), "L1-6", F.concat(F.lit("children "), F.array_join("__d", ","), F.lit(" shown "), F.array_join("__b", ",")))


def line_ends(notes: DataFrame) -> DataFrame:
    """L1-16: a body with carriage returns or a byte-order mark."""
    return _rows(notes.where(F.col("body").contains("\r") | F.col("body").startswith("﻿")), "L1-16", F.lit("not plain line feeds"))


def marker_order(notes: DataFrame, prefix: str = "kb") -> DataFrame:
    """L1-20: region markers that do not strictly alternate start and end with equal, unique ids."""
    marks = F.regexp_extract_all("body", F.lit(rf"<!-- {prefix}:body:((?:start|end) \S+) -->"), 1)
    starts = F.filter(marks, lambda m: m.startswith("start "))
    pairs = F.flatten(F.transform(starts, lambda m: F.array(m, F.regexp_replace(m, "^start ", "end "))))
    return _rows(notes.where((F.size(marks) > 0) & ((pairs != marks) | (F.size(F.array_distinct(starts)) != F.size(starts)))), "L1-20", F.lit("region markers out of order"))


def bare_themes(notes: DataFrame) -> DataFrame:
    """L1-7: a theme that is no stub and has no sources."""
    return _rows(notes.where((F.col("type") == "theme") & (F.coalesce("status", F.lit("")) != "stub") & (F.coalesce(F.size(_front("sources")), F.lit(0)) <= 0)), "L1-7", F.lit("no sources"))


def sources(notes: DataFrame, raw: DataFrame) -> DataFrame:
    """L1-8: a theme's source that no raw file (path) answers; L1-8b: a cited sidecar."""
    cited = notes.where("type = 'theme'").select("path", F.explode(_front("sources")).alias("source")).distinct()
    side = F.col("source").endswith(SIDECAR)
    gone = cited.where(~side).join(raw.select(F.col("path").alias("source")).distinct(), "source", "left_anti")
    return _rows(gone, "L1-8", F.concat(F.lit("missing source "), "source")).unionByName(_rows(cited.where(side), "L1-8b", F.concat(F.lit("sidecar "), "source")))


def contested_shape(notes: DataFrame, run_date: str | None = None) -> DataFrame:
    """L1-10: a contested theme lacks two sources, who contests it, when (at the run's date, if given), or the callout."""
    at = _said("contested_at")
    when = (at == run_date) if run_date is not None else at.rlike(DATE)
    whole = (F.coalesce(F.size(_front("sources")), F.lit(0)) >= 2) & (F.coalesce(F.size(_front("contested_by")), F.lit(0)) >= 1) & when & F.col("body").rlike(CALLOUT)
    return _rows(notes.where((F.col("type") == "theme") & (F.col("status") == "contested") & ~F.coalesce(whole, F.lit(False))), "L1-10", F.lit("contested without its marks"))


def alias_collisions(notes: DataFrame) -> DataFrame:
    """L1-15: an alias that is a basename, or that an earlier note (by path) or place in the list holds already."""
    rows = notes.select("path", F.posexplode(_front("aliases")).alias("at", "alias"))
    taken = rows.join(notes.select(F.col("basename").alias("alias")).distinct(), "alias", "left_semi").select("path", "at", "alias")
    first = rows.groupBy("alias").agg(F.min(F.struct("path", "at")).alias("f"))
    later = rows.join(first, "alias").where((F.col("path") != F.col("f.path")) | (F.col("at") != F.col("f.at"))).select("path", "at", "alias")
    return _rows(taken.union(later).distinct(), "L1-15", F.concat(F.lit("alias "), "alias"))


def schema_drift(notes: DataFrame, version: str) -> DataFrame:
    """L1-17: a schema_version other than the repository's."""
    said = F.get_json_object("frontmatter", "$.schema_version")
    return _rows(notes.where(said.isNotNull() & (said != version)), "L1-17", F.concat(F.lit("schema_version "), said))


def origin_ok(said: Column) -> Column:
    """Whether an origin is of the vocabulary, or web: or harvest: with a name."""
    return said.isin(*ORIGINS) | said.rlike(r"(?s)\A(web|harvest):.+\z")


def origins(notes: DataFrame) -> DataFrame:
    """L1-19: a theme's origin outside the vocabulary."""
    return _rows(notes.where((F.col("type") == "theme") & _said("origin").isNotNull() & ~origin_ok(_said("origin"))), "L1-19", F.concat(F.lit("origin "), _said("origin")))


def stale_status(notes: DataFrame, prefix: str = "kb") -> DataFrame:
    """L2-6: a warning when body_status says pending though every region has been written."""
    written = regions(notes, prefix=prefix).groupBy("path").agg(F.count_if(F.col("text").isin(*PLACEHOLDERS)).alias("n")).where("n = 0")
    pending = notes.where(F.get_json_object("frontmatter", "$.body_status") == "pending")
    return _rows(pending.join(written, "path", "left_semi"), "L2-6", F.lit("body_status is out of date"), "warning")


def orphan_count(notes: DataFrame, orphans: DataFrame, most: int) -> DataFrame:
    """L2-1: a warning when more themes than allowed have no link to them."""
    n = orphans.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return n.select(F.lit("L2-1").alias("code"), F.lit("warning").alias("severity"), F.lit("").alias("path"), F.concat(F.col("n").cast("string"), F.lit(" orphans")).alias("message"))


def lint(notes: DataFrame, tags: DataFrame | None = None, run_date: str | None = None, raw: DataFrame | None = None, version: str | None = None, run_id: str | None = None, domains: DataFrame | None = None, max_orphans: int | None = None) -> DataFrame:
    """Findings of the rules over a corpus view; order by path and code where order matters.

    Rules that need more run when it is given: tags and domains (L1-5), raw files (L1-8), the schema version (L1-17), the
    number of orphans allowed (L2-1).
    """
    rules = [
        unique_names(notes), unresolved_links(notes), required_keys(notes), children_shown(notes), bare_themes(notes), contested_shape(notes, run_date), vocabularies(notes), dates(notes, run_date), single_index(notes),
        daily_dates(notes, run_date, run_id), line_ends(notes), marker_order(notes), alias_collisions(notes), origins(notes), stale_status(notes),
    ]
    if tags is not None:
        rules.append(taxonomy(notes, tags))
    if domains is not None:
        found = notes.select("path", X.path_domain(F.col("path")).alias("domain")).where("domain is not null")
        rules.append(_rows(found.join(domains.select("domain").distinct(), "domain", "left_anti"), "L1-5", F.concat(F.lit("unknown domain "), "domain")))
    if raw is not None:
        rules.append(sources(notes, raw))
    if version is not None:
        rules.append(schema_drift(notes, version))
    if max_orphans is not None:
        rules.append(orphan_count(notes, orphan_themes(notes), max_orphans))
    return reduce(DataFrame.unionByName, rules)


def orphan_themes(notes: DataFrame) -> DataFrame:
    """basename of themes that no note, themselves included, refers to."""
    referred = notes.select(F.explode("outlinks").alias("link")).select(X.wikilink_key(F.col("link")).alias("basename")).distinct()
    return notes.where("type = 'theme'").select("basename").distinct().join(referred, "basename", "left_anti")


def health(notes: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """One row: totals by type and status, tags with their counts, contested notes, orphans, unresolved links, findings.

    findings: those of lint, or the rules that need nothing else; lint_ok tells that none is an error.
    """
    lone = orphan_themes(notes).agg(F.count(F.lit(1)).alias("orphans"))
    broken = unresolved_links(notes).agg(F.count(F.lit(1)).alias("broken_links"))
    found = (findings if findings is not None else lint(notes)).agg(F.count(F.lit(1)).alias("lint_findings"), (F.count_if(F.col("severity") == "error") == 0).alias("lint_ok"))
    tags = notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "n")))).alias("tag_distribution"))
    totals = notes.agg(
        F.count(F.lit(1)).alias("note_total"), F.count_if(F.col("type") == "theme").alias("themes"), F.count_if(F.col("type") == "daily").alias("dailies"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES),
    )
    for one in (lone, broken, found, tags):
        totals = totals.join(F.broadcast(one), how="inner")  # one row each
    return totals
