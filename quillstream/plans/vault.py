"""Queries of parsing, importing, harvesting, curation and regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.desk import Desk
from quillstream.functions import text as X
from quillstream.operators import curation, follow, importing, inbox, lint, parsing, plans, regions
from quillstream.plans.log import events
from quillstream.plans.notes import _N, corpus
from quillstream.session import table
from quillstream.sources import extract


def _raw(spark: SparkSession, d: str) -> DataFrame:
    """The notes as markdown files: JSON frontmatter is YAML too."""
    files = table(spark, d, "note_files").dropDuplicates(["note_id"]).where("body is not null")
    return files.select("note_id", F.concat(F.lit("f/"), F.col("note_id").cast("string"), F.lit("/"), "basename", F.lit(".md")).alias("path"), F.concat(F.coalesce(F.concat(F.lit("---\n"), "frontmatter", F.lit("\n---\n")), F.lit("")), "body").alias("text"))


def v_parsed(spark, d):
    got = parsing.parse_notes(_raw(spark, d))
    heads = F.transform("headings", lambda h: F.concat_ws(":", h.level.cast("string"), h.line.cast("string"), h.slug))
    return got.select("path", "basename", "title", "title_line", "status", F.array_join("tags", ",").alias("tags"), F.array_join(heads, ",").alias("headings"), F.array_join("outlinks", ",").alias("outlinks"), F.size("body_lines").alias("n_lines"))


def v_anchors(spark, d):
    t = table(spark, d, "parsed_notes").dropDuplicates(["note_id"]).where("title is not null")
    return t.select("note_id", X.heading_anchor(F.col("title")).alias("anchor"), X.slug_or_hash(F.col("title")).alias("name"))


def v_may_write(spark, d):
    return corpus(spark, d).groupBy(X.may_write(F.col("path")).alias("allowed"), importing.is_note_path(F.col("path")).alias("is_note")).agg(F.count(F.lit(1)).alias("n"))


def v_browse(spark, d):
    return Desk(spark, corpus(spark, d)).browse("reading").select("path", "basename", "title", "type", "status", "updated")


def v_graph_nodes(spark, d):
    return Desk(spark, corpus(spark, d)).graph("reading", 50)[0].select("node", "path", "orphan")


def v_import_tags(spark, d):
    own = corpus(spark, d)
    allowed = own.select(F.explode("tags").alias("tag")).where("tag like '%e%'").distinct()
    return importing.kept_tags(own, allowed).select("note_id", F.array_join("tags", ",").alias("tags"), F.array_join("stripped", ",").alias("stripped"))


def _foreign(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose bodies name their outlinks as wikilinks."""
    return corpus(spark, d).select("note_id", "path", "basename", F.concat_ws("\n", F.array_join(F.transform("outlinks", lambda o: F.concat(F.lit("see [["), o, F.lit("]]"))), "\n"), F.lit("end")).alias("body"))


def v_import_links(spark, d):
    got = importing.import_links(_foreign(spark, d))
    return got.select("note_id", "converted", F.array_join("unresolved", ",").alias("unresolved"), F.regexp_count("body", F.lit(r"see \[[^\[\]]*\]\([^()]*\.md\)")).alias("links"))


def v_import_sources(spark, d):
    own = corpus(spark, d).where("type = 'theme'").withColumn("sources", F.array(F.concat(F.lit("raw/"), "basename", F.lit(".md")), F.lit("raw/../x"), F.lit("http://a")))
    raw = own.where("note_id % 3 = 0").select(F.concat(F.lit("raw/"), "basename", F.lit(".md")).alias("path"))
    return importing.grounded(own, raw).groupBy("how").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sources")).alias("sources"))


def v_import_summary(spark, d):
    own = corpus(spark, d)
    allowed = own.select(F.explode("tags").alias("tag")).where("tag like '%e%'").distinct()
    themes = own.where("type = 'theme'").withColumn("sources", F.array(F.lit("raw/none.md")))
    return importing.summary(importing.import_links(_foreign(spark, d)), importing.kept_tags(own, allowed), importing.grounded(themes, themes.select(F.lit("raw/x").alias("path")).limit(1)))


def v_children(spark, d):
    """Entry pages of one list item per outlink, with the items that name no note taken out."""
    own = corpus(spark, d)
    pages = own.where("is_moc or is_index").select("note_id", F.array_join(F.transform("outlinks", lambda o: F.concat(F.lit("- [x](themes/"), X.wikilink_key(o), F.lit(".md) y"))), "\n").alias("body"))
    return importing.synced_children(pages, own.select("basename")).select("note_id", F.size("children").alias("kept"), F.size("dropped").alias("dropped"), F.size(lint.child_bullets(F.col("body"))).alias("shown"))


def _regioned(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "author_regions").dropDuplicates(["region_no"]).where("region_id is not null")
    text = F.when(F.col("region_no") % 5 == 0, F.lit("_pending_")).otherwise(F.coalesce(F.regexp_replace("source_text", r"\s+", " "), F.lit("")))
    body = F.concat(F.lit("# T\n"), regions.marker(F.col("region_id"), "start"), F.lit("\n"), text, F.lit("\n"), regions.marker(F.col("region_id"), "end"), F.lit("\ntail"))
    return r.select("region_no", F.col("region_no").cast("string").alias("path"), "region_id", body.alias("body"))


def v_regions(spark, d):
    return regions.regions(_regioned(spark, d)).select("path", "region_id", F.length("text").alias("n"))


def v_unauthored(spark, d):
    own = _regioned(spark, d)
    before = own.withColumn("body", regions.blanked(F.col("body"), filler="_pending_"))
    return regions.unauthored(before, own).select("path", "region_id", "why")


def v_outside(spark, d):
    own = _regioned(spark, d)
    after = own.withColumn("body", F.when(F.col("region_no") % 7 == 0, F.replace("body", F.lit("tail"), F.lit("other"))).otherwise(F.replace("body", F.lit("_pending_"), F.lit("written"))))
    return regions.outside_changed(own, after)


def v_author_diff(spark, d):
    base = corpus(spark, d).select("note_id", "path", F.coalesce("body", F.lit("")).alias("text"))
    after = base.where("note_id % 11 <> 0").withColumn("text", F.when(F.col("note_id") % 5 == 0, F.lit(" ")).when(F.col("note_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = base.where("note_id % 13 = 0").select("note_id", F.concat("path", F.lit(".new")).alias("path"), "text")
    one = lambda df: df.groupBy("path").agg(F.max("text").alias("text"))
    return plans.author_diff(one(base), one(after.unionByName(new)), base.where("note_id % 2 = 1").select("path"))


def _dispositions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "author_regions").select(F.concat(F.lit("c"), F.col("region_no").cast("string")).alias("candidate_id"), "region_no", "op", "title", "summary")


def v_harvest_deltas(spark, d):
    own = _dispositions(spark, d)
    prov = own.select("candidate_id", F.explode(F.array(F.concat(F.lit("harvest:a"), (F.col("region_no") % 5).cast("string")), F.lit("manual"))).alias("source"))
    return curation.harvest_deltas(own, prov, spark.range(4).select(F.concat(F.lit("file:a"), F.col("id").cast("string")).alias("connector")))


def v_roll_up(spark, d):
    return curation.roll_up(_dispositions(spark, d), 2)


def v_themes(spark, d):
    """The themes that a plan leaves: created, merged and contested ones."""
    r = table(spark, d, "author_regions").where("title is not null").withColumn("slug", X.slug(F.col("title")))
    plan = r.select(F.col("region_no").alias("pos"), "op", F.col("slug").alias("basename"), F.col("slug").alias("target_basename"), "title", F.lit(None).cast("string").alias("status"), F.array(F.element_at(F.split("slug", "-"), -1)).alias("tags"), F.concat(F.lit("e"), F.col("region_no").cast("string")).alias("source"))
    held = r.where("region_no % 3 = 0").groupBy(F.col("slug").alias("basename")).agg(F.min("title").alias("title")).select("basename", "title", F.lit("active").alias("status"), F.array(F.lit("old")).alias("tags"), F.array(F.lit("e-old")).alias("sources"), F.lit("2025-01-01").cast("date").alias("updated"))
    got = plans.apply_themes(held, plan.where("op <> 'CREATE_THEME' or pos % 3 <> 0"), "2026-07-01")
    return got.groupBy("status", "updated").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sources")).alias("n_sources"), F.sum(F.size("tags")).alias("n_tags"))


def v_dailies(spark, d):
    r = table(spark, d, "author_regions")
    plan = r.select("op", F.concat(F.lit("d"), (F.col("region_no") % 9).cast("string")).alias("domain"), F.array(F.lpad(F.col("region_no").cast("string"), 9, "0")).alias("event_ids"), F.concat(F.lit("c"), F.col("region_no").cast("string")).alias("candidate_id"), F.coalesce("summary", F.lit("")).alias("summary"))
    held = spark.range(3).select(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit("-2026-07-01")).alias("basename"), F.array(F.lit("first")).alias("sections"))
    got = plans.append_dailies(held, plan, "2026-07-01")
    return got.select("basename", F.size("sections").alias("n"), F.sha2(F.array_join("sections", "|"), 256).alias("sha"))


def v_streaks(spark, d):
    e = events(spark, d).select("writer", "id", (F.col("kind") == "capture").alias("ok"))
    return curation.failure_streaks(e, "writer", "id", "ok").groupBy("writer").agg(F.max("failures").alias("longest"))


def v_settled(spark, d):
    own = events(spark, d)
    records = own.select((F.col("event_id") % 40).cast("string").alias("record_id"), F.array("id").alias("event_ids"))
    return curation.settled_records(records, own.where("event_id % 40 < 25").select(F.col("id").alias("event_id")))


def v_ops(spark, d):
    said = _dispositions(spark, d).groupBy(F.substring("candidate_id", 2, 1).alias("k")).agg(F.array_join(F.array_sort(F.collect_set(F.concat("op", F.lit("=3")))), ", ").alias("said"))
    return said.select("k", F.explode(curation.parse_ops(F.concat("said", F.lit(", bad=x, plain")))).alias("op", "n"))


def v_follow(spark, d):
    """Memory files of list items that point to notes' bodies."""
    own = corpus(spark, d).where("is_moc or is_index").select("note_id", F.posexplode("outlinks").alias("block_no", "link")).where("link is not null")
    blocks = own.select(F.concat(F.lit("m/"), F.col("note_id").cast("string"), F.lit(".md")).alias("path"), "block_no", F.concat(F.lit("- [note]("), F.regexp_replace(X.wikilink_key(F.col("link")), r"\s", ""), F.lit(".md) - why it is here")).alias("block"))
    files = corpus(spark, d).where("body is not null").groupBy("basename").agg(F.min("body").alias("text")).select(F.concat(F.lit("m/"), "basename", F.lit(".md")).alias("path"), "text")
    facts, _ = follow.followed_facts(blocks, files, max_facts=100_000, max_followed=100_000)
    return facts.groupBy("path", "followed").agg(F.count(F.lit(1)).alias("n"))


def v_prose(spark, d):
    t = table(spark, d, "author_regions").where("source_text is not null")
    return t.select("region_no", X.at_boundary(F.col("source_text"), 80).alias("short"), X.prose(F.concat(F.lit("```x\n<!-- a\nb -->"), "source_text", F.lit(" [[k|s]]"))).alias("prose"))


def v_stray_links(spark, d):
    own = corpus(spark, d).select("note_id", F.concat(F.lit("a [[[["), "basename", F.lit("]]]] b [[keep|me]] c")).alias("text"))
    return own.select("note_id", X.without_stray_links(F.col("text"), F.array(F.lit("keep"))).alias("text"), X.as_routes(F.lit("go [[a#b|c]] or [[d]]")).alias("routed"))


def v_routes(spark, d):
    own = table(spark, d, "extracted_docs").dropDuplicates(["ext_id"])
    r = extract.routed(F.col("source_url"), F.col("mime"))
    return own.select(r.alias("r"), "mime").groupBy(F.col("r.route").alias("route"), F.col("r.conflict").alias("conflict"), "mime").agg(F.count(F.lit(1)).alias("n"))


def v_related(spark, d):
    """Notes related to the first regions of each operation."""
    first = table(spark, d, "author_regions").where("title is not null").groupBy("op").agg(F.min_by("title", "region_no").alias("text")).select(F.col("op").alias("candidate_id"), "text")
    return curation.related(corpus(spark, d), first).select("candidate_id", "pos", "note_id", "score")


def v_depth(spark, d):
    own = events(spark, d)
    runs = own.where("event_id % 50 = 0").select(F.col("id").alias("run_id"), F.col("ts").alias("at"), F.lit(2).alias("ingested"), F.lit(1).alias("merged"), F.lit(0).alias("dropped"), F.lit(0).alias("failed"))
    return curation.status(own.where("event_id % 3 = 0"), own.where("event_id % 3 = 1").select("id", F.col("ts").alias("at")), own.where("event_id % 3 = 2"), runs, "2024-01-02")


def v_valid(spark, d):
    own = events(spark, d).withColumn("source", F.concat(F.when(F.col("event_id") % 4 == 0, "web:").when(F.col("event_id") % 4 == 1, "team:").otherwise(""), "source"))
    return inbox.valid_events(own).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("v_")}

_RG = r"r AS (SELECT *, CASE WHEN region_no % 5 = 0 THEN '_pending_' ELSE trim(regexp_replace(coalesce(source_text, ''), '\s+', ' ', 'g')) END AS t FROM (SELECT DISTINCT ON (region_no) * FROM author_regions) WHERE region_id IS NOT NULL)"
_KEY = r"regexp_replace(regexp_replace({}, '[|#].*$', '', 's'), '^\s+|\s+$', '', 'g')"
_EV = "e AS (SELECT *, strftime(ts, '%Y-%m-%dT%H-%M-%S.') || lpad((extract('millisecond' FROM ts) % 1000)::INT::VARCHAR, 3, '0') || 'Z--' || lpad(lower(to_hex(event_id)), 6, '0') AS id, 'u' || user_id AS writer FROM events)"

SQL = {
    "v_parsed": r"""WITH b AS (SELECT DISTINCT ON (note_id) * FROM note_files WHERE body IS NOT NULL),
t AS (SELECT *, CASE WHEN frontmatter IS NULL THEN body ELSE regexp_replace(body, '^\n+|\n+$', '', 'g') END AS x FROM b),
ln AS (SELECT note_id, generate_subscripts(string_split(x, chr(10)), 1)::INT AS line, unnest(string_split(x, chr(10))) AS text FROM t),
fl AS (SELECT *, regexp_matches(text, '^[ \t]*(```+|~~~+)') AS delim FROM ln), fe AS (SELECT *, sum(delim::INT) OVER (PARTITION BY note_id ORDER BY line) % 2 = 1 AS fenced FROM fl),
hd AS (SELECT note_id, line, length(regexp_extract(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)) AS level, trim(regexp_extract(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2)) AS said FROM fe WHERE NOT fenced AND NOT delim AND regexp_matches(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$')),
h1 AS (SELECT note_id, min({'l': line, 't': said}) AS m FROM hd WHERE level = 1 GROUP BY 1),
hb AS (SELECT *, regexp_replace(regexp_replace(lower(said), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM hd WHERE level > 1), hn AS (SELECT *, row_number() OVER (PARTITION BY note_id, base ORDER BY line) - 1 AS k FROM hb),
hs AS (SELECT note_id, string_agg(level || ':' || line || ':' || CASE WHEN k = 0 OR base = '' THEN base ELSE base || '-' || k END, ',' ORDER BY line) AS headings FROM hn GROUP BY 1),
lk AS (SELECT note_id, line, generate_subscripts(a, 1) AS p, unnest(a) AS raw FROM (SELECT note_id, line, regexp_extract_all(text, '\[\[([^\]]+)\]\]', 1) AS a FROM fl WHERE NOT delim)),
lu AS (SELECT note_id, target, min({'l': line, 'p': p}) AS o FROM (SELECT *, """ + _KEY.format("raw") + r""" AS target FROM lk) WHERE target <> '' GROUP BY 1, 2), lo AS (SELECT note_id, string_agg(target, ',' ORDER BY o) AS outlinks FROM lu GROUP BY 1)
SELECT 'f/' || t.note_id || '/' || t.basename || '.md' AS path, t.basename, coalesce(h1.m.t, json_extract_string(t.frontmatter, '$.title'), replace(t.basename, '-', ' ')) AS title, coalesce(h1.m.l, 1) AS title_line, coalesce(lower(trim(json_extract_string(t.frontmatter, '$.status'))), 'neutral') AS status,
  coalesce(array_to_string(json_extract_string(t.frontmatter, '$.tags[*]'), ','), '') AS tags, coalesce(hs.headings, '') AS headings, coalesce(lo.outlinks, '') AS outlinks, len(string_split(t.x, chr(10)))::INT AS n_lines
FROM t LEFT JOIN h1 USING (note_id) LEFT JOIN hs USING (note_id) LEFT JOIN lo USING (note_id)""",
    "v_anchors": r"""WITH t AS (SELECT DISTINCT ON (note_id) * FROM parsed_notes WHERE title IS NOT NULL), s AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS g FROM t)
SELECT note_id, g AS anchor, CASE WHEN g <> '' THEN g ELSE 'note-' || substring(sha256(title), 1, 8) END AS name FROM s""",
    "v_may_write": rf"WITH {_N} SELECT coalesce(path IN ('index.md', 'log.md') OR starts_with(path, 'wiki/') OR starts_with(path, 'assets/'), false) AS allowed, ends_with(path, '.md') AND NOT regexp_matches(path, '(^|/)(_templates|_meta|_kb|\.[^/]*)/') AND NOT regexp_matches(path, '(^|/)(\.[^/]*|AGENTS|CLAUDE|GEMINI|QWEN|README|SCHEMA|log)\.md$') AS is_note, count(*) AS n FROM n GROUP BY ALL",
    "v_browse": f"WITH {_N} SELECT path, basename, coalesce(title, replace(basename, '-', ' ')) AS title, type, status, updated FROM n WHERE starts_with(path, 'wiki/reading/') AND len(string_split(path, '/')) >= 3",
    "v_graph_nodes": f"WITH {_N} SELECT note_id AS node, path, basename IN (SELECT basename FROM lone) AS orphan FROM n WHERE starts_with(path, 'wiki/reading/') AND len(string_split(path, '/')) >= 3 ORDER BY path, node LIMIT 50",
    "v_import_tags": f"""WITH {_N}, t AS (SELECT note_id, generate_subscripts(tags, 1) AS p, unnest(tags) AS tag FROM n)
SELECT note_id, coalesce(string_agg(tag, ',' ORDER BY p) FILTER (tag LIKE '%e%'), '') AS tags, coalesce(string_agg(tag, ',' ORDER BY p) FILTER (tag NOT LIKE '%e%'), '') AS stripped FROM t GROUP BY 1""",
    "v_import_links": rf"""WITH {_N}, f AS (SELECT note_id, path, unnest(CASE WHEN len(outlinks) > 0 THEN outlinks ELSE [NULL]::VARCHAR[] END) AS o, generate_subscripts(CASE WHEN len(outlinks) > 0 THEN outlinks ELSE [NULL]::VARCHAR[] END, 1) AS p FROM n),
l AS (SELECT f.*, regexp_replace(regexp_replace(o, '\|.*$', ''), '^\s+|\s+$', '', 'g') AS k FROM f), t AS (SELECT basename AS k, max(path) AS dst FROM n GROUP BY 1), j AS (SELECT l.*, t.dst FROM l LEFT JOIN t USING (k))
SELECT note_id, count(dst) AS converted, coalesce(string_agg(k, ',' ORDER BY p) FILTER (dst IS NULL AND k <> '' AND o <> ''), '') AS unresolved, count(dst)::INT AS links FROM j GROUP BY 1""",
    "v_import_sources": f"WITH {_N}, t AS (SELECT *, note_id % 3 = 0 OR basename IN (SELECT basename FROM n WHERE type = 'theme' AND note_id % 3 = 0) AS c FROM n WHERE type = 'theme'), h AS (SELECT CASE WHEN c THEN 'cited' WHEN trim(regexp_replace(coalesce(body, ''), '\\s+', '', 'g')) <> '' THEN 'snapshot' ELSE 'stub' END AS how FROM t) SELECT how, count(*) AS n, sum(CASE how WHEN 'stub' THEN 0 ELSE 1 END)::BIGINT AS sources FROM h GROUP BY 1",
    "v_children": rf"""WITH {_N}, p AS (SELECT note_id, unnest(outlinks) AS o FROM n WHERE is_moc OR is_index), k AS (SELECT DISTINCT note_id, regexp_replace({_KEY.format("o")}, '^.*/', '') AS b FROM p),
c AS (SELECT note_id, regexp_replace(b, '\.md$', '') AS b0, b FROM k WHERE b <> ''), s AS (SELECT note_id, count(*) FILTER (b IN (SELECT basename FROM n)) AS kept, count(*) FILTER (b NOT IN (SELECT basename FROM n)) AS dropped FROM c GROUP BY 1)
SELECT note_id, coalesce(kept, 0)::INT AS kept, coalesce(dropped, 0)::INT AS dropped, coalesce(kept, 0)::INT AS shown FROM (SELECT DISTINCT note_id FROM n WHERE is_moc OR is_index) LEFT JOIN s USING (note_id)""",
    "v_regions": f"WITH {_RG} SELECT region_no::VARCHAR AS path, region_id, length(t)::INT AS n FROM r",
    "v_unauthored": f"WITH {_RG} SELECT region_no::VARCHAR AS path, region_id, 'placeholder' AS why FROM r WHERE t IN ('', '_pending_', '_to be written_')",
    "v_outside": f"WITH {_RG} SELECT region_no::VARCHAR AS path FROM r WHERE region_no % 7 = 0",
    "v_author_diff": f"""WITH {_N}, b0 AS (SELECT note_id, path, coalesce(body, '') AS text FROM n), b AS (SELECT path, max(text) AS old FROM b0 GROUP BY 1),
a AS (SELECT path, max(text) AS new FROM (SELECT path, CASE WHEN note_id % 5 = 0 THEN ' ' WHEN note_id % 3 = 0 THEN text || '!' ELSE text END AS text FROM b0 WHERE note_id % 11 <> 0 UNION ALL SELECT path || '.new', text FROM b0 WHERE note_id % 13 = 0) GROUP BY 1),
x AS (SELECT path, CASE WHEN new IS NULL THEN 'removed' WHEN old IS NULL THEN 'added' WHEN old <> new AND path NOT IN (SELECT path FROM b0 WHERE note_id % 2 = 1) THEN 'outside' WHEN old <> new AND trim(new) = '' THEN 'emptied' END AS problem FROM b FULL JOIN a USING (path)) SELECT * FROM x WHERE problem IS NOT NULL""",
    "v_harvest_deltas": "SELECT 'file:a' || region_no % 5 AS connector, count(*) FILTER (op <> 'DROP') AS accepted, count(*) FILTER (op = 'DROP') AS rejected FROM author_regions WHERE op <> 'NOOP' AND region_no % 5 < 4 GROUP BY 1",
    "v_roll_up": "SELECT count(*) FILTER (op IN ('CREATE_THEME', 'APPEND_DAILY')) AS ingested, count(*) FILTER (op IN ('MERGE_INTO_THEME', 'MARK_CONTESTED')) AS merged, count(*) FILTER (op IN ('DROP', 'NOOP')) AS dropped, 2::BIGINT AS failed FROM author_regions",
    "v_themes": r"""WITH r AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM author_regions WHERE title IS NOT NULL), h AS (SELECT DISTINCT slug FROM r WHERE region_no % 3 = 0),
t AS (SELECT slug, max((op = 'MARK_CONTESTED')::INT) AS c, count(DISTINCT region_no) AS s, list(DISTINCT split_part(slug, '-', -1)) AS g FROM r WHERE op IN ('MERGE_INTO_THEME', 'MARK_CONTESTED') GROUP BY 1),
a AS (SELECT CASE WHEN c = 1 THEN 'contested' ELSE 'active' END AS status, CASE WHEN t.slug IS NULL THEN DATE '2025-01-01' ELSE DATE '2026-07-01' END AS updated, 1 + coalesce(s, 0) AS ns, CASE WHEN t.slug IS NULL THEN 1 ELSE len(list_distinct(list_concat(['old'], g))) END AS nt FROM h LEFT JOIN t USING (slug)
UNION ALL SELECT 'active', DATE '2026-07-01', 1, 1 FROM r WHERE op = 'CREATE_THEME' AND region_no % 3 <> 0) SELECT status, updated, count(*) AS n, sum(ns)::BIGINT AS n_sources, sum(nt)::BIGINT AS n_tags FROM a GROUP BY ALL""",
    "v_dailies": """WITH n AS (SELECT 'd' || region_no % 9 || '-2026-07-01' AS basename, list(coalesce(summary, '') ORDER BY region_no) AS s FROM author_regions WHERE op = 'APPEND_DAILY' GROUP BY 1), h AS (SELECT 'd' || i || '-2026-07-01' AS basename, ['first'] AS s FROM range(3) t(i))
SELECT coalesce(h.basename, n.basename) AS basename, len(list_concat(coalesce(h.s, []), coalesce(n.s, [])))::INT AS n, sha256(array_to_string(list_concat(coalesce(h.s, []), coalesce(n.s, [])), '|')) AS sha FROM h FULL JOIN n ON h.basename = n.basename""",
    "v_streaks": f"""WITH {_EV}, d AS (SELECT e.* FROM e JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)), i AS (SELECT *, sum((event_type <> 'error')::INT) OVER (PARTITION BY writer ORDER BY id) AS k FROM d),
s AS (SELECT writer, sum((event_type = 'error')::INT) OVER (PARTITION BY writer, k ORDER BY id) AS f FROM i) SELECT writer, max(f)::BIGINT AS longest FROM s GROUP BY 1""",
    "v_settled": "SELECT DISTINCT (event_id % 40)::VARCHAR AS record_id FROM events WHERE event_id % 40 >= 25 AND event_id % (SELECT count(*) FROM documents) IN (SELECT doc_id FROM documents)",
    "v_ops": "SELECT DISTINCT substring(region_no::VARCHAR, 1, 1) AS k, op, 3::INT AS n FROM author_regions WHERE op IS NOT NULL",
    "v_valid": f"""WITH {_EV}, d AS (SELECT e.*, CASE event_id % 4 WHEN 0 THEN 'web:' WHEN 1 THEN 'team:' ELSE '' END || CASE WHEN event_type = 'error' THEN 'harvest:bot' ELSE 'manual' END AS source FROM e JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents))
SELECT source, count(*) AS n FROM d WHERE source = 'manual' OR starts_with(source, 'web:') OR starts_with(source, 'harvest:') OR source = 'team:manual' GROUP BY 1""",
    "v_prose": r"""WITH t AS (SELECT region_no, source_text AS x FROM author_regions WHERE source_text IS NOT NULL),
c AS (SELECT *, trim(regexp_extract(substring(x, 1, 81), '^((?s:.{0,79})[.!?。！？…])\s', 1)) AS s, trim(regexp_extract(substring(x, 1, 80), '^((?s:.+))\s\S*$', 1)) AS w FROM t)
SELECT region_no, CASE WHEN length(x) <= 80 THEN x WHEN length(s) >= 20 THEN s WHEN length(w) >= 20 THEN w ELSE substring(x, 1, 80) END AS short, regexp_replace(x || ' k|s', '^\s+', '') AS prose FROM c""",
    "v_stray_links": f"WITH {_N} SELECT note_id, 'a ' || basename || ' b [[keep|me]] c' AS text, 'go [c](/notes/a#b) or [d](/notes/d)' AS routed FROM n",
    "v_routes": r"""WITH x AS (SELECT DISTINCT ON (ext_id) lower(regexp_extract(source_url, '\.([A-Za-z0-9]+)$', 1)) AS e, lower(trim(split_part(mime, ';', 1))) AS m, mime FROM extracted_docs),
y AS (SELECT mime, CASE WHEN e = 'pdf' THEN 'pdf' WHEN e IN ('docx', 'xlsx', 'pptx') THEN 'office' WHEN e IN ('html', 'htm', 'xhtml') THEN 'markup' WHEN e IN ('md', 'markdown', 'txt', 'text', 'csv', 'log') THEN 'text' END AS a,
  CASE WHEN m = 'application/pdf' THEN 'pdf' WHEN m LIKE 'application/vnd.openxmlformats-officedocument.%' THEN 'office' WHEN m IN ('text/html', 'application/xhtml+xml') THEN 'markup' WHEN m LIKE 'text/%' THEN 'text' END AS b FROM x),
z AS (SELECT mime, a, CASE WHEN b = 'text' AND a IS NOT NULL THEN NULL ELSE b END AS b FROM y) SELECT CASE WHEN a <> b THEN NULL ELSE coalesce(a, b) END AS route, coalesce(a <> b, false) AS conflict, mime, count(*) AS n FROM z GROUP BY ALL""",
    "v_depth": f"""WITH {_EV}, d AS (SELECT e.* FROM e JOIN documents ON doc_id = event_id % (SELECT count(*) FROM documents)), r AS (SELECT * FROM d WHERE event_id % 50 = 0)
SELECT (SELECT count(*) FROM d WHERE event_id % 3 = 0) AS inbox_depth, (SELECT count(*) FROM d WHERE event_id % 3 = 1 AND ts::DATE = DATE '2024-01-02') AS processed_today, (SELECT count(*) FROM d WHERE event_id % 3 = 2) AS failed_events,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_consolidation, max({{'t': ts, 'i': id}}).i AS last_run, (2 * count(*))::BIGINT AS ingested, count(*) AS merged, 0::BIGINT AS dropped, 0::BIGINT AS failed FROM r""",
}
