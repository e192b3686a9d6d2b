"""Queries of the general record-hygiene operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators import instants, references
from quillstream.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return references.dead_links(table(spark, d, "parsed_notes"), table(spark, d, "note_files")).select("note_id", "target").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return references.dead_link_report(references.dead_links(table(spark, d, "parsed_notes"), table(spark, d, "note_files")), "parsed_notes")


def p1_hit_paths(spark: SparkSession, d: str) -> DataFrame:
    """Search hits whose (repo, path, anchor) key is held against the notes' paths and heading anchors, by null mask."""
    notes = table(spark, d, "parsed_notes")
    anchors = notes.select("path", F.explode("headings.slug").alias("slug")).union(notes.select("path", F.lit("top").alias("slug"))).distinct()
    hits = table(spark, d, "search_hits").select("hit_id", "path", "anchor").distinct()
    return references.orphan_references(hits, anchors, [("path", "path"), ("anchor", "slug")], "partial").select("hit_id", "path", "anchor", "reason")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return instants.unusual_instants(table(spark, d, "turns"), table(spark, d, "harvest_cursors"), table(spark, d, "machines"))


def p2_normalised(spark: SparkSession, d: str) -> DataFrame:
    """The instant of every turn and cursor, wall clocks of machines without a zone read under the zone estimated for them."""
    return instants.normalised_tables(table(spark, d, "turns"), table(spark, d, "harvest_cursors"), table(spark, d, "machines"))


def p2_zones(spark: SparkSession, d: str) -> DataFrame:
    """The zone estimated for each machine, whether or not it states one."""
    parsed = instants.parse_text(table(spark, d, "turns").select("timestamp", "machine", "ingested_at"), "timestamp")
    wall = parsed.where("__stated = 'wall'").select("machine", "__local_us", F.unix_micros("ingested_at").alias("__ing"))
    return instants.estimate_zones(wall, "machine", "__local_us", "__ing", instants.candidate_zones())


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_hit_paths, p2_found, p2_normalised, p2_zones)}

_LINKS = r"""
links AS (
  SELECT DISTINCT note_id, parsed_at,
    regexp_replace(regexp_replace(trim(regexp_replace(u.x, '[|#].*$', '', 's'), chr(9) || chr(10) || chr(13) || ' ' || chr(160)), '^.*/', '', 's'), '\.md$', '') AS target
  FROM parsed_notes, unnest(outlinks) AS u(x)),
dead AS (
  SELECT note_id, target, parsed_at FROM links l
  WHERE target <> '' AND NOT EXISTS (
    SELECT 1 FROM note_files n WHERE n.basename = l.target AND n.first_seen <= l.parsed_at AND (n.removed_at IS NULL OR n.removed_at > l.parsed_at)))
"""

SQL = {
    "p1_found": "WITH " + _LINKS + "SELECT DISTINCT note_id, target FROM dead",
    "p1_report": "WITH "
    + _LINKS
    + """, why AS (
  SELECT d.*, CASE WHEN NOT EXISTS (SELECT 1 FROM note_files n WHERE n.basename = d.target) THEN 'missing'
    WHEN EXISTS (SELECT 1 FROM note_files n WHERE n.basename = d.target AND n.first_seen <= d.parsed_at) THEN 'deleted' ELSE 'late' END AS reason FROM dead d)
SELECT 'parsed_notes' AS tab, strftime(parsed_at AT TIME ZONE 'UTC', '%Y-%m') AS month, reason, count(*) AS n FROM why GROUP BY ALL""",
    "p1_hit_paths": """WITH a AS (SELECT DISTINCT path, u.h.slug AS slug FROM parsed_notes, unnest(headings) AS u(h) UNION SELECT DISTINCT path, 'top' FROM parsed_notes),
h AS (SELECT DISTINCT hit_id, path, anchor FROM search_hits)
SELECT hit_id, path, anchor, 'missing' AS reason FROM h
WHERE (path IS NOT NULL OR anchor IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM a WHERE (h.path IS NULL OR a.path = h.path) AND (h.anchor IS NULL OR a.slug = h.anchor)
  AND (h.path IS NULL OR a.path IS NOT NULL) AND (h.anchor IS NULL OR a.slug IS NOT NULL))""",
}
