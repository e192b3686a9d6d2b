"""Queries over the event log, plans, harvest and operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import redact as R
from quillstream.functions import text as X
from quillstream.operators import harvest, inbox, metrics, plans, schedule
from quillstream.plans.notes import corpus
from quillstream.session import table


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as inbox events; bodies are those of the documents in turn."""
    e, docs = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), table(spark, d, "documents")
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    body = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_sha256"))
    kind = F.when(F.col("event_type") == "error", "candidate").otherwise("capture")
    sure = F.when(F.col("event_type") == "error", "low").when(F.col("event_type") == "view", "medium").when(F.col("event_type") == "purchase", "high")
    return (
        e.join(F.broadcast(n), how="inner")
        .select(
            "event_id", X.event_id(F.col("ts"), F.col("event_id")).alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("writer"), F.when(F.col("event_type") == "error", "harvest:bot").otherwise("manual").alias("source"), kind.alias("kind"), sure.alias("confidence"), "ts",
            F.when(F.col("event_id") % 5 != 0, F.concat_ws("-", "event_type", F.get_json_object("props", "$.k"))).alias("event_key"), (F.col("event_id") % F.col("n_docs")).alias("doc_id"),
        )
        .join(body, "doc_id")
    )


def i_depth(spark, d):
    return inbox.depth(events(spark, d))


def i_first_deliveries(spark, d):
    return inbox.first_deliveries(events(spark, d)).select("id")


def i_undelivered(spark, d):
    own = events(spark, d)
    return inbox.undelivered(own, own.where("event_id % 3 = 0 and event_key is not null")).select("id")


def i_claim(spark, d):
    return inbox.claim(inbox.first_deliveries(events(spark, d))).select("id", "content_sha256")


def i_candidates(spark, d):
    return inbox.candidates(inbox.claim(inbox.first_deliveries(events(spark, d))))


def i_provenance(spark, d):
    own = inbox.claim(inbox.first_deliveries(events(spark, d)))
    return inbox.provenance(own, inbox.candidates(own))


def _attempts(spark, d):
    return events(spark, d).where("event_id % 7 = 0").select(F.array("id", F.when(F.col("event_id") % 2 == 0, F.col("id")).otherwise(F.lit("none"))).alias("event_ids"))


def i_attempts(spark, d):
    return inbox.attempt_counts(_attempts(spark, d))


def i_retry(spark, d):
    failed = events(spark, d).where("event_id % 14 < 3").select(F.col("id").alias("event_id"))
    return inbox.retry(failed, inbox.attempt_counts(_attempts(spark, d)))


def i_requeue(spark, d):
    own = events(spark, d)
    spooled = own.where("event_id % 11 = 0").select(F.concat(F.lit("failed/"), "writer", F.lit("/"), F.col("event_id").cast("string")).alias("path"), F.when(F.col("event_id") % 22 == 0, F.lit("broken")).otherwise(F.col("id")).alias("id"), "writer", "event_key")
    return inbox.requeue(spooled, own.where("event_id % 9 = 0").select("writer", "event_key"), own.where("event_id % 4 = 0").select("id"))


def i_trigger(spark, d):
    own = events(spark, d).groupBy("writer").agg(F.count(F.lit(1)).alias("depth"), F.max("ts").alias("last"))
    idle = (F.unix_seconds(F.lit("2030-01-01 00:00:00").cast("timestamp")) - F.unix_seconds("last")) / 60
    return own.select("writer", "depth", inbox.trigger(F.col("depth"), idle, F.lit(True), 12, 60 * 24 * 365 * 5).alias("reason"), inbox.backoff_seconds(F.col("depth"), 30).alias("backoff"))


def i_event_times(spark, d):
    own = events(spark, d)
    return own.select("id", F.unix_millis(X.event_time(F.col("id")).cast("timestamp")).alias("ms"), X.iso_z(F.col("ts")).alias("iso"))


def _plan(spark, d):
    r = table(spark, d, "author_regions")
    slug = X.slug(F.col("title"))
    return r.select(
        F.col("region_no").alias("pos"), F.concat(F.lit("c"), F.col("region_no").cast("string")).alias("candidate_id"), F.array(F.split_part("region_id", F.lit("--c"), F.lit(1))).alias("event_ids"),
        F.when(F.col("region_no") % 50 == 7, "RENAME").otherwise(F.col("op")).alias("op"), F.when(F.col("region_no") % 20 == 3, F.col("title")).otherwise(slug).alias("basename"), slug.alias("target_basename"), F.when(F.col("region_no") % 30 == 1, "done").alias("status"), F.array(F.element_at(F.split(slug, "-"), -1)).alias("tags"), "title", F.split_part("region_id", F.lit("--c"), F.lit(1)).alias("source"), "summary",
    )


def l_validate(spark, d):
    plan = _plan(spark, d)
    claimed = plan.where("pos % 9 <> 0").select(F.element_at("event_ids", 1).alias("event_id"))
    themes = plan.where("pos % 3 = 0").select(F.col("target_basename").alias("basename"))
    tags = spark.createDataFrame([(t,) for t in ("bundle", "index", "ledger", "queue", "cursor", "digest", "linter")], "tag string")
    return plans.validate(plan, claimed, themes, tags, plan.where("pos % 13 = 0").select("candidate_id"))


def l_counts(spark, d):
    return plans.counts(table(spark, d, "author_regions"))


def h_paragraphs(spark, d):
    own = table(spark, d, "turns").dropDuplicates(["turn_id"]).where("role <> 'tool' and text is not null")
    return harvest.paragraphs(own, ["turn_id"]).select("turn_id", "part", "paragraph")


def h_salient(spark, d):
    own = table(spark, d, "author_regions").where("source_text is not null").select("region_no", F.lit("assistant").alias("role"), F.when(F.col("region_no") % 7 == 0, F.concat(F.lit("Root cause: "), "source_text")).otherwise(F.col("source_text")).alias("text"))
    return harvest.salient(own, ["region_no"]).select("region_no", "part", "paragraph")


def h_facts(spark, d):
    """Facts of turns: redacted, cut and keyed; copies are counted."""
    own = table(spark, d, "turns").dropDuplicates(["turn_id"]).where("role = 'assistant' and text is not null")
    rows = harvest.facts(harvest.paragraphs(own.select("file", "pos", "text"), ["file", "pos"]))
    return harvest.distinct_facts(rows)


def h_redacted(spark, d):
    """Regions with a synthetic secret of each class, redacted, with the count per class."""
    secrets = ["AKIA" + "A1" * 8, "ghp_" + "a1" * 18, "xoxb-" + "1a" * 8, "AIza" + "b2" * 18, "sk_live_" + "c3" * 10, "sk-ant-" + "d4" * 12, "eyJ" + "e5" * 6 + "." + "f6" * 4 + "." + "g7" * 4, "Authorization: Bearer " + "h8" * 10]
    own = table(spark, d, "author_regions").select("region_no", F.concat_ws(" ", F.coalesce("source_text", F.lit("")), F.get(F.array(*map(F.lit, secrets)), (F.col("region_no") % len(secrets)).cast("int"))).alias("text"))
    done = own.withColumn("redacted", R.redact(F.col("text")))
    return done.select("region_no", "redacted", F.map_keys(R.hits(F.col("redacted"), F.col("text"))).alias("classes"))


def h_cursor_totals(spark, d):
    return harvest.cursor_totals(table(spark, d, "harvest_cursors"))


def h_unchanged(spark, d):
    return harvest.unchanged_scans(table(spark, d, "harvest_cursors"))


def h_routes(spark, d):
    own = table(spark, d, "extracted_docs").dropDuplicates(["ext_id"])
    return own.groupBy("extractor", harvest.route(F.lower(F.regexp_extract("source_url", r"\.([A-Za-z0-9]+)$", 1)), F.col("mime")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def h_same_content(spark, d):
    own = table(spark, d, "extracted_docs").dropDuplicates(["ext_id"])
    return own.groupBy("content_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("ext_id").alias("first_id")).where("n > 1")


def o_metrics(spark, d):
    return metrics.metrics(corpus(spark, d), table(spark, d, "turns").dropDuplicates(["turn_id"]), harvest.cursor_totals(table(spark, d, "harvest_cursors")))


def o_last_fire(spark, d):
    return schedule.last_fire(spark, "*/15 6-8 1,15 * 1", "2026-03-10 05:59:30")


def o_due_events(spark, d):
    """Events per hour that fall on minutes a schedule names."""
    return table(spark, d, "events").where(schedule.matches("*/10 8-18 * * 1-5", F.col("ts"))).groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {k: f for k, f in dict(globals()).items() if k[:2] in ("i_", "l_", "h_", "o_")}

_E = """
e AS (SELECT v.event_id, strftime(v.ts, '%Y-%m-%dT%H-%M-%S.') || lpad((extract('millisecond' FROM v.ts) % 1000)::INT::VARCHAR, 3, '0') || 'Z--' || lpad(lower(to_hex(v.event_id)), 6, '0') AS id, 'u' || v.user_id AS writer,
  CASE WHEN event_type = 'error' THEN 'harvest:bot' ELSE 'manual' END AS source, CASE WHEN event_type = 'error' THEN 'candidate' ELSE 'capture' END AS kind, CASE event_type WHEN 'error' THEN 'low' WHEN 'view' THEN 'medium' WHEN 'purchase' THEN 'high' END AS confidence, v.ts,
  CASE WHEN event_id % 5 <> 0 THEN event_type || coalesce('-' || json_extract_string(props, '$.k'), '') END AS event_key, sha256(coalesce(d.text, '')) AS content_sha256
  FROM (SELECT *, event_id % (SELECT count(*) FROM documents) AS doc FROM events) v JOIN documents d ON d.doc_id = v.doc),
fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY writer, event_key ORDER BY id) AS r FROM e) WHERE event_key IS NULL OR r = 1),
fo AS (SELECT *, sum(first::INT) OVER (ORDER BY id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY content_sha256 ORDER BY id) = 1 AS first FROM fd)),
cl AS (SELECT * FROM fo WHERE k <= 32),
ca AS (SELECT 'c' || row_number() OVER (ORDER BY min(id)) AS candidate_id, content_sha256, count(*) AS n_events, min(id) AS first_id, CASE WHEN max((kind = 'candidate')::INT) = 1 THEN 'candidate' ELSE 'capture' END AS kind,
  ['low', 'medium', 'high'][min(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END)] AS confidence, max((kind = 'candidate')::INT) = 1 OR coalesce(min(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 END), 3) = 1 AS is_gated FROM cl GROUP BY content_sha256),
att AS (SELECT unnest([id, CASE WHEN event_id % 2 = 0 THEN id ELSE 'none' END]) AS event_id FROM e WHERE event_id % 7 = 0),
ac AS (SELECT event_id, count(*) AS attempts FROM att GROUP BY 1)
"""
_PL = r"""
r0 AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, split_part(region_id, '--c', 1) AS ev FROM author_regions),
p AS (SELECT region_no AS pos, 'c' || region_no AS candidate_id, ev, CASE WHEN region_no % 50 = 7 THEN 'RENAME' ELSE op END AS op, CASE WHEN region_no % 20 = 3 THEN title ELSE slug END AS basename, slug AS target, CASE WHEN region_no % 30 = 1 THEN 'done' END AS status, split_part(slug, '-', -1) AS tag FROM r0),
c AS (SELECT DISTINCT ev FROM p WHERE pos % 9 <> 0), t AS (SELECT DISTINCT target AS basename FROM p WHERE pos % 3 = 0 AND target IS NOT NULL), mk AS (SELECT * FROM p WHERE op = 'CREATE_THEME')
"""

SQL = {
    "i_depth": f"WITH {_E} SELECT count(*) AS inbox_depth, max(id) AS last_id FROM e",
    "i_first_deliveries": f"WITH {_E} SELECT id FROM fd",
    "i_undelivered": f"WITH {_E} SELECT id FROM e WHERE NOT EXISTS (SELECT 1 FROM e l WHERE l.event_id % 3 = 0 AND l.writer = e.writer AND l.event_key = e.event_key)",
    "i_claim": f"WITH {_E} SELECT id, content_sha256 FROM cl",
    "i_candidates": f"WITH {_E} SELECT * FROM ca",
    "i_provenance": f"WITH {_E} SELECT candidate_id, id AS event_id, source, writer FROM cl JOIN ca USING (content_sha256)",
    "i_attempts": f"WITH {_E} SELECT event_id, attempts FROM ac",
    "i_retry": f"WITH {_E} SELECT id AS event_id, coalesce(attempts, 0) + 1 AS attempt, CASE WHEN coalesce(attempts, 0) + 1 < 3 THEN 'inbox' ELSE 'failed' END AS disposition FROM e LEFT JOIN ac ON ac.event_id = e.id WHERE e.event_id % 14 < 3",
    "i_requeue": rf"""WITH {_E}, s AS (SELECT 'failed/' || writer || '/' || event_id AS path, CASE WHEN event_id % 22 = 0 THEN 'broken' ELSE id END AS id, writer, event_key FROM e WHERE event_id % 11 = 0),
b AS (SELECT *, CASE WHEN id = 'broken' THEN 'unreadable' WHEN EXISTS (SELECT 1 FROM e x WHERE x.event_id % 9 = 0 AND x.writer = s.writer AND x.event_key = s.event_key) THEN 'delivered' WHEN id IN (SELECT id FROM e WHERE event_id % 4 = 0) THEN 'occupied' ELSE 'movable' END AS v FROM s)
SELECT path, id, CASE WHEN v = 'movable' AND path <> (SELECT min(path) FROM b m WHERE m.id = b.id AND m.v = 'movable') THEN 'occupied' ELSE v END AS verdict FROM b""",
    "i_trigger": f"""WITH {_E}, g AS (SELECT writer, count(*) AS depth, max(ts) AS last FROM e GROUP BY 1)
SELECT writer, depth, CASE WHEN depth >= 12 THEN 'threshold' WHEN (epoch(TIMESTAMP '2030-01-01') - floor(epoch(last))) / 60 >= 60 * 24 * 365 * 5 THEN 'idle' ELSE 'cron' END AS reason, least(900.0, 30.0 * pow(2.0, least(depth, 10))) AS backoff FROM g""",
    "i_event_times": f"WITH {_E} SELECT id, epoch_us(ts) // 1000 AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM e",
    "l_counts": "SELECT op, count(*) AS n FROM author_regions GROUP BY 1",
    "l_validate": f"""WITH {_PL} SELECT 'COVERAGE' AS "check", 'uncovered ' || ev AS message, NULL::BIGINT AS pos FROM c WHERE ev NOT IN (SELECT ev FROM p)
UNION ALL SELECT 'PROVENANCE', 'unknown event ' || ev, pos FROM p WHERE ev NOT IN (SELECT ev FROM c)
UNION ALL SELECT 'COVERAGE', 'covered twice ' || ev, max(pos) FROM p GROUP BY ev HAVING count(*) > 1
UNION ALL SELECT 'CLOSED-VOCAB', 'op ' || coalesce(op, 'null'), pos FROM p WHERE op IS NULL OR op NOT IN ('CREATE_THEME', 'APPEND_DAILY', 'MERGE_INTO_THEME', 'MARK_CONTESTED', 'DROP', 'NOOP')
UNION ALL SELECT 'TAXONOMY', 'tag ' || tag, pos FROM p WHERE tag IS NULL OR tag NOT IN ('bundle', 'index', 'ledger', 'queue', 'cursor', 'digest', 'linter')
UNION ALL SELECT 'BASENAME', 'basename ' || coalesce(basename, 'null'), pos FROM mk WHERE basename IS NULL OR NOT regexp_full_match(basename, '[a-z0-9]+(-[a-z0-9]+)*')
UNION ALL SELECT 'BASENAME', 'exists ' || basename, pos FROM mk WHERE basename IN (SELECT basename FROM t)
UNION ALL SELECT 'BASENAME', 'made twice ' || basename, max(pos) FROM mk GROUP BY basename HAVING count(*) > 1
UNION ALL SELECT 'LINK-RESOLVABILITY', 'target ' || coalesce(target, 'null'), pos FROM p WHERE op IN ('MERGE_INTO_THEME', 'MARK_CONTESTED') AND (target IS NULL OR target NOT IN (SELECT basename FROM t))
UNION ALL SELECT 'STATUS', 'status ' || status, pos FROM p WHERE status NOT IN ('active', 'stub', 'contested')
UNION ALL SELECT 'CANDIDATE-GATE', 'gated ' || candidate_id, pos FROM mk WHERE pos % 13 = 0""",
    "h_paragraphs": r"""WITH t AS (SELECT DISTINCT ON (turn_id) turn_id, text FROM turns WHERE role <> 'tool' AND text IS NOT NULL),
p AS (SELECT turn_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM t)
SELECT turn_id, (generate_subscripts(a, 1) - 1)::INT AS part, unnest(a) AS paragraph FROM p""",
    "h_salient": rf"""WITH t AS (SELECT region_no, CASE WHEN region_no % 7 = 0 THEN 'Root cause: ' || source_text ELSE source_text END AS text FROM author_regions WHERE source_text IS NOT NULL),
p AS (SELECT region_no, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS a FROM t), q AS (SELECT region_no, (generate_subscripts(a, 1) - 1)::INT AS part, unnest(a) AS paragraph FROM p)
SELECT * FROM q WHERE regexp_matches(paragraph, '{harvest.SALIENCE}')""",
    "h_cursor_totals": "SELECT connector, count(*) AS scans, sum(proposed)::BIGINT AS proposed, sum(accepted)::BIGINT AS accepted, sum(rejected)::BIGINT AS rejected, sum(coalesce(list_sum(map_values(redacted)), 0))::BIGINT AS redactions FROM (SELECT DISTINCT ON (cursor_id) * FROM harvest_cursors) GROUP BY 1",
    "h_unchanged": "SELECT connector, source_path, sum(c - 1)::BIGINT AS n FROM (SELECT connector, source_path, last_content_sha256, count(*) AS c FROM (SELECT DISTINCT ON (cursor_id) * FROM harvest_cursors) WHERE last_content_sha256 IS NOT NULL GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL",
    "h_routes": r"""WITH x AS (SELECT extractor, mime, lower(regexp_extract(source_url, '\.([A-Za-z0-9]+)$', 1)) AS ext FROM (SELECT DISTINCT ON (ext_id) * FROM extracted_docs))
SELECT extractor, coalesce(CASE WHEN ext IN ('md', 'txt', 'markdown') THEN 'text' WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('docx', 'xlsx', 'pptx') THEN 'office' WHEN ext IN ('html', 'htm') THEN 'url' END,
  CASE WHEN starts_with(mime, 'text/html') THEN 'url' WHEN starts_with(mime, 'text/') THEN 'text' WHEN mime = 'application/pdf' THEN 'pdf' WHEN starts_with(mime, 'application/vnd.') THEN 'office' END) AS route, count(*) AS n FROM x GROUP BY ALL""",
    "h_same_content": "SELECT content_sha256, count(*) AS n, min(ext_id) AS first_id FROM (SELECT DISTINCT ON (ext_id) * FROM extracted_docs) GROUP BY 1 HAVING count(*) > 1",
    "o_last_fire": """SELECT max(t) AS fire FROM (SELECT unnest(generate_series(TIMESTAMPTZ '2026-03-10 05:59:00+00' - INTERVAL 366 DAY, TIMESTAMPTZ '2026-03-10 05:59:00+00', INTERVAL 1 MINUTE)) AS t)
WHERE minute(t) % 15 = 0 AND hour(t) BETWEEN 6 AND 8 AND (day(t) IN (1, 15) OR dayofweek(t) = 1)""",
    "o_due_events": "SELECT hour(ts)::INT AS hour, count(*) AS n FROM events WHERE minute(ts) % 10 = 0 AND hour(ts) BETWEEN 8 AND 18 AND dayofweek(ts) BETWEEN 1 AND 5 GROUP BY 1",
    "o_metrics": r"""WITH n AS (SELECT lower(regexp_replace(p.status, '^\s+|\s+$', '', 'g')) AS status FROM (SELECT DISTINCT ON (note_id) * FROM parsed_notes) p JOIN (SELECT DISTINCT ON (note_id) * FROM note_files) f USING (note_id) WHERE f.removed_at IS NULL),
c AS (SELECT connector, sum(proposed) AS p, sum(accepted) AS a, sum(rejected) AS r FROM (SELECT DISTINCT ON (cursor_id) * FROM harvest_cursors) GROUP BY 1)
SELECT 'kb_notes' AS name, 'status="' || coalesce(status, '') || '"' AS labels, count(*)::DOUBLE AS value FROM n GROUP BY status
UNION ALL SELECT 'kb_turns', 'role="' || coalesce(role, '') || '"', count(*)::DOUBLE FROM (SELECT DISTINCT ON (turn_id) * FROM turns) GROUP BY role
UNION ALL SELECT 'kb_harvest_proposed_total', 'connector="' || coalesce(connector, '') || '"', p::DOUBLE FROM c UNION ALL SELECT 'kb_harvest_accepted_total', 'connector="' || coalesce(connector, '') || '"', a::DOUBLE FROM c
UNION ALL SELECT 'kb_harvest_rejected_total', 'connector="' || coalesce(connector, '') || '"', r::DOUBLE FROM c""",
}
