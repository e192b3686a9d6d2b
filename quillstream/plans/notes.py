"""Queries over the note corpus: parsing, links, graph, ranking, packs and integrity, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators import graph, lint, notes, packs, ranking
from quillstream.session import cut, table

QUESTIONS = ["How does the harvester handle broken links?", "Which transcript rules apply to the retry record", "open questions about the ledger", "정해진 지문과 제목", "the of and", "Warum braucht der Kurator eine Liste", "what does reading say about the queue", "home lab digest for every page"]
REFERENCE = "2026-07-01"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return notes.alive(notes.corpus(table(spark, d, "note_files"), table(spark, d, "parsed_notes")))


def k_types(spark, d):
    return corpus(spark, d).groupBy("type", "status").agg(F.count(F.lit(1)).alias("n"))


def k_headings(spark, d):
    own = notes.lines(table(spark, d, "note_files").where("body is not null").dropDuplicates(["note_id"]))
    return notes.headings(own)


def k_enclosing(spark, d):
    own = notes.lines(table(spark, d, "note_files").where("body is not null").dropDuplicates(["note_id"]))
    return notes.enclosing_heading(own, notes.headings(own)).where("anchor is not null").groupBy("note_id", "anchor").agg(F.count(F.lit(1)).alias("n_lines"))


def k_body_links(spark, d):
    return notes.body_links(table(spark, d, "note_files").dropDuplicates(["note_id"])).groupBy("note_id", "target").agg(F.count(F.lit(1)).alias("n"))


def k_slugs(spark, d):
    t = table(spark, d, "parsed_notes").dropDuplicates(["note_id"]).where("title is not null")
    return t.select("note_id", X.slug(F.col("title")).alias("slug"), X.title_of_slug(F.col("basename")).alias("name"), X.is_moc_path(F.col("path")).alias("moc"), X.path_domain(F.col("path")).alias("domain"))


def k_digests(spark, d):
    t = table(spark, d, "note_files").dropDuplicates(["note_id"]).where("body is not null")
    return t.select("note_id", F.sha2("body", 256).alias("source_digest"), X.content_sha(F.col("body")).alias("content_sha256"), X.token_estimate(F.col("body")).alias("est_tokens"))


def k_summaries(spark, d):
    t = table(spark, d, "note_files").dropDuplicates(["note_id"]).where("body is not null")
    return t.select("note_id", X.collapse(F.col("body")).alias("excerpt"))


def k_edges(spark, d):
    return notes.edges(corpus(spark, d))


def k_indegrees(spark, d):
    return ranking.indegrees(notes.links(corpus(spark, d)))


def k_broken(spark, d):
    return notes.broken_links(corpus(spark, d))


def k_same_names(spark, d):
    return notes.duplicate_basenames(corpus(spark, d))


def k_orphans(spark, d):
    return lint.orphan_themes(corpus(spark, d))


def k_seeds(spark, d):
    own = corpus(spark, d)
    return ranking.seed_distances(own, notes.links(own))


def k_near_roots(spark, d):
    own = corpus(spark, d)
    links = notes.links(own)
    return ranking.bounded_distances(ranking.seed_distances(own, links), links)


def k_all_distances(spark, d):
    own = corpus(spark, d)
    roots = own.where("is_moc or is_index").select(F.col("note_id").alias("node"))
    return graph.full_distances(own.select(F.col("note_id").alias("node")), roots, notes.edges(own))


def k_ego(spark, d):
    links = notes.edges(corpus(spark, d))
    return graph.ego(links, 10, 2)[0]


def k_ego_edges(spark, d):
    return graph.ego(notes.edges(corpus(spark, d)), 10, 2)[1].select("src", "dst")


def k_totals(spark, d):
    own = corpus(spark, d)
    return graph.overview(own.select(F.col("note_id").alias("node"), "path"), notes.edges(own), 500)[2]


def k_children(spark, d):
    return graph.children(corpus(spark, d))


def k_stats(spark, d):
    s = ranking.corpus_stats(ranking.field_tokens(corpus(spark, d)))
    return s.select("n", *(F.bround(f"avg{i}", 6).alias(f"avg{i}") for i in range(6)))


def k_document_frequency(spark, d):
    tokens = ranking.field_tokens(corpus(spark, d))
    every = tokens.select("note_id", F.explode(F.array_distinct(F.concat(*(f"f{i}" for i in range(6))))).alias("token"))
    return every.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def k_lexical(spark, d):
    wanted = ranking.question_tokens(ranking.questions_frame(spark, QUESTIONS))
    return ranking.lexical(ranking.field_tokens(corpus(spark, d)), wanted).select("qid", "note_id", "lex", F.col("top").cast("int").alias("top"))


def k_rank(spark, d):
    return ranking.rank(corpus(spark, d), ranking.questions_frame(spark, QUESTIONS)).select("qid", "pos", "note_id", "path", "match_reason", "score")


def k_hits(spark, d):
    """The full result rows, with anchor, line and excerpt."""
    return ranking.rank(corpus(spark, d), ranking.questions_frame(spark, QUESTIONS))


def _scored(spark, d):
    own = corpus(spark, d)
    links = cut(notes.links(own))
    degrees = ranking.indegrees(links)
    most = degrees.agg(F.coalesce(F.max("indeg"), F.lit(0)).alias("most"))
    seeds = ranking.seed_distances(own, links).withColumnRenamed("note_id", "node")
    dist = graph.full_distances(own.select(F.col("note_id").alias("node")), seeds, links).withColumnRenamed("node", "note_id")
    fit = packs.eligible(own).join(degrees, "note_id", "left").join(dist, "note_id", "left").join(F.broadcast(most), how="inner")  # one row
    structure = ranking.structural(F.coalesce("d", F.lit(graph.UNREACHED)), F.coalesce("indeg", F.lit(0)), F.col("most"), None)
    cited = F.coalesce(F.size(F.from_json(F.get_json_object("frontmatter", "$.sources"), "array<string>")), F.lit(0))
    score = packs.pack_score(structure, packs.last_date().cast("date"), F.get_json_object("frontmatter", "$.confidence"), F.greatest(cited, F.lit(0)), REFERENCE)
    text = packs.line(F.coalesce("title", F.replace("basename", F.lit("-"), F.lit(" "))), F.get(F.filter("body_lines", lambda x: (F.trim(x) != "") & ~x.startswith("#")), F.lit(0)), F.col("path"))
    sha = X.content_sha(F.coalesce("body", F.lit("")))
    return fit.select("note_id", F.concat("path", F.lit("#"), F.col("note_id").cast("string")).alias("path"), score.alias("score"), text.alias("line"), sha.alias("content_sha256")).withColumn("tokens", X.token_estimate(F.concat("line", F.lit("\n"))))


def _pack(spark, d):
    return packs.fill_budget(_scored(spark, d), spent=packs.frame_cost("main"))


def k_pack_scores(spark, d):
    return _scored(spark, d).select("note_id", "score", "tokens")


def k_pack(spark, d):
    return _pack(spark, d).select("pos", "note_id", "score", "tokens")


def k_pack_text(spark, d):
    """The rendered pack with its counts."""
    return packs.pack_text(_pack(spark, d), "main", "v1").select("text", "note_count", "est_tokens")


def k_near_lines(spark, d):
    """Themes outside the pack whose line resembles one of it."""
    own = cut(_scored(spark, d))
    pack = packs.fill_budget(own, spent=packs.frame_cost("main"))
    others = own.join(pack.select("note_id"), "note_id", "left_anti")
    return packs.near_lines(others.select(F.col("note_id").alias("id"), F.col("line").alias("text")), pack.select(F.col("line").alias("text")), 0.4)


def k_share(spark, d):
    """Eligible themes of one domain as if harvested, cut to a twentieth of all."""
    scored = _scored(spark, d).withColumn("own", F.col("path").contains("/home-lab/") | F.col("path").contains("/reading/"))
    return packs.capped_share(scored, "own", 0.05).select("note_id", "own")


def _lint(spark, d):
    own = corpus(spark, d)
    allowed = own.select(F.explode("tags").alias("tag")).where("tag like '%a%'").distinct()
    raw = table(spark, d, "extracted_docs").select(F.col("source_url").alias("path"))
    domains = own.select(X.path_domain(F.col("path")).alias("domain")).where("domain like '%e%'").distinct()
    return lint.lint(own, allowed, REFERENCE, raw, "1", None, domains, 5)


def k_lint(spark, d):
    return _lint(spark, d)


def k_health(spark, d):
    return lint.health(corpus(spark, d), _lint(spark, d))


def k_tags(spark, d):
    return corpus(spark, d).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def k_snapshot_diff(spark, d):
    files = table(spark, d, "note_files").dropDuplicates(["note_id"]).withColumn("digest", F.sha2("body", 256))
    at = lambda day: files.where(f"first_seen <= timestamp '{day} 00:00:00' and (removed_at is null or removed_at > timestamp '{day} 00:00:00')").select("note_id", "digest")
    return notes.snapshot_diff(at("2024-09-01"), at("2025-03-01"), "note_id", "digest")


def k_stored_hits(spark, d):
    """Stored hits per query, best first, three at most."""
    hits = table(spark, d, "search_hits").dropDuplicates(["hit_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "hit_id"))
    return hits.withColumn("r", rank).where("r <= 3").select("query_id", "hit_id", "r", "score")


QUERIES = {k: f for k, f in dict(globals()).items() if k.startswith("k_")}

_N = r"""
n AS (
  SELECT p.note_id, f.rel_path AS path, p.basename, f.type, p.is_moc, p.is_index, p.title, p.title_line, p.headings, p.tags, lower(regexp_replace(p.status, '^\s+|\s+$', '', 'g')) AS status,
    p.body_lines, p.outlinks, f.body, f.frontmatter, try_cast(json_extract_string(f.frontmatter, '$.updated') AS DATE) AS updated
  FROM (SELECT DISTINCT ON (note_id) * FROM parsed_notes) p JOIN (SELECT DISTINCT ON (note_id) * FROM note_files) f USING (note_id) WHERE f.removed_at IS NULL),
keyed AS (SELECT DISTINCT note_id AS src, path, regexp_replace(regexp_replace(u.x, '[|#].*$', '', 's'), '^\s+|\s+$', '', 'g') AS target FROM n, unnest(n.outlinks) AS u(x)),
names AS (SELECT basename AS target, max({'p': path, 'i': note_id}).i AS dst FROM n GROUP BY 1),
link AS (SELECT DISTINCT src, dst FROM keyed JOIN names USING (target)),
firsts AS (SELECT basename AS target, min({'p': path, 'i': note_id}).i AS dst FROM n GROUP BY 1),
edge AS (SELECT DISTINCT src, dst FROM keyed JOIN firsts USING (target) WHERE src <> dst),
known AS (SELECT basename AS target FROM n UNION SELECT unnest(json_extract_string(frontmatter, '$.aliases[*]')) FROM n),
lone AS (SELECT DISTINCT basename FROM n WHERE type = 'theme' AND basename NOT IN (SELECT target FROM keyed WHERE target IS NOT NULL))
"""
_LINES = r"""
b AS (SELECT DISTINCT ON (note_id) note_id, body FROM note_files WHERE body IS NOT NULL),
ln AS (SELECT note_id, generate_subscripts(string_split(body, chr(10)), 1) AS line, unnest(string_split(body, chr(10))) AS text FROM b),
fl AS (SELECT *, regexp_matches(text, '^[ \t]*(```+|~~~+)') AS delim FROM ln),
fe AS (SELECT *, sum(delim::INT) OVER (PARTITION BY note_id ORDER BY line) % 2 = 1 AS fenced FROM fl),
hd AS (SELECT note_id, line, length(regexp_extract(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$', 1)) AS level, regexp_extract(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$', 2) AS text
  FROM fe WHERE NOT fenced AND NOT delim AND regexp_matches(text, '^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$')),
hb AS (SELECT *, regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM hd),
hn AS (SELECT *, row_number() OVER (PARTITION BY note_id, base ORDER BY line) - 1 AS k FROM hb),
h AS (SELECT note_id, line, level, text, CASE WHEN k = 0 OR base = '' THEN base ELSE base || '-' || k END AS slug FROM hn)
"""
_STOP = ", ".join(f"'{w}'" for w in X.STOPWORDS)
_CJK = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ((0x1100, 0x11FF), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x3131, 0x318E), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A), (0xFF66, 0xFFDC)))


def _tok(c: str) -> str:
    runs = f"regexp_extract_all(lower(nfc_normalize(coalesce({c}, ''))), '[a-z0-9]+|[{_CJK}]+')"
    split = f"list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^[a-z0-9]') OR length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i+1]) END)"
    return f"list_filter(flatten({split}), lambda t: t NOT IN ({_STOP}))"


def _tags(c: str) -> str:
    return f"flatten(list_transform(coalesce({c}, []::VARCHAR[]), lambda g: CASE WHEN contains(g, '-') THEN list_concat([lower(nfc_normalize(g))], {_tok('g')}) ELSE {_tok('g')} END))"


_BODY = r"regexp_replace(regexp_replace(array_to_string(body_lines, chr(10)), '\[\[(?:[^\]|]*\|)?([^\]]*)\]\]', '\1', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g')"
_T = f"""
tk AS (SELECT note_id, {_tok("coalesce(title, replace(basename, '-', ' '))")} AS f0, {_tags("json_extract_string(frontmatter, '$.aliases[*]')")} AS f1, {_tags("tags")} AS f2,
  {_tok("array_to_string(list_transform(headings, lambda h: h.text), chr(10))")} AS f3, {_tok("json_extract_string(frontmatter, '$.summary')")} AS f4, {_tok(_BODY)} AS f5 FROM n)
"""
_SEED = """
root AS (SELECT note_id, CASE WHEN is_moc THEN 0 ELSE 1 END AS d FROM n WHERE is_moc OR is_index),
seed AS (SELECT note_id, min(d) AS d FROM (SELECT * FROM root UNION ALL SELECT e.dst, r.d FROM link e JOIN root r ON e.src = r.note_id) GROUP BY 1),
h1 AS (SELECT note_id, min(d) AS d FROM (SELECT * FROM seed UNION ALL SELECT e.dst, s.d + 1 FROM seed s JOIN link e ON e.src = s.note_id WHERE s.d < 2) GROUP BY 1),
dist AS (SELECT note_id, min(d) AS d FROM (SELECT * FROM h1 UNION ALL SELECT e.dst, s.d + 1 FROM h1 s JOIN link e ON e.src = s.note_id WHERE s.d < 2) GROUP BY 1)
"""
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + f") v(qid, question)), qt AS (SELECT DISTINCT qid, unnest({_tok('question')}) AS token FROM q)"
_FTD = " + ".join(f"{w:.1f} * tf{i} / CASE WHEN avg{i} = 0 THEN 1.0 ELSE {1 - b!r} + {b!r} * len{i} / avg{i} END" for i, (_, w, b) in enumerate(ranking.FIELDS))
_LEX = f"""
st AS (SELECT count(*) AS n, {", ".join(f"avg(len(f{i})) AS avg{i}" for i in range(6))} FROM tk),
oc AS (SELECT note_id, token, {", ".join(f"any_value(len{i}) AS len{i}, count(*) FILTER (f = {i}) AS tf{i}" for i in range(6))} FROM (
  SELECT note_id, {", ".join(f"len(f{i}) AS len{i}" for i in range(6))}, unnest(flatten([{", ".join(f"list_transform(f{i}, lambda t: {{'t': t, 'f': {i}}})" for i in range(6))}])) AS p FROM tk) x0, LATERAL (SELECT x0.p.t AS token, x0.p.f AS f)
  WHERE token IN (SELECT token FROM qt) GROUP BY 1, 2),
idf AS (SELECT token, greatest(0.0, ln(1 + (any_value(st.n) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM oc, st GROUP BY 1),
pt AS (SELECT oc.note_id, oc.token, idf.idf, CASE {" ".join(f"WHEN tf{i} > 0 THEN {i}" for i in range(6))} END AS field, {_FTD} AS ftd FROM oc JOIN idf USING (token), st),
lx AS (SELECT qid, note_id, list_sum(list(idf * ftd * 2.2 / (ftd + 1.2) ORDER BY token)) AS raw, min({{'i': -idf, 'field': field, 'token': token}}).field AS top FROM pt JOIN qt USING (token) GROUP BY 1, 2),
lex AS (SELECT qid, note_id, round_even(raw / (raw + 1.5), 6) AS lex, top FROM lx)
"""
_RANK = f"""
page AS (SELECT note_id, path, is_moc, CASE WHEN len(string_split(path, '/')) >= 3 AND starts_with(path, 'wiki/') THEN split_part(path, '/', 2) END AS domain FROM n WHERE is_moc OR is_index),
ask AS (SELECT qid, list(token) AS toks FROM qt GROUP BY 1),
foc AS (SELECT qid, min({{'p': path, 's': domain}}).s AS scope FROM page, ask WHERE is_moc AND len({_tok("domain")}) > 0 AND list_has_all(toks, {_tok("domain")}) GROUP BY 1),
scopes AS (SELECT '' AS scope UNION SELECT scope FROM foc),
sroot AS (SELECT scope, note_id, CASE WHEN is_moc THEN 0 ELSE 1 END AS d FROM page, scopes WHERE scope = '' OR NOT is_moc OR domain = scope),
s0 AS (SELECT scope, note_id, min(d) AS d FROM (SELECT * FROM sroot UNION ALL SELECT r.scope, e.dst, r.d FROM link e JOIN sroot r ON e.src = r.note_id) GROUP BY ALL),
s1 AS (SELECT scope, note_id, min(d) AS d FROM (SELECT * FROM s0 UNION ALL SELECT s.scope, e.dst, s.d + 1 FROM s0 s JOIN link e ON e.src = s.note_id WHERE s.d < 2) GROUP BY ALL),
sdist AS (SELECT scope, note_id, min(d) AS d FROM (SELECT * FROM s1 UNION ALL SELECT s.scope, e.dst, s.d + 1 FROM s1 s JOIN link e ON e.src = s.note_id WHERE s.d < 2) GROUP BY ALL),
shown AS (SELECT note_id AS src, regexp_replace(regexp_replace(u.x, '[|#].*$', '', 's'), '^\\s+|\\s+$', '', 'g') AS target, {_tok("regexp_replace(u.x, '^[^|]*[|]', '', 's')")} AS words FROM n, unnest(n.outlinks) AS u(x) WHERE n.is_moc AND contains(u.x, '|')),
lab AS (SELECT r.scope, names.dst AS note_id, flatten(list(words)) AS words FROM shown JOIN sroot r ON r.note_id = shown.src AND r.d = 0 JOIN names USING (target) GROUP BY ALL),
deg AS (SELECT dst AS note_id, count(*) AS indeg FROM link GROUP BY 1), mx AS (SELECT coalesce(max(indeg), 0) AS most FROM deg),
sc AS (SELECT l.qid, l.note_id, n.path, l.lex, l.top, coalesce(deg.indeg, 0) AS indeg, coalesce(sdist.d, 3) AS d, list_has_any(flatten([tk.f0, tk.f1, tk.f2]), ask.toks) OR coalesce(list_has_any(lab.words, ask.toks) AND s0.d = 0, false) AS linked, n.status,
  round_even(least(1.0, greatest(0.0, 0.65 * l.lex + 0.35 * round_even(0.7 / (1 + coalesce(sdist.d, 3)) + 0.3 * coalesce(deg.indeg, 0) / greatest(1, mx.most), 6)
    + CASE n.status WHEN 'active' THEN 0.10 WHEN 'deprecated' THEN -0.15 ELSE 0.0 END)), 6) AS score
  FROM lex l JOIN n USING (note_id) JOIN tk USING (note_id) LEFT JOIN deg USING (note_id) JOIN ask USING (qid) LEFT JOIN foc USING (qid) LEFT JOIN sdist ON sdist.note_id = l.note_id AND sdist.scope = coalesce(foc.scope, '')
  LEFT JOIN s0 ON s0.note_id = l.note_id AND s0.scope = coalesce(foc.scope, '') LEFT JOIN lab ON lab.note_id = l.note_id AND lab.scope = coalesce(foc.scope, ''), mx),
rs AS (SELECT *, CASE WHEN d = 0 AND linked THEN 0 WHEN top IN (0, 3) THEN 1 ELSE 2 END AS reason FROM sc WHERE lex > 0 OR (d = 0 AND linked)),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, reason, lex DESC, indeg DESC, path, note_id) AS pos, max(score) OVER (PARTITION BY qid) AS best FROM rs)
"""
_PACK = r"""
walk AS (SELECT note_id AS node, d FROM seed UNION SELECT e.dst, walk.d + 1 FROM walk JOIN link e ON e.src = walk.node WHERE walk.d < 40), far AS (SELECT node AS note_id, min(d) AS d FROM walk GROUP BY 1),
deg AS (SELECT dst AS note_id, count(*) AS indeg FROM link GROUP BY 1), mx AS (SELECT coalesce(max(indeg), 0) AS most FROM deg),
el AS (SELECT * FROM n WHERE type = 'theme' AND status = 'active' AND coalesce(json_extract_string(frontmatter, '$.confidence'), 'high') <> 'low' AND NOT coalesce(starts_with(json_extract_string(frontmatter, '$.origin'), 'harvest:'), false)),
pl AS (SELECT el.*, coalesce(far.d, 1000000) AS d, coalesce(deg.indeg, 0) AS indeg, mx.most,
  trim(regexp_replace(coalesce(title, replace(basename, '-', ' ')), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}\x{2028}\x{2029}\x{1680}]+', ' ', 'g')) AS t,
  trim(regexp_replace(coalesce(list_filter(body_lines, lambda x: trim(x) <> '' AND NOT starts_with(x, '#'))[1], ''), '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}\x{2028}\x{2029}\x{1680}]+', ' ', 'g')) AS s FROM el LEFT JOIN deg USING (note_id) LEFT JOIN far USING (note_id), mx),
sc AS (SELECT note_id, path || '#' || note_id AS path, '- **' || t || '**' || CASE WHEN s = '' THEN '' ELSE ' — ' || s END || '  [' || path || ']' AS line,
  round_even(0.35 * (0.7 / (1 + d) + 0.3 * indeg / greatest(1, most)) + 0.25 * CASE WHEN updated IS NULL THEN 0.0 ELSE pow(0.5, greatest(0, date_diff('day', updated, DATE '2026-07-01')) / 30.0) END
    + 0.2 * CASE json_extract_string(frontmatter, '$.confidence') WHEN 'medium' THEN 0.7 WHEN 'low' THEN 0.5 ELSE 1.0 END + 0.2 * least(1.0, coalesce(len(json_extract_string(frontmatter, '$.sources[*]')), 0) / 5.0), 6) AS score FROM pl),
""" + rf"""
pk AS (SELECT *, (length(regexp_replace(line || chr(10), '[^{X.CJK_CLASS}]', '', 'g')) + ceil(strlen(regexp_replace(line || chr(10), '[{X.CJK_CLASS}]', '', 'g')) / 4.0))::BIGINT AS tokens FROM sc)
"""
# An empty frame has 280 bytes, so 70 tokens are spent at the start.
_FILL = """
od AS (SELECT *, row_number() OVER (ORDER BY score DESC, path) AS r FROM pk),
fold AS (SELECT 0::BIGINT AS r, 70::BIGINT AS used, false AS took UNION ALL
  SELECT od.r, CASE WHEN f.used + od.tokens <= 2000 THEN f.used + od.tokens ELSE f.used END, f.used + od.tokens <= 2000 FROM fold f JOIN od ON od.r = f.r + 1),
pack AS (SELECT (row_number() OVER (ORDER BY od.r) - 1)::INT AS pos, od.* EXCLUDE (r) FROM od JOIN fold USING (r) WHERE fold.took)
"""

_LISTED = r"""'^\[\s*("[^"]*"\s*(,\s*"[^"]*"\s*)*)?\]$'"""
_LINT = rf"""
allowed AS (SELECT DISTINCT unnest(tags) AS tag FROM n), j AS (SELECT *, {", ".join(f"json_extract_string(frontmatter, '$.{k}') AS j_{k}" for k in ("summary", "created", "updated", "date", "run_id", "children", "sources", "related", "confidence", "tags", "aliases", "origin", "contested_by", "contested_at", "schema_version", "body_status"))}, CASE WHEN len(string_split(path, '/')) >= 3 AND starts_with(path, 'wiki/') THEN split_part(path, '/', 2) END AS domain FROM n),
dated AS (SELECT path, k, said FROM (SELECT path, 'created' AS k, j_created AS said FROM j UNION ALL SELECT path, 'updated', j_updated FROM j UNION ALL SELECT path, 'date', j_date FROM j WHERE type = 'daily') WHERE said IS NOT NULL),
cite AS (SELECT DISTINCT path, unnest(json_extract_string(frontmatter, '$.sources[*]')) AS source FROM j WHERE type = 'theme'),
kids AS (SELECT path, list_sort(list_distinct(regexp_extract_all(coalesce(j_children, ''), '\[\[([^\]|#]*)', 1))) AS d, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(body, ''), '(?m)^- \[[^\]\r\n]*\]\((?:[^)\r\n]*/)?([^)/\r\n]+)\.md\)(?:\s.*)?$', 1), lambda x: x))) AS b FROM j WHERE type IN ('moc', 'index')),
daily AS (SELECT path, list_filter([CASE WHEN regexp_extract(basename, '-(\d{{4}}-\d{{2}}-\d{{2}})$', 1) = '' THEN 'no date in the name' WHEN j_date <> regexp_extract(basename, '-(\d{{4}}-\d{{2}}-\d{{2}})$', 1) THEN 'date is not that of the name' END,
  CASE WHEN j_date <> '{REFERENCE}' THEN 'date is not that of the run' END, CASE WHEN substring(j_run_id, 1, 10) <> '{REFERENCE}' THEN 'run_id is not that of the run' END], lambda x: x IS NOT NULL) AS p FROM j WHERE type = 'daily'),
found AS (SELECT code, CASE WHEN code LIKE 'L2%' THEN 'warning' ELSE 'error' END AS severity, path, message FROM (
  SELECT DISTINCT 'L1-1' AS code, path, 'duplicate basename ' || basename AS message FROM n WHERE basename IN (SELECT basename FROM n GROUP BY 1 HAVING count(DISTINCT path) > 1)
  UNION ALL SELECT 'L1-2', path, 'unresolved link ' || target FROM (SELECT DISTINCT path, target FROM keyed) WHERE target <> '' AND target NOT IN (SELECT target FROM known)
  UNION ALL SELECT 'L1-4', path, unnest(list_filter([CASE WHEN title IS NULL OR regexp_replace(title, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{3000}}]+', '', 'g') = '' THEN 'missing title' END, CASE WHEN coalesce(status, '') = '' THEN 'missing status' END, CASE WHEN j_summary IS NULL THEN 'missing summary' END,
    CASE WHEN j_created IS NULL THEN 'missing created' END, CASE WHEN j_updated IS NULL THEN 'missing updated' END, CASE WHEN type = 'daily' AND j_date IS NULL THEN 'missing date' END, CASE WHEN type = 'daily' AND j_run_id IS NULL THEN 'missing run_id' END, CASE WHEN type IN ('moc', 'index') AND j_children IS NULL THEN 'missing children' END,
    CASE WHEN NOT regexp_matches(j_tags, {_LISTED}) THEN 'bad tags' END, CASE WHEN NOT regexp_matches(j_aliases, {_LISTED}) THEN 'bad aliases' END, CASE WHEN type = 'theme' AND NOT regexp_matches(j_sources, {_LISTED}) THEN 'bad sources' END, CASE WHEN type = 'theme' AND NOT regexp_matches(j_related, {_LISTED}) THEN 'bad related' END,
    CASE WHEN type IN ('moc', 'index') AND NOT regexp_matches(j_children, {_LISTED}) THEN 'bad children' END, CASE WHEN type = 'theme' AND j_confidence NOT IN ('high', 'medium', 'low') THEN 'bad confidence' END], lambda x: x IS NOT NULL)) FROM j
  UNION ALL SELECT 'L1-5', path, 'unknown tag ' || tag FROM (SELECT DISTINCT path, unnest(tags) AS tag FROM n) WHERE tag NOT IN (SELECT tag FROM allowed WHERE tag LIKE '%a%')
  UNION ALL SELECT 'L1-5', path, 'unknown domain ' || domain FROM j WHERE domain NOT LIKE '%e%'
  UNION ALL SELECT 'L1-6', path, 'children ' || array_to_string(d, ',') || ' shown ' || array_to_string(b, ',') FROM kids WHERE d <> b
  UNION ALL SELECT 'L1-7', path, 'no sources' FROM j WHERE type = 'theme' AND coalesce(status, '') <> 'stub' AND coalesce(len(json_extract_string(frontmatter, '$.sources[*]')), 0) = 0
  UNION ALL SELECT 'L1-8', path, 'missing source ' || source FROM cite WHERE NOT ends_with(source, '.meta.yaml') AND NOT EXISTS (SELECT 1 FROM extracted_docs x WHERE x.source_url = cite.source)
  UNION ALL SELECT 'L1-8b', path, 'sidecar ' || source FROM cite WHERE ends_with(source, '.meta.yaml')
  UNION ALL SELECT 'L1-10', path, 'contested without its marks' FROM j WHERE type = 'theme' AND status = 'contested' AND NOT coalesce(len(json_extract_string(frontmatter, '$.sources[*]')) >= 2 AND len(json_extract_string(frontmatter, '$.contested_by[*]')) >= 1 AND j_contested_at = '{REFERENCE}' AND regexp_matches(body, '(?m)^> \[!contested\]'), false)
  UNION ALL SELECT 'L1-11', path, 'status ' || status FROM n WHERE status <> '' AND status NOT IN ('active', 'stub', 'contested', 'deprecated')
  UNION ALL SELECT 'L1-11', path, 'type ' || coalesce(type, 'missing') FROM n WHERE type IS NULL OR type NOT IN ('theme', 'daily', 'moc', 'index')
  UNION ALL SELECT 'L1-12', path, 'bad ' || k || ' ' || said FROM dated WHERE NOT regexp_full_match(said, '\d{{4}}-\d{{2}}-\d{{2}}')
  UNION ALL SELECT 'L1-12', path, 'future ' || k || ' ' || said FROM dated WHERE regexp_full_match(said, '\d{{4}}-\d{{2}}-\d{{2}}') AND said > '{REFERENCE}'
  UNION ALL SELECT 'L1-13', path, 'second index' FROM n WHERE is_index AND path <> (SELECT min(path) FROM n WHERE is_index)
  UNION ALL SELECT 'L1-14', path, 'daily: ' || array_to_string(p, '; ') FROM daily WHERE len(p) > 0
  UNION ALL SELECT 'L1-16', path, 'not plain line feeds' FROM n WHERE contains(body, chr(13)) OR starts_with(body, chr(65279))
  UNION ALL SELECT 'L1-17', path, 'schema_version ' || j_schema_version FROM j WHERE j_schema_version <> '1'
  UNION ALL SELECT 'L1-19', path, 'origin ' || j_origin FROM j WHERE type = 'theme' AND j_origin NOT IN ('claude-code', 'codex', 'qwen', 'gemini', 'opencode', 'hermes', 'manual') AND NOT regexp_matches(j_origin, '^(web|harvest):.')
  UNION ALL SELECT 'L2-1', '', count(*) || ' orphans' FROM lone HAVING count(*) > 5))
"""

SQL = {
    "k_types": f"WITH {_N} SELECT type, status, count(*) AS n FROM n GROUP BY ALL",
    "k_headings": f"WITH {_LINES} SELECT note_id, line, level, text, slug FROM h",
    "k_enclosing": f"WITH {_LINES}, a AS (SELECT fe.note_id, last_value(h.slug IGNORE NULLS) OVER (PARTITION BY fe.note_id ORDER BY fe.line) AS anchor FROM fe LEFT JOIN h ON h.note_id = fe.note_id AND h.line = fe.line) SELECT note_id, anchor, count(*) AS n_lines FROM a WHERE anchor IS NOT NULL GROUP BY ALL",
    "k_body_links": r"""WITH f AS (SELECT DISTINCT ON (note_id) * FROM note_files), l AS (SELECT note_id, regexp_replace(regexp_replace(unnest(regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)), '[|#].*$', '', 's'), '^\s+|\s+$', '', 'g') AS target FROM f)
SELECT note_id, target, count(*) AS n FROM l WHERE target <> '' GROUP BY ALL""",
    "k_slugs": r"""SELECT note_id, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  array_to_string(list_transform(list_filter(string_split(basename, '-'), lambda w: w <> ''), lambda w: upper(w[1:1]) || w[2:]), ' ') AS name,
  coalesce(split_part(path, '/', 1) = 'wiki' AND len(string_split(path, '/')) = 3 AND split_part(path, '/', 3) = split_part(path, '/', 2) || '-moc.md', false) AS moc,
  CASE WHEN len(string_split(path, '/')) >= 3 AND split_part(path, '/', 1) = 'wiki' THEN split_part(path, '/', 2) END AS domain FROM (SELECT DISTINCT ON (note_id) * FROM parsed_notes) WHERE title IS NOT NULL""",
    "k_digests": rf"""SELECT note_id, sha256(body) AS source_digest, sha256(regexp_replace(array_to_string(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: regexp_replace(x, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{85}}\x{{2028}}\x{{2029}}\x{{1680}}]+$', '')), chr(10)), '\n+$', '') || chr(10)) AS content_sha256,
  (length(regexp_replace(body, '[^{X.CJK_CLASS}]', '', 'g')) + ceil(strlen(regexp_replace(body, '[{X.CJK_CLASS}]', '', 'g')) / 4.0))::BIGINT AS est_tokens FROM (SELECT DISTINCT ON (note_id) * FROM note_files) WHERE body IS NOT NULL""",
    "k_summaries": r"SELECT note_id, substring(trim(regexp_replace(body, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\x{85}\x{2028}\x{2029}\x{1680}]+', ' ', 'g')), 1, 240) AS excerpt FROM (SELECT DISTINCT ON (note_id) * FROM note_files) WHERE body IS NOT NULL",
    "k_edges": f"WITH {_N} SELECT * FROM edge",
    "k_indegrees": f"WITH {_N} SELECT dst AS note_id, count(*) AS indeg FROM link GROUP BY 1",
    "k_broken": f"WITH {_N} SELECT src AS note_id, target FROM keyed k WHERE target <> '' AND target NOT IN (SELECT target FROM known)",
    "k_same_names": f"WITH {_N} SELECT basename, count(DISTINCT path) AS n, min(path) AS first_path FROM n GROUP BY 1 HAVING count(DISTINCT path) > 1",
    "k_orphans": f"WITH {_N} SELECT basename FROM lone",
    "k_seeds": f"WITH {_N}, {_SEED} SELECT note_id, d FROM seed",
    "k_near_roots": f"WITH {_N}, {_SEED} SELECT note_id, d FROM dist WHERE d <= 2",
    "k_all_distances": f"""WITH RECURSIVE {_N}, w AS (SELECT note_id AS node, 0 AS d FROM n WHERE is_moc OR is_index UNION SELECT e.dst, w.d + 1 FROM w JOIN edge e ON e.src = w.node WHERE w.d < 30)
SELECT n.note_id AS node, coalesce(m.d, 1000000) AS d FROM n LEFT JOIN (SELECT node, min(d) AS d FROM w GROUP BY 1) m ON m.node = n.note_id""",
    "k_ego": f"""WITH {_N}, u AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge), g0 AS (SELECT DISTINCT src AS node, 0 AS d FROM u WHERE src = 10), g1 AS (SELECT node, min(d) AS d FROM (SELECT * FROM g0 UNION ALL SELECT u.dst, d + 1 FROM g0 JOIN u ON u.src = node) GROUP BY 1),
g2 AS (SELECT node, min(d) AS d FROM (SELECT * FROM g1 UNION ALL SELECT u.dst, d + 1 FROM g1 JOIN u ON u.src = node) GROUP BY 1) SELECT node, d FROM g2""",
    "k_ego_edges": f"""WITH {_N}, u AS (SELECT src, dst FROM edge UNION SELECT dst, src FROM edge), g0 AS (SELECT DISTINCT src AS node FROM u WHERE src = 10), g1 AS (SELECT node FROM g0 UNION SELECT u.dst FROM g0 JOIN u ON u.src = node),
g2 AS (SELECT node FROM g1 UNION SELECT u.dst FROM g1 JOIN u ON u.src = node) SELECT src, dst FROM edge WHERE src IN (SELECT node FROM g2) AND dst IN (SELECT node FROM g2)""",
    "k_totals": f"WITH {_N} SELECT (SELECT count(*) FROM n) AS node_total, (SELECT count(*) FROM edge) AS edge_total, (SELECT count(*) > 500 FROM n) AS truncated",
    "k_children": f"WITH {_N} SELECT DISTINCT string_split(path, '/')[2] AS domain, basename AS child FROM n WHERE type = 'theme'",
    "k_stats": f"WITH {_N}, {_T} SELECT count(*) AS n, {', '.join(f'round_even(avg(len(f{i})), 6) AS avg{i}' for i in range(6))} FROM tk",
    "k_document_frequency": f"WITH {_N}, {_T} SELECT token, count(*) AS df FROM (SELECT DISTINCT note_id, unnest(flatten([f0, f1, f2, f3, f4, f5])) AS token FROM tk) GROUP BY 1",
    "k_lexical": f"WITH {_N}, {_T}, {_Q}, {_LEX} SELECT qid, note_id, lex, top FROM lex",
    "k_rank": f"WITH {_N}, {_T}, {_Q}, {_LEX}, {_RANK} SELECT qid, pos, note_id, path, ['linked-theme', 'heading', 'lexical'][reason + 1] AS match_reason, score FROM rk WHERE pos <= 20 AND best >= 0.18",
    "k_pack_scores": f"WITH RECURSIVE {_N}, {_SEED}, {_PACK} SELECT note_id, score, tokens FROM pk",
    "k_pack": f"WITH RECURSIVE {_N}, {_SEED}, {_PACK}, {_FILL} SELECT pos, note_id, score, tokens FROM pack",
    "k_pack_text": f"""WITH RECURSIVE {_N}, {_SEED}, {_PACK}, {_FILL}, x AS (SELECT '<!-- kb:pack repo=kb pack=main commit=v1 -->' || chr(10) || '# gold: main' || chr(10) || '> Derived context pack of `v1`; rebuildable, do not edit.' || chr(10) || chr(10)
  || string_agg(line || chr(10), '' ORDER BY pos) || chr(10) || '<!-- kb:pack:end repo=kb pack=main commit=v1 -->' || chr(10) AS text, count(*)::INT AS note_count FROM pack)
SELECT text, note_count, (length(regexp_replace(text, '[^{X.CJK_CLASS}]', '', 'g')) + ceil(strlen(regexp_replace(text, '[{X.CJK_CLASS}]', '', 'g')) / 4.0))::BIGINT AS est_tokens FROM x""",
    "k_near_lines": rf"""WITH RECURSIVE {_N}, {_SEED}, {_PACK}, {_FILL}, sh AS (SELECT note_id, note_id IN (SELECT note_id FROM pack) AS inside, list_distinct(CASE WHEN length(l) <= 8 THEN [l] ELSE list_transform(range(1, length(l) - 6), lambda i: l[i:i+7]) END) AS s
  FROM (SELECT note_id, lower(trim(regexp_replace(line, '[\s\x{{a0}}\x{{2000}}-\x{{200a}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g'))) AS l FROM pk)),
c AS (SELECT note_id, len(s) AS n, unnest(s) AS k FROM sh WHERE NOT inside), p AS (SELECT note_id, len(s) AS n, unnest(s) AS k FROM sh WHERE inside),
m AS (SELECT c.note_id, p.note_id AS pid, any_value(c.n) AS a, any_value(p.n) AS b, count(*) AS n FROM c JOIN p USING (k) GROUP BY ALL) SELECT DISTINCT note_id AS id FROM m WHERE n >= 0.4 * (a + b - n)""",
    "k_share": f"""WITH RECURSIVE {_N}, {_SEED}, {_PACK}, o AS (SELECT *, contains(path, '/home-lab/') OR contains(path, '/reading/') AS own FROM pk), t AS (SELECT count(*) AS t, count(*) FILTER (own) AS h FROM o),
r AS (SELECT o.*, row_number() OVER (PARTITION BY own ORDER BY score DESC, path) AS r FROM o) SELECT note_id, own FROM r, t WHERE NOT own OR r <= floor((t - h) * 0.05 / 0.95 + 1e-9)""",
    "k_health": f"""WITH {_N}, {_LINT} SELECT count(*) AS note_total, count(*) FILTER (type = 'theme') AS themes, count(*) FILTER (type = 'daily') AS dailies, {", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in lint.STATUSES)},
  (SELECT count(*) FROM lone) AS orphans, (SELECT count(*) FROM (SELECT DISTINCT path, target FROM keyed WHERE target <> '' AND target NOT IN (SELECT target FROM known))) AS broken_links,
  (SELECT count(*) FROM found) AS lint_findings, (SELECT count(*) FILTER (severity = 'error') = 0 FROM found) AS lint_ok,
  (SELECT map_from_entries(list({{'k': tag, 'v': c}} ORDER BY tag)) FROM (SELECT tag, count(*) AS c FROM (SELECT unnest(tags) AS tag FROM n) GROUP BY 1)) AS tag_distribution FROM n""",
    "k_lint": f"WITH {_N}, {_LINT} SELECT code, severity, path, message FROM found",
    "k_tags": f"WITH {_N} SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM n) GROUP BY 1",
    "k_snapshot_diff": """WITH f AS (SELECT DISTINCT ON (note_id) note_id, sha256(body) AS digest, first_seen, removed_at FROM note_files),
a AS (SELECT * FROM f WHERE first_seen <= TIMESTAMP '2024-09-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2024-09-01')), b AS (SELECT * FROM f WHERE first_seen <= TIMESTAMP '2025-03-01' AND (removed_at IS NULL OR removed_at > TIMESTAMP '2025-03-01'))
SELECT coalesce(a.note_id, b.note_id) AS note_id, CASE WHEN a.note_id IS NULL THEN 'added' WHEN b.note_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.note_id = b.note_id WHERE (a.note_id IS NULL AND b.digest IS NOT NULL) OR (b.note_id IS NULL AND a.digest IS NOT NULL) OR a.digest <> b.digest""",
    "k_stored_hits": "SELECT query_id, hit_id, r, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, hit_id)::INT AS r FROM (SELECT DISTINCT ON (hit_id) * FROM search_hits)) WHERE r <= 3",
}
