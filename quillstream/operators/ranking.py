"""Field-weighted lexical ranking combined with distance and in-degree in the link graph.

Everything that does not depend on a question (token lengths, in-degrees, distances per entry point) is one pass over
the corpus; a batch of questions is answered in one plan. Only tokens of the questions survive the explode of the
corpus's tokens, so what is shuffled grows with the matches, not with the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.notes import composed, link_labels, links
from quillstream.session import cut, small, written

# Fixed values of the scoring contract.
K1, B, PIVOT = 1.2, 0.75, 1.5
FIELDS = (("title", 3.0, B), ("aliases", 3.0, 0.0), ("tags", 2.5, B), ("headings", 2.0, B), ("summary", 2.0, B), ("body", 1.0, B))
W_LEX, W_STRUCT, ALPHA, BETA = 0.65, 0.35, 0.7, 0.3
MAX_HOPS, FLOOR, MAX_HITS = 2, 0.18, 20
BOOST = {"active": 0.10, "deprecated": -0.15}
REASONS = ("linked-theme", "heading", "lexical")
#: Questions of one batch: their tokens are sent to all workers.
MAX_QUESTIONS = 10_000


def field_tokens(notes: DataFrame) -> DataFrame:
    """note_id and one array of tokens per field (f0 to f5, in the fields' order), of composed texts."""
    listed = lambda c: F.coalesce(X.tag_tokens(c), F.array().cast("array<string>"))
    texts = notes.select(
        "note_id",
        F.coalesce(F.col("title"), F.replace("basename", F.lit("-"), F.lit(" "))).alias("f0"),
        F.get_json_object("frontmatter", "$.aliases").alias("f1"),
        F.array_join("tags", "\n").alias("f2"),
        F.array_join(F.transform("headings", lambda h: h.text), "\n").alias("f3"),
        F.get_json_object("frontmatter", "$.summary").alias("f4"),
        X.labels(F.array_join("body_lines", "\n")).alias("f5"),
    )
    texts = composed(texts, *(f"f{i}" for i in range(len(FIELDS))))
    as_tokens = {f"f{i}": X.tokens(F.coalesce(f"f{i}", F.lit(""))) for i in (0, 3, 4, 5)}
    return texts.withColumns(as_tokens | {"f1": listed(F.from_json("f1", "array<string>")), "f2": listed(F.when(F.col("f2") != "", F.split("f2", "\n")))})


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: n, and the average length of every field."""
    return tokens.agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.size(f"f{i}")).alias(f"avg{i}") for i in range(len(FIELDS))))


def question_tokens(questions: DataFrame) -> DataFrame:
    """qid, token: distinct tokens of each question (qid, question)."""
    return questions.select("qid", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("token"))


def occurrences(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """note_id, token, tf0 to tf5, len0 to len5: counts of the wanted tokens (a small frame) per note and field."""
    lengths = [F.size(f"f{i}").alias(f"len{i}") for i in range(len(FIELDS))]

    def marked(i: int) -> Column:
        return F.transform(f"f{i}", lambda t: F.struct(t.alias("token"), F.lit(i).alias("f")))

    pairs = F.flatten(F.array(*map(marked, range(len(FIELDS)))))
    hits = tokens.select("note_id", *lengths, F.explode(pairs).alias("p")).select("note_id", F.col("p.token").alias("token"), F.col("p.f").alias("f"), *(f"len{i}" for i in range(len(FIELDS))))
    kept = hits.join(small(wanted.select("token").distinct()), "token", "left_semi")
    return kept.groupBy("note_id", "token", *(f"len{i}" for i in range(len(FIELDS)))).agg(*(F.count_if(F.col("f") == i).alias(f"tf{i}") for i in range(len(FIELDS))))


def lexical(tokens: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, note_id, raw, lex, and top: the field of the matched token with the highest idf (ties: the fields' order)."""
    hits = cut(occurrences(tokens, wanted))
    stats = corpus_stats(tokens)
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = F.col("n")
    idf = F.greatest(F.lit(0.0), F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    idfs = df.join(F.broadcast(stats), how="inner").withColumn("idf", idf)  # one row of statistics
    scored = hits.join(small(idfs), "token")
    ftd = F.lit(0.0)
    for i, (_, weight, b) in enumerate(FIELDS):
        norm = F.when(F.col(f"avg{i}") == 0, 1.0).otherwise(1 - b + b * F.col(f"len{i}") / F.when(F.col(f"avg{i}") == 0, 1.0).otherwise(F.col(f"avg{i}")))
        ftd = ftd + F.lit(weight) * F.col(f"tf{i}") / norm
    scored = scored.withColumn("ftd", ftd).withColumn("part", F.col("idf") * F.col("ftd") * (K1 + 1) / (F.col("ftd") + K1))
    field = F.coalesce(*(F.when(F.col(f"tf{i}") > 0, i) for i in range(len(FIELDS))))
    matched = scored.withColumn("field", field).join(small(wanted), "token")
    summed = matched.groupBy("qid", "note_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("token", "part"))), F.lit(0.0), lambda a, x: a + x.part).alias("raw"),
        F.min(F.struct((-F.col("idf")).alias("i"), "field", "token")).alias("best"),
    )
    return summed.select("qid", "note_id", "raw", F.bround(F.col("raw") / (F.col("raw") + PIVOT), 6).alias("lex"), F.col("best.field").alias("top"), F.col("best.token").alias("top_token"))


def indegrees(links: DataFrame) -> DataFrame:
    """note_id, indeg."""
    return links.groupBy(F.col("dst").alias("note_id")).agg(F.count(F.lit(1)).alias("indeg"))


def seed_distances(notes: DataFrame, links: DataFrame) -> DataFrame:
    """note_id, d: 0 for entry pages of domains and what they link to, 1 for the index and what it links to."""
    roots = notes.where("is_moc or is_index").select(F.col("note_id").alias("src"), F.when(F.col("is_moc"), 0).otherwise(1).alias("d"))
    reached = links.join(roots, "src").select(F.col("dst").alias("note_id"), "d")
    return roots.select(F.col("src").alias("note_id"), "d").union(reached).groupBy("note_id").agg(F.min("d").alias("d"))


def focus(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """qid, scope of questions (qid, token) that name a domain: that of the first entry page, by path, all of whose domain's tokens are asked for."""
    pages = notes.where("is_moc").select("path", X.path_domain(F.col("path")).alias("scope")).where("scope is not null")
    parts = pages.select("path", "scope", F.array_distinct(X.tokens(F.col("scope"))).alias("t")).select("path", "scope", F.size("t").alias("n"), F.explode("t").alias("token"))
    named = parts.join(wanted, "token").groupBy("qid", "path", "scope", "n").agg(F.count(F.lit(1)).alias("c")).where("c = n")
    return named.groupBy("qid").agg(F.min(F.struct("path", "scope")).alias("m")).select("qid", "m.scope")


def scoped_seeds(notes: DataFrame, links: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope, note_id, d, words: seeds of all entry pages (scope '') and of those of each domain asked for (scope); words: tokens that entry pages show for it."""
    pages = notes.where("is_moc or is_index").select(F.col("note_id").alias("src"), F.when(F.col("is_moc"), 0).otherwise(1).alias("d"), X.path_domain(F.col("path")).alias("domain"))
    inside = pages.where("d = 0").join(scopes, F.col("domain") == F.col("scope")).select("scope", "src", "d")
    index = pages.where("d = 1").withColumn("one", F.lit(1)).join(scopes.withColumn("one", F.lit(1)), "one").select("scope", "src", "d")  # one page at most
    roots = cut(pages.select(F.lit("").alias("scope"), "src", "d").unionByName(inside).unionByName(index))
    none = F.array().cast("array<string>")
    reached = roots.join(links, "src").select("scope", F.col("dst").alias("note_id"), "d")
    ends = roots.select("scope", F.col("src").alias("note_id"), "d").unionByName(reached).groupBy("scope", "note_id").agg(F.min("d").alias("d"))
    names = notes.groupBy("basename").agg(F.max(F.struct("path", "note_id")).alias("m")).select(F.col("basename").alias("target"), F.col("m.note_id").alias("note_id"))
    shown = link_labels(notes.where("is_moc")).join(roots.where("d = 0"), "src").join(names, "target").select("scope", "note_id", F.explode("words").alias("w")).groupBy("scope", "note_id").agg(F.collect_set("w").alias("words"))
    return ends.join(shown, ["scope", "note_id"], "left").select("scope", "note_id", "d", F.coalesce("words", none).alias("words"))


def bounded_distances(seeds: DataFrame, links: DataFrame, hops: int = MAX_HOPS, by: tuple[str, ...] = ()) -> DataFrame:
    """note_id, d (at most hops) of what is reached from seeds along links; of each group of seeds by itself, if by names columns."""
    reached = seeds.select(*by, "note_id", "d")
    for _ in range(hops):
        step = reached.where(F.col("d") < hops).join(links, F.col("note_id") == F.col("src")).select(*by, F.col("dst").alias("note_id"), (F.col("d") + 1).alias("d"))
        reached = reached.union(step).groupBy(*by, "note_id").agg(F.min("d").alias("d"))
    return reached.where(F.col("d") <= hops)


def structural(d: Column, indeg: Column, most: Column, digits: int | None = 6) -> Column:
    """Of distance and in-degree; rounded for questions, whole (digits None) for packs."""
    score = ALPHA / (1 + d) + BETA * indeg / F.greatest(F.lit(1), most)
    return score if digits is None else F.bround(score, digits)


def rank(notes: DataFrame, questions: DataFrame, limit: int = MAX_HITS, floor: float = FLOOR) -> DataFrame:
    """qid, pos, note_id, path, anchor, line, excerpt, match_reason, score: the best hits of every question.

    The corpus's tokens and links are written once and read by the steps that need them. A question without tokens, without an eligible note or whose best score is below the floor has no row. notes is a
    corpus view; questions (qid, question) are at most MAX_QUESTIONS. Ties are broken by reason, lexical score,
    in-degree, then path and id.
    """
    wanted = cut(question_tokens(questions))
    tokens = written(field_tokens(notes))
    found = cut(links(notes))
    lex = lexical(tokens, wanted)
    degrees = indegrees(found)
    scopes = cut(focus(notes, wanted))
    seeds = cut(scoped_seeds(notes, found, scopes.select("scope").distinct()))
    distances = bounded_distances(seeds, found, by=("scope",))
    most = degrees.agg(F.coalesce(F.max("indeg"), F.lit(0)).alias("most"))
    theme = tokens.select("note_id", F.array_distinct(F.concat("f0", "f1", "f2")).alias("theme"))
    asked = wanted.groupBy("qid").agg(F.collect_set("token").alias("q")).join(scopes, "qid", "left").withColumn("scope", F.coalesce("scope", F.lit("")))
    joined = (
        lex.join(degrees, "note_id", "left")
        .join(F.broadcast(most), how="inner")  # one row
        .join(theme, "note_id")
        .join(small(cut(asked)), "qid")
        .join(distances, ["scope", "note_id"], "left")
        .join(seeds.where("d = 0").select("scope", "note_id", "words"), ["scope", "note_id"], "left")
        .join(notes.select("note_id", "path", "status"), "note_id")
        .withColumns({"indeg": F.coalesce("indeg", F.lit(0)), "d": F.coalesce("d", F.lit(MAX_HOPS + 1)), "linked": F.arrays_overlap("theme", "q") | F.coalesce(F.arrays_overlap("words", "q"), F.lit(False))})
    )
    boost = F.lit(0.0)
    for status, value in BOOST.items():
        boost = F.when(F.col("status") == status, value).otherwise(boost)
    mixed = W_LEX * F.col("lex") + W_STRUCT * structural(F.col("d"), F.col("indeg"), F.col("most")) + boost
    scored = joined.withColumn("score", F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mixed)), 6)).where((F.col("lex") > 0) | ((F.col("d") == 0) & F.col("linked")))
    reason = F.when((F.col("d") == 0) & F.col("linked"), 0).when(F.col("top").isin(0, 3), 1).otherwise(2)
    ranked = scored.withColumn("reason", reason)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "reason", F.desc("lex"), F.desc("indeg"), "path", "note_id")
    top = ranked.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit)
    best = F.max("score").over(Window.partitionBy("qid"))
    # texts are joined to the hits that are left, MAX_HITS of each of MAX_QUESTIONS at most
    hits = cut(top.withColumn("best", best).where(F.col("best") >= floor).select("qid", "pos", "note_id", "reason", "top_token", "score"))
    kept = notes.select("note_id", "path", "title", "title_line", "headings", "body_lines").join(F.broadcast(hits), "note_id")
    token = F.col("top_token")
    head = F.get(F.filter("headings", lambda h: F.array_contains(X.tokens(h.text), token)), F.lit(0))
    place = F.array_position(F.transform("body_lines", lambda x: F.array_contains(X.tokens(X.labels(x)), token)), F.lit(True)).cast("int")
    above = F.try_element_at(F.filter("headings", lambda h: h.line <= place), F.lit(-1))
    line = F.when(F.col("reason") == 0, F.coalesce("title_line", F.lit(1))).when((F.col("reason") == 1) & head.isNotNull(), head.line).when(place > 0, place).otherwise(F.coalesce("title_line", F.lit(1)))
    anchor = F.when(F.col("reason") == 0, "").when((F.col("reason") == 1) & head.isNotNull(), head.slug).when(place > 0, F.coalesce(above.slug, F.lit(""))).otherwise("")
    shown = F.when(F.col("reason") == 0, F.col("title")).when((F.col("reason") == 1) & head.isNotNull(), head.text).when(place > 0, X.window_excerpt(X.labels(F.get("body_lines", F.greatest(place, F.lit(1)) - 1)), token)).otherwise(F.col("title"))
    names = F.array(*(F.lit(r) for r in REASONS))
    return kept.select("qid", "pos", "note_id", "path", F.coalesce(anchor, F.lit("")).alias("anchor"), line.alias("line"), X.collapse(shown).alias("excerpt"), F.get(names, F.col("reason")).alias("match_reason"), "score")


def questions_frame(spark: SparkSession, asked: list[str]) -> DataFrame:
    """qid, question of a list of questions."""
    if len(asked) > MAX_QUESTIONS:
        raise ValueError(f"at most {MAX_QUESTIONS} questions")
    rows = [spark.range(1).select(F.lit(i).alias("qid"), F.lit(q).alias("question")) for i, q in enumerate(asked)]
    return reduce(DataFrame.union, rows)
