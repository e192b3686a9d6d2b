"""Context packs: eligibility, scores, near-duplicate lines, and filling a token budget."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.session import cut

# Fixed values of the scoring contract.
W_STRUCT, W_RECENCY, W_BUCKET, W_PROVENANCE = 0.35, 0.25, 0.20, 0.20
HALF_LIFE_DAYS, SATURATION, SHARE_CAP, BUDGET, NEAR = 30.0, 5, 0.5, 2000, 0.6
BUCKETS = {"high": 1.0, "medium": 0.7, "low": 0.5}
#: Lines folded at a time.
BLOCK = 20_000


def recency(updated: Column, reference: str) -> Column:
    """Half for every HALF_LIFE_DAYS of age at the reference date; 0 without a date."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(reference).cast("date"), updated))
    return F.when(updated.isNull(), 0.0).otherwise(F.pow(F.lit(0.5), age / HALF_LIFE_DAYS))


def pack_score(structural: Column, updated: Column, confidence: Column, sources: Column, reference: str) -> Column:
    """Of structure, recency, confidence (absent: high) and number of sources, to 6 decimals."""
    bucket = reduce(lambda out, kv: F.when(confidence == kv[0], kv[1]).otherwise(out), BUCKETS.items(), F.lit(BUCKETS["high"]))
    return F.bround(W_STRUCT * structural + W_RECENCY * recency(updated, reference) + W_BUCKET * bucket + W_PROVENANCE * F.least(F.lit(1.0), sources / SATURATION), 6)


def harvested(frontmatter: str = "frontmatter") -> Column:
    """Whether a note's origin is a harvest, or all of its sources (one at least) are."""
    said = lambda k: F.get_json_object(frontmatter, f"$.{k}")
    theirs = F.from_json(said("sources"), "array<string>")
    only = (F.size(theirs) > 0) & F.forall(theirs, lambda s: F.lower(X.trim(s)).startswith("harvest:"))
    return F.coalesce(F.lower(X.trim(said("origin"))).startswith("harvest:"), F.lit(False)) | F.coalesce(only, F.lit(False))


def eligible(notes: DataFrame) -> DataFrame:
    """Active themes whose confidence is not low (absent: high) and that do not come from harvests alone."""
    low = F.lower(X.trim(F.coalesce(F.get_json_object("frontmatter", "$.confidence"), F.lit("high")))) == "low"
    return notes.where((F.col("type") == "theme") & (F.lower(X.trim(F.col("status"))) == "active") & ~low & ~harvested())


def last_date(frontmatter: str = "frontmatter") -> Column:
    """The first of updated, timestamp and created that is a date or instant, as a UTC instant."""
    return F.coalesce(*(F.try_to_timestamp(X.trim(F.get_json_object(frontmatter, f"$.{k}"))) for k in ("updated", "timestamp", "created")))


def line(title: Column, summary: Column, path: Column) -> Column:
    """The bullet of a note, with markers broken."""
    title, summary = X.neutral(X.collapse(title, 1_000_000)), X.neutral(X.collapse(F.coalesce(summary, F.lit("")), 1_000_000))
    return F.concat(F.lit("- **"), title, F.lit("**"), F.when(summary != "", F.concat(F.lit(" — "), summary)).otherwise(""), F.lit("  ["), path, F.lit("]"))


def frame(name: str, version: str, repo: str = "kb", prefix: str = "kb") -> tuple[str, str]:
    """Head and tail of a pack."""
    of = f"repo={repo} pack={name} commit={version}"
    return f"<!-- {prefix}:pack {of} -->\n# gold: {name}\n> Derived context pack of `{version}`; rebuildable, do not edit.\n\n", f"<!-- {prefix}:pack:end {of} -->\n"


def frame_cost(name: str, repo: str = "kb", prefix: str = "kb") -> int:
    """Estimated tokens of an empty pack's frame (plain ASCII), for a version of 40 digits."""
    return math.ceil(len("".join(frame(name, "0" * 40, repo, prefix)).encode()) / 4)


def pack_text(chosen: DataFrame, name: str, version: str, repo: str = "kb", prefix: str = "kb") -> DataFrame:
    """One row: text, note_count, est_tokens, inputs of a pack of chosen rows (pos, path, score, line, content_sha256), which a budget bounds."""
    head, tail = frame(name, version, repo, prefix)
    rows = F.array_sort(F.collect_list(F.struct("pos", "line", "path", "score", "content_sha256")))
    one = chosen.agg(rows.alias("r"))
    text = F.concat(F.lit(head), F.array_join(F.transform("r", lambda x: F.concat(x.line, F.lit("\n"))), ""), F.when(F.size("r") > 0, "\n").otherwise(""), F.lit(tail))
    meta = one.select(text.alias("text"), F.size("r").alias("note_count"), F.transform("r", lambda x: F.struct(x.path.alias("path"), x.content_sha256.alias("content_sha256"), x.score.alias("score"))).alias("inputs"))
    return meta.select("text", "note_count", X.token_estimate(F.col("text")).alias("est_tokens"), "inputs")


def pack_lines(packs: DataFrame) -> DataFrame:
    """line: the facts of pack texts (text), every line that begins a bullet once trimmed."""
    return packs.select(F.explode(F.split("text", "\n")).alias("line")).select(X.trim(F.col("line")).alias("line")).where(F.col("line").startswith("- "))


def capped_share(scored: DataFrame, harvested: str, share: float = SHARE_CAP) -> DataFrame:
    """Without the lowest harvest rows (score, path), as many as needed for them to be at most this share (below 1) of what is left."""
    if not 0 <= share < 1:
        raise ValueError("a share lies between 0 and 1")
    totals = scored.agg(F.count_if(F.col(harvested)).alias("h"), F.count(F.lit(1)).alias("t")).first()
    most = math.floor((totals.t - totals.h) * share / (1 - share) + 1e-9)
    if totals.h <= most:
        return scored
    low = scored.where(F.col(harvested)).select("score", "path").orderBy("score", F.desc("path")).limit(totals.h - most)
    return scored.join(low.select("path"), "path", "left_anti")


def fill_budget(scored: DataFrame, budget: int = BUDGET, spent: int = 0, block: int = BLOCK) -> DataFrame:
    """The rows (score, path, tokens and others) that fit beside what is spent, best first, skipping what is too long and going on.

    The fold is sequential, so it runs over a block of the best rows; the rows after it that are no longer than the room
    left are the next, until none is. The first row of a block always fits, so there are at most budget blocks.
    """
    rows = cut(scored.where(F.col("tokens") <= budget - spent))
    w = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "path", F.col("tokens").cast("long").alias("n"))))

    def fold(used: int) -> Column:
        start = F.struct(F.lit(used).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

        def step(a: Column, x: Column) -> Column:
            fits = a.used + x.n <= budget
            return F.struct(F.when(fits, a.used + x.n).otherwise(a.used).alias("used"), F.when(fits, F.concat(a.kept, F.array(x.path))).otherwise(a.kept).alias("kept"))

        return F.aggregate("rows", start, step)

    left, used, kept = rows, spent, []
    while True:
        best = left.orderBy(F.desc("score"), "path").limit(block)
        done = best.agg(w.alias("rows")).select(F.size("rows").alias("n"), F.try_element_at("rows", F.lit(-1)).alias("last"), fold(used).alias("f")).first()
        used, kept = done.f.used, kept + done.f.kept
        if done.n < block:
            break
        after = (F.col("score") < -done.last.o) | ((F.col("score") == -done.last.o) & (F.col("path") > done.last.path))
        left = rows.where(after & (F.col("tokens") <= budget - used))
    chosen = rows.sparkSession.createDataFrame(list(enumerate(kept)), "pos int, path string")
    return rows.join(F.broadcast(chosen), "path")


def near_lines(candidates: DataFrame, pack_lines: DataFrame, similarity: float = NEAR) -> DataFrame:
    """id of candidate lines (id, text) that a pack line (text) resembles: Jaccard of 8-character shingles.

    Shingles meet by equality and are counted per pair; no pair without a common shingle is formed.
    """
    a = candidates.select("id", X.shingles(F.col("text")).alias("s")).select("id", F.size("s").alias("na"), F.explode("s").alias("k"))
    b = pack_lines.select(F.monotonically_increasing_id().alias("pid"), X.shingles(F.col("text")).alias("s")).select("pid", F.size("s").alias("nb"), F.explode("s").alias("k"))
    both = a.join(b, "k").groupBy("id", "pid", "na", "nb").agg(F.count(F.lit(1)).alias("n"))
    return both.where(F.col("n") >= similarity * (F.col("na") + F.col("nb") - F.col("n"))).select("id").distinct()
