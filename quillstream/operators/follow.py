"""Memory files whose list items point to other files: the pointed-to text becomes the fact, and no pointer is ever lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.harvest import MAX_FACT_BYTES

#: Facts of a scan and links it tries to follow.
MAX_FACTS, MAX_FOLLOWED = 512, 64
_LINK = r"(?<!!)\[([^\]\n]*)\]\(([^)\n]*)\)"


def local_path(raw: Column) -> Column:
    """The relative markdown path of a link's destination, null for a scheme, an absolute or home path, escapes, dot files and other kinds."""
    p = X.trim(raw)
    p = F.when(p.startswith("<"), F.when(p.contains(">"), X.trim(F.regexp_extract(p, r"^<([^>]*)>", 1)))).otherwise(F.regexp_extract(p, r"^(\S*)", 1))
    p = F.regexp_replace(p, r"[#?].*$", "")
    bad = (p == "") | p.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | p.rlike(r"^[/~]|[%\\]") | p.rlike(r"(^|/)\.[^/]*$") | ~F.lower(p).endswith(".md")
    return F.when(~bad, p)


def resolved(folder: Column, path: Column) -> Column:
    """A relative path below a folder with . and .. taken out; null if it climbs out of the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, path), "/"), lambda p: (p != "") & (p != "."))
    start = F.array().cast("array<string>")
    walk = F.aggregate(parts, start, lambda a, p: F.when(a.isNull(), a).when(p != "..", F.concat(a, F.array(p))).when(F.size(a) == 0, F.lit(None).cast("array<string>")).otherwise(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))))
    return F.array_join(walk, "/")


def gloss(block: Column) -> Column:
    """A block's own words: without links and a leading list mark; empty when only marks are left."""
    text = X.collapse(F.regexp_replace(F.regexp_replace(block, _LINK, ""), r"^(?:[-*+]|\d+[.)])[ \t]+", ""), 1_000_000)
    return F.when(text.rlike(r"[^ \-–—·:.\t]"), text).otherwise("")


def bare(text: Column) -> Column:
    """Without a closed frontmatter block, by lines alone, and without line feeds at the ends."""
    plain = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(plain, r"(?s)\A(?:[ \t]*\n)*[ \t]*---[ \t]*\n(?:.*?\n)??---[ \t]*(?:\n|\z)", ""), r"\A\n+|\n+\z", "")


def titled(body: Column) -> Column:
    """Whether a body opens with a heading of level 1, in either style."""
    return body.rlike(r"\A\n*(?:#[ \t]+\S|[^\n]*\S[^\n]*\n=+[ \t]*(?:\n|\z))")


def followed_facts(blocks: DataFrame, files: DataFrame, max_facts: int = MAX_FACTS, max_followed: int = MAX_FOLLOWED, max_bytes: int = MAX_FACT_BYTES) -> tuple[DataFrame, DataFrame]:
    """Facts (path, block_no, pos, text, fact_key, followed) in order, and notes (path, block_no, note) of what was not done.

    blocks: path, block_no, block. files: path, text. Each local link of a block gives the linked file's body, under its
    own title or the link's text and the block's own words; the block itself is kept too if it has no link or any was not
    followed. A scan is bounded by its caps, which the notes name: rows past max_facts and links past max_followed.
    """
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    found = F.transform(F.regexp_extract_all("block", F.lit(_LINK), 0), lambda m: F.struct(X.trim(F.regexp_extract(m, _LINK, 1)).alias("shown"), local_path(F.regexp_extract(m, _LINK, 2)).alias("rel")))
    kept = F.filter(found, lambda x: x.rel.isNotNull())
    first = F.filter(kept, lambda x, i: F.array_position(F.transform(kept, lambda y: y.rel), x.rel) == i + 1)
    own = blocks.select("path", "block_no", "block", first.alias("links"))
    links = own.select("path", "block_no", "block", F.posexplode("links").alias("pos", "link")).select("path", "block_no", "block", "pos", "link.shown", "link.rel", resolved(folder, F.col("link.rel")).alias("to"))
    # a scan's links are few, and their order is one
    tried = links.withColumn("try", F.row_number().over(Window.orderBy("path", "block_no", "pos")))
    seen = tried.join(files.select(F.col("path").alias("to"), F.col("text").alias("theirs")).dropDuplicates(["to"]), "to", "left")
    body = bare(F.col("theirs"))
    why = F.when(F.col("try") > max_followed, "reached the number of links to follow").when(F.col("theirs").isNull(), "no such file").when(X.trim(X.without_spans(body)) == "", "the file is empty")
    seen = seen.withColumn("why", why)
    whole = F.concat_ws("\n\n", F.when(~titled(body) & (F.col("shown") != ""), F.concat(F.lit("# "), "shown")), F.when(gloss(F.col("block")) != "", F.concat(F.lit("> "), gloss(F.col("block")))), body)
    theirs = seen.where("why is null").select("path", "block_no", "pos", whole.alias("raw"), body.alias("key"), F.lit(True).alias("followed"))
    missed = seen.groupBy("path", "block_no").agg(F.max(F.col("why").isNotNull()).alias("missed"))
    plain = own.join(missed, ["path", "block_no"], "left").where("missed is null or missed").select("path", "block_no", F.lit(1 << 30).alias("pos"), F.col("block").alias("raw"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("followed"))
    text = X.trim(X.without_spans(F.col("raw")))
    facts = theirs.unionByName(plain).withColumn("__t", text).where(~F.col("__t").rlike(r"\A(?:(?:[-*+]|\d+[.)])\s*)?\z"))
    facts = facts.withColumn("text", X.cut_utf8(F.col("__t"), F.lit(max_bytes))).withColumn("n", F.row_number().over(Window.orderBy("path", "block_no", "pos")))
    key = X.content_sha(F.coalesce(X.trim(X.without_spans(F.col("key"))), F.col("text")))
    notes = seen.where("why is not null").select("path", "block_no", F.concat(F.lit("link "), "rel", F.lit(" not followed: "), "why").alias("note"))
    notes = notes.unionByName(facts.where(F.col("n") > max_facts).select("path", "block_no", F.lit("past the number of facts of a scan").alias("note")))
    notes = notes.unionByName(facts.where(F.octet_length("__t") > max_bytes).select("path", "block_no", F.lit("cut to the size of a fact").alias("note")))
    return facts.where(F.col("n") <= max_facts).select("path", "block_no", "pos", F.rtrim("text").alias("text"), key.alias("fact_key"), "followed"), notes


def scan_digest(files: DataFrame) -> DataFrame:
    """One row: digest of a scan's files (path, text), equal when nothing changed."""
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("path", F.lit(":"), F.sha2("text", 256)))), "\n"), 256).alias("digest"))
