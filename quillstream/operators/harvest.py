"""From transcripts and memory files to facts: turns, salience, paragraphs, redaction, keys and cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import redact as R
from quillstream.functions import text as X

# Fixed value: phrases that mark a paragraph worth keeping.
SALIENCE = (
    r"(?i)(?:\bTIL\b|today i learned|lessons? learned|the lesson (?:here )?is|key lesson|\bgotchas?\b|key insight|the (?:key )?insight is|key takeaways?|the takeaway is|root[- ]cause|the culprit (?:was|is)|note to self|"
    r"worth remembering|for future reference|the (?:real )?fix (?:was|is|turned out)|the (?:real )?bug (?:was|is)|the trick (?:is|was)|the key (?:is|was) to|turns out that|i realized that|i realised that|the realization (?:was|is)|the decision (?:was|is) to|we decided to)"
)
MAX_FACT_BYTES = 4096


def transcript_turns(lines: DataFrame, text: str = "value") -> DataFrame:
    """file, pos, role, text, timestamp, tool_name of JSON transcript lines (file, pos, text).

    Records of type user or assistant with an object message count; a string content is one turn, of a list the text
    blocks are and tool calls become a summary; other blocks, blank and broken lines are dropped.
    """
    v = F.try_parse_json(F.col(text))
    get = lambda c, path, kind="string": F.try_variant_get(c, path, kind)
    rows = lines.withColumn("v", v).where(F.col("v").isNotNull() & get(F.col("v"), "$.type").isin("user", "assistant"))
    role = F.when(get(F.col("v"), "$.message.role").isin("user", "assistant"), get(F.col("v"), "$.message.role")).otherwise(get(F.col("v"), "$.type"))
    plain = rows.where(F.schema_of_variant(F.expr("try_variant_get(v, '$.message.content', 'variant')")) == "STRING").select(
        "file", "pos", F.lit(0).alias("sub"), role.alias("role"), get(F.col("v"), "$.message.content").alias("text"), get(F.col("v"), "$.timestamp").alias("timestamp"), F.lit(None).cast("string").alias("tool_name")
    )
    blocks = rows.withColumn("blocks", get(F.col("v"), "$.message.content", "array<variant>")).where("blocks is not null").select("file", "pos", role.alias("role"), get(F.col("v"), "$.timestamp").alias("timestamp"), F.posexplode("blocks").alias("sub", "b"))
    kind, name = get(F.col("b"), "$.type"), get(F.col("b"), "$.name")
    summary = F.concat(name, F.lit("("), F.substring(F.coalesce(F.to_json(F.expr("try_variant_get(b, '$.input', 'variant')")), F.lit("")), 1, 200), F.lit(")"))
    listed = blocks.where(kind.isin("text", "tool_use")).select("file", "pos", "sub", "role", F.when(kind == "text", get(F.col("b"), "$.text")).otherwise(summary).alias("text"), "timestamp", F.when(kind == "tool_use", name).alias("tool_name"))
    return plain.unionByName(listed).where("text is not null").select("file", "pos", "sub", "role", "text", "timestamp", "tool_name")


def paragraphs(turns: DataFrame, keys: list[str]) -> DataFrame:
    """keys, part, paragraph: blank-line paragraphs, trimmed, none empty."""
    parts = F.filter(F.transform(F.split("text", r"(?U)\n\s*\n"), X.trim), lambda p: p != "")
    return turns.select(*keys, F.posexplode(parts).alias("part", "paragraph"))


def salient(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Paragraphs of assistant turns with a marker phrase."""
    return paragraphs(turns.where("role = 'assistant'").where(F.col("text").rlike(SALIENCE)), keys).where(F.col("paragraph").rlike(SALIENCE))


def facts(paragraph_rows: DataFrame, prefix: str = "kb", classes: tuple[str, ...] = R.CLASSES) -> DataFrame:
    """Rows with text, fact_key and redaction_hits: markers dropped, secrets redacted, then cut and hashed."""
    plain = X.without_spans(F.col("paragraph"), prefix)
    rows = paragraph_rows.withColumn("__plain", plain).withColumn("__safe", R.redact(F.col("__plain"), classes))
    cut = rows.withColumn("text", X.cut_utf8(F.col("__safe"), F.lit(MAX_FACT_BYTES)))
    return cut.withColumn("fact_key", X.content_sha(F.col("text"))).withColumn("redaction_hits", R.hits(F.col("__safe"), F.col("__plain"), classes)).drop("__plain", "__safe", "paragraph")


def distinct_facts(fact_rows: DataFrame) -> DataFrame:
    """fact_key, n, first (least struct of file and pos) of every different fact; copies are counted before they meet."""
    return fact_rows.groupBy("fact_key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "pos")).alias("first")).select("fact_key", "n", F.col("first.file").alias("file"), F.col("first.pos").alias("pos"))


def segments(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, block_no, block of memory files: a top-level list item with its indented children is a block, so is a
    paragraph; headings end blocks and are none.

    A line's block starts at the last line that starts one: a list item, a line after a heading, or prose after a blank
    line or after a list item's end; a blank line belongs to an item only if the next line that is not blank is indented.
    """
    lines = files.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("n", "line"))
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("n")
    blank = F.trim(F.regexp_replace("line", r"(?U)\s", "")) == ""
    marked = lines.withColumns({"blank": blank, "head": F.col("line").rlike(X.HEADING), "item": F.col("line").rlike(r"^(?:[-*+]|\d+[.)])[ \t]+"), "indent": F.col("line").rlike(r"^[ \t]") & ~blank})
    ahead = F.first(F.when(~F.col("blank"), F.struct("indent", "head")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    behind = F.last(F.when(~F.col("blank"), F.struct("head", "item", "indent")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    around = marked.withColumns({"ahead": ahead, "behind": behind, "prev_blank": F.coalesce(F.lag("blank").over(w), F.lit(True))})
    opens = F.col("item") | F.col("head")  # an item's run: it and what is indented after it
    run = F.sum(F.when(opens | (~F.col("blank") & ~F.col("indent")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = around.withColumn("run", run)
    first_item = F.first("item").over(Window.partitionBy(key, "run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    runs = runs.withColumn("of_item", first_item)
    start = (
        F.when(F.col("head"), F.lit(True)).when(F.col("item"), F.lit(True)).when(F.col("blank"), F.lit(False))
        .when(F.col("of_item"), F.lit(False)).when(F.col("prev_blank") | F.col("behind").isNull() | F.col("behind.head"), F.lit(True))
        .otherwise(~F.col("indent") & F.coalesce(F.lag("of_item").over(w), F.lit(False)))
    )
    numbered = runs.withColumn("block_no", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    keep = ~F.col("head") & (~F.col("blank") | (F.col("of_item") & F.coalesce(F.col("ahead.indent"), F.lit(False))))
    out = numbered.where(keep).groupBy(key, "block_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s.line), "\n").alias("block"))
    return out.where(X.trim(F.col("block")) != "")


def cursor_totals(cursors: DataFrame) -> DataFrame:
    """connector, scans, proposed, accepted, rejected, redactions: each delivered cursor once."""
    rows = cursors.dropDuplicates(["cursor_id"])
    found = F.aggregate(F.coalesce(F.map_values("redacted"), F.array().cast("array<int>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.groupBy("connector").agg(F.count(F.lit(1)).alias("scans"), *(F.sum(c).alias(c) for c in ("proposed", "accepted", "rejected")), F.sum(found).alias("redactions"))


def unchanged_scans(cursors: DataFrame) -> DataFrame:
    """connector, source_path, n: scans whose content hash equals that of another scan of the same source."""
    rows = cursors.dropDuplicates(["cursor_id"]).where("last_content_sha256 is not null")
    return rows.groupBy("connector", "source_path", "last_content_sha256").agg(F.count(F.lit(1)).alias("c")).where("c > 1").groupBy("connector", "source_path").agg(F.sum(F.col("c") - 1).alias("n"))


def route(ext: Column, mime: Column) -> Column:
    """The extractor of an upload by extension, else by media type; null when unknown."""
    by_ext = F.when(ext.isin("md", "txt", "markdown"), "text").when(ext == "pdf", "pdf").when(ext.isin("docx", "xlsx", "pptx"), "office").when(ext.isin("html", "htm"), "url")
    by_mime = F.when(mime.startswith("text/html"), "url").when(mime.startswith("text/"), "text").when(mime == "application/pdf", "pdf").when(mime.startswith("application/vnd."), "office")
    return F.coalesce(by_ext, by_mime)
