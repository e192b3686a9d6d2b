"""Queries of the text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import bpe, confusables, languages, neardup, packing, pii
from quillstream.session import table


def _near(spark: SparkSession, d: str) -> neardup.NearDuplicates:
    return neardup.near_duplicates(neardup.kb_fields(table(spark, d, "note_files"), table(spark, d, "parsed_notes"), table(spark, d, "author_regions")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.all_pairs(_near(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(_near(spark, d))


def _personal(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, t) for t in ("turns", "author_regions", "extracted_docs", "given_names")]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.kb_found(*_personal(spark, d))


def p4_masked(spark: SparkSession, d: str) -> DataFrame:
    return pii.kb_masked(*_personal(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.changed_fields(table(spark, d, "parsed_notes"), table(spark, d, "search_hits"))


def p5_unified(spark: SparkSession, d: str) -> DataFrame:
    return confusables.unified_fields(table(spark, d, "parsed_notes"), table(spark, d, "search_hits"))


def p5_alike(spark: SparkSession, d: str) -> DataFrame:
    """Groups of excerpts, titles and single body lines that look alike but differ in their characters."""
    notes = table(spark, d, "parsed_notes")
    rows = [f.select("rec_id", "text") for f in confusables.text_fields(notes, table(spark, d, "search_hits"))]
    lines = notes.select(F.col("note_id").alias("rec_id"), F.explode("body_lines").alias("text"))
    return confusables.alike_groups(rows[0].unionByName(rows[2]).unionByName(lines), "rec_id", "text")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents").select("doc_id", "text"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = bpe.count_tokens(table(spark, d, "documents").select("doc_id", "text"))
    return packing.pack(sizes, "doc_id", "n_tokens").withColumnRenamed("item_id", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """containers, items, tokens, unused share."""
    packed = p7_packed(spark, d)
    per = packed.groupBy("container").agg(F.count(F.lit(1)).alias("items"), F.sum("size").alias("tokens"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (1 - F.sum("tokens") / (F.count(F.lit(1)) * 2048)).alias("unused"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.mislabelled(languages.languages(table(spark, d, "documents")))


def p8_languages(spark: SparkSession, d: str) -> DataFrame:
    return languages.languages(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p3_groups, p4_found, p4_masked, p5_found, p5_unified, p5_alike, p6_ids, p7_packed, p7_fill, p8_found, p8_languages)}


# Stated apart from the operator: invisible characters, blanks, full-width and styled forms, parts of syllables and accents; letters of other scripts.
_ODD = (
    r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{e0100}-\x{e01ef}"
    r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{ff01}-\x{ffee}\x{2102}\x{210a}-\x{2113}\x{2115}\x{2119}-\x{211d}\x{2124}\x{2128}\x{212c}\x{212d}"
    r"\x{212f}-\x{2131}\x{2133}\x{2134}\x{2145}-\x{2149}\x{1d400}-\x{1d7ff}\x{1100}-\x{11ff}\x{a960}-\x{a97f}\x{d7b0}-\x{d7ff}\x{300}-\x{36f}]"
)
_OTHER_SCRIPT = r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}\p{Lisu}]"
_PLAIN = r"regexp_replace(x, '[\x{2190}-\x{27bf}\x{1f000}-\x{1faff}]\x{fe0f}?(\x{200d}[\x{2190}-\x{27bf}\x{1f000}-\x{1faff}]\x{fe0f}?)*', '', 'g')"
_CASE = rf"regexp_matches({_PLAIN}, '{_ODD}|\p{{Latin}}[\p{{L}}\p{{M}}]*{_OTHER_SCRIPT}|{_OTHER_SCRIPT}[\p{{L}}\p{{M}}]*\p{{Latin}}')"

SQL: dict[str, str] = {
    "p3_found": r"""WITH t AS (SELECT DISTINCT 'body' AS field, note_id AS id, body AS text FROM note_files UNION SELECT DISTINCT 'title', note_id, title FROM parsed_notes UNION SELECT DISTINCT 'source_text', region_no, source_text FROM author_regions),
v AS (SELECT field, id, word, count(*) AS c FROM (SELECT field, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS word FROM t) GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, sum(c) OVER (PARTITION BY field, id) AS n FROM v) WHERE n >= 5),
p AS (SELECT a.field, a.id AS id_a, b.id AS id_b, sum(least(a.c, b.c)) AS o, any_value(a.n + b.n) AS s FROM k a JOIN k b ON a.field = b.field AND a.word = b.word AND a.id < b.id GROUP BY ALL)
SELECT field, id_a, id_b FROM p WHERE 10 * o >= 7 * (s - o)""",
    "p5_found": f"""WITH t AS (SELECT 'title' AS field, note_id AS rec_id, title AS x FROM parsed_notes UNION ALL SELECT 'body_lines', note_id, array_to_string(body_lines, chr(10)) FROM parsed_notes UNION ALL SELECT 'excerpt', hit_id, excerpt FROM search_hits)
SELECT DISTINCT field, rec_id FROM t WHERE {_CASE}""",
}
