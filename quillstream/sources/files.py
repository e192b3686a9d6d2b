"""Files as tables: note vaults, transcripts and memory files; and a data source of memory facts."""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstream.operators.parsing import _json

FENCE = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"
#: Bounds of the connectors: files, bytes of one, facts of a scan.
MAX_FILES, MAX_BYTES, MAX_FACTS = 64, 1 << 20, 512
EXEMPT = ("AGENTS.md", "SCHEMA.md", "README.md", "log.md")


def read_notes(spark: SparkSession, root: str, strict: bool = False) -> DataFrame:
    """rel_path, basename, frontmatter (JSON), body, source_digest of every markdown file below root.

    A file without a readable fence has null frontmatter and its whole text as body; strict fails on it.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
    text = raw.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.sha2("content", 256).alias("source_digest"))
    rel = F.substring("path", F.lit(len(os.path.abspath(root)) + 2), F.length("path"))
    block = F.when(F.col("text").rlike(FENCE), F.regexp_extract("text", FENCE, 1))
    fenced = text.withColumn("__b", block)
    rows = fenced.withColumn("frontmatter", _json("__b")).drop("__b")
    body = F.when(F.col("frontmatter").isNotNull(), F.regexp_replace(F.regexp_replace("text", FENCE, ""), r"\A\n+|\n+\z", "")).otherwise(F.col("text"))
    rows = rows.select(rel.alias("rel_path"), F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.md$", "").alias("basename"), "frontmatter", body.alias("body"), "source_digest")
    rows = rows.where(~F.regexp_extract("rel_path", "([^/]+)$", 1).isin(*EXEMPT))
    return rows.withColumn("frontmatter", F.when(F.col("frontmatter").isNull(), F.raise_error(F.concat(F.lit("no frontmatter in "), "rel_path"))).otherwise(F.col("frontmatter"))) if strict else rows


def parse_missing(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files (rel_path, source_digest) whose parse is not cached under the same digest."""
    return files.join(cached.select("rel_path", "source_digest"), ["rel_path", "source_digest"], "left_anti")


def read_transcripts(spark: SparkSession, pattern: str) -> DataFrame:
    """file, pos, value: the lines of transcript files."""
    raw = spark.read.format("text").option("wholetext", "true").load(pattern).select(F.col("_metadata.file_path").alias("file"), "value")
    return raw.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "value")).where("value <> ''")


def memory_files(pattern: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[tuple[str, str]]]:
    """Files that a scan reads, in order of path, and those that it leaves out, each with the reason: a scan is bounded, and says by what."""
    found = sorted(p for p in glob.glob(os.path.expanduser(pattern), recursive=True) if os.path.isfile(p))
    large = [(p, "larger than a file may be") for p in found if os.path.getsize(p) > max_bytes]
    rest = [p for p in found if os.path.getsize(p) <= max_bytes]
    return rest[:max_files], large + [(p, "past the number of files of a scan") for p in rest[max_files:]]


def read_memory(spark: SparkSession, pattern: str, max_files: int = MAX_FILES, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """path, text, size of the files of a scan; and path, note of those left out."""
    paths, out = memory_files(pattern, max_files, max_bytes)
    notes = spark.createDataFrame(out, "path string, note string")
    if not paths:
        return spark.createDataFrame([], "path string, text string, size bigint"), notes
    raw = spark.read.format("binaryFile").load([*paths])
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.col("length").alias("size")), notes


class MemoryFacts(DataSource):
    """format("memory_facts").option("pattern", ...): paragraphs of memory files, one partition per file.

    Options maxFiles, maxBytes and maxFacts bound a scan; what is past them comes as rows with a note and no block.
    """

    @classmethod
    def name(cls) -> str:
        return "memory_facts"

    def schema(self) -> str:
        return "path string, block_no int, block string, note string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MemoryReader(dict(self.options))


class _MemoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        said = {k.lower(): v for k, v in options.items()}
        self.pattern = said.get("pattern", "")
        self.files, self.bytes, self.facts = (int(said.get(k, v)) for k, v in (("maxfiles", MAX_FILES), ("maxbytes", MAX_BYTES), ("maxfacts", MAX_FACTS)))

    def partitions(self) -> list[InputPartition]:
        paths, out = memory_files(self.pattern, self.files, self.bytes)
        return [InputPartition((p, None)) for p in paths] + [InputPartition(x) for x in out] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        path, note = partition.value
        if note:
            yield path, None, None, note
            return
        with open(path, encoding="utf-8", errors="replace") as f:
            parts = [p.strip() for p in regex.split(r"\n\s*\n", f.read())]
        kept = [p for p in parts if p and not p.startswith("#")]
        for i, block in enumerate(kept[: self.facts]):
            yield path, i, block, None
        if len(kept) > self.facts:
            yield path, None, None, f"{len(kept) - self.facts} facts past the number of a scan"
