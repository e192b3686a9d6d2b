"""Marked regions in note bodies: extraction, grading, blanking and replacement.

A region lies between <!-- prefix:body:start ID --> and <!-- prefix:body:end ID -->, each on a line of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import text as X

#: Bodies that nobody has written yet.
PLACEHOLDERS = ("", "_pending_", "_to be written_")


def region_ids(body: Column, prefix: str = "kb") -> Column:
    """Ids in order; null when markers do not strictly alternate start and end with equal, unique ids."""
    marks = F.regexp_extract_all(body, F.lit(rf"(?m)^<!-- {prefix}:body:((?:start|end) \S+) -->$"), 1)
    starts = F.filter(marks, lambda m: m.startswith("start "))
    want = F.flatten(F.transform(starts, lambda m: F.array(m, F.regexp_replace(m, "^start ", "end "))))
    sound = (want == marks) & (F.size(F.array_distinct(starts)) == F.size(starts))
    return F.when(sound, F.transform(starts, lambda m: F.substring(m, 7, 10_000)))


def regions(notes: DataFrame, key: str = "path", body: str = "body", prefix: str = "kb") -> DataFrame:
    """key, region_id, text of every region of soundly marked bodies."""
    found = rf"(?ms)^<!-- {prefix}:body:start \S+ -->$\n?(.*?)\n?^<!-- {prefix}:body:end \S+ -->$"
    ids, texts = region_ids(F.col(body), prefix), F.regexp_extract_all(body, F.lit(found), 1)
    return notes.select(key, ids.alias("i"), texts.alias("t")).where("i is not null").select(key, F.explode(F.arrays_zip("i", "t")).alias("z")).select(key, F.col("z.i").alias("region_id"), X.trim(F.col("z.t")).alias("text"))


def unauthored(before: DataFrame, after: DataFrame, key: str = "path", prefix: str = "kb") -> DataFrame:
    """key, region_id, why of regions that authoring left missing, as a placeholder, or unchanged from a placeholder."""
    old = regions(before, key, prefix=prefix).withColumnRenamed("text", "old")
    new = regions(after, key, prefix=prefix)
    why = F.when(F.col("text").isNull(), "missing").when(F.col("text").isin(*PLACEHOLDERS), "placeholder").when((F.col("text") == F.col("old")) & F.col("old").isin(*PLACEHOLDERS), "unchanged")
    return old.join(new, [key, "region_id"], "left").withColumn("why", why).where("why is not null").select(key, "region_id", "why")


def blanked(body: Column, prefix: str = "kb", filler: str = "") -> Column:
    """The body with the text of every region replaced by a filler, for comparing what lies outside."""
    return F.regexp_replace(body, rf"(?ms)(^<!-- {prefix}:body:start (\S+) -->$).*?(^<!-- {prefix}:body:end \2 -->$)", f"$1\n{filler}\n$3")


def outside_changed(before: DataFrame, after: DataFrame, key: str = "path", prefix: str = "kb") -> DataFrame:
    """key of notes whose text outside regions differs."""
    a, b = before.select(key, blanked(F.col("body"), prefix).alias("a")), after.select(key, blanked(F.col("body"), prefix).alias("b"))
    return a.join(b, key).where("a <> b").select(key)


def marker(region_id: Column, kind: str, prefix: str = "kb") -> Column:
    return F.concat(F.lit(f"<!-- {prefix}:body:{kind} "), region_id, F.lit(" -->"))


def empty_region(region_id: Column, prefix: str = "kb") -> Column:
    """A new region with a placeholder."""
    return F.concat(marker(region_id, "start", prefix), F.lit(f"\n{PLACEHOLDERS[1]}\n"), marker(region_id, "end", prefix))
