"""Operational metrics as rows (name, labels, value) and as exposition text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(df: DataFrame, name: str, value: Column, **labels: str) -> DataFrame:
    said = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for k, c in labels.items())) if labels else F.lit("")
    return df.select(F.lit(name).alias("name"), said.alias("labels"), value.cast("double").alias("value"))


def metrics(notes: DataFrame, turns: DataFrame, cursor_totals: DataFrame) -> DataFrame:
    """name, labels, value: notes by status, turns by role, harvest counters by connector."""
    parts = [
        _rows(notes.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "kb_notes", F.col("n"), status="status"),
        _rows(turns.groupBy("role").agg(F.count(F.lit(1)).alias("n")), "kb_turns", F.col("n"), role="role"),
        *(_rows(cursor_totals, f"kb_harvest_{c}_total", F.col(c), connector="connector") for c in ("proposed", "accepted", "rejected")),
    ]
    return reduce(DataFrame.unionByName, parts)


def exposition(rows: DataFrame) -> DataFrame:
    """name, text: one block of exposition lines per metric family; families are few and short."""
    line = F.concat("name", F.when(F.col("labels") != "", F.concat(F.lit("{"), "labels", F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    return rows.groupBy("name").agg(F.concat(F.lit("# TYPE "), F.first("name"), F.lit(" gauge\n"), F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("text"))
