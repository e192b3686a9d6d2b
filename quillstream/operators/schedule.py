"""Cron expressions as vectorised filters over minutes, and driver-side matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Ranges of the five fields.
RANGES = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def parse_field(text: str, low: int, high: int) -> list[int]:
    """Values of one field: *, lists, ranges and steps."""
    out: set[int] = set()
    for part in text.split(","):
        base, _, step = part.partition("/")
        first, dash, last = base.partition("-")
        if base == "*":
            a, b = low, high
        else:
            a, b = int(first), int(last) if dash else (high if step else int(first))
        if not (low <= a <= b <= high) or (step and int(step) < 1):
            raise ValueError(f"bad cron field {text!r}")
        out.update(range(a, b + 1, int(step) if step else 1))
    return sorted(out)


def matches(expression: str, at: Column) -> Column:
    """Whether a UTC timestamp's minute matches; when both day fields are restricted either may match; Sunday is 0 or 7."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("a cron expression has five fields")
    minute, hour, day, month, week = (parse_field(f, *r) for f, r in zip(fields, RANGES))
    days, weeks = F.dayofmonth(at).isin(day), (F.dayofweek(at) - 1).isin(sorted({w % 7 for w in week}))
    both = days | weeks if fields[2] != "*" and fields[4] != "*" else days & weeks
    return F.minute(at).isin(minute) & F.hour(at).isin(hour) & F.month(at).isin(month) & both


def last_fire(spark: SparkSession, expression: str, now: str, last_run: str | None = None, days: int = 366) -> DataFrame:
    """One row: the latest matching minute up to now, within so many days and after last_run; null if there is none."""
    first = F.date_trunc("minute", F.to_timestamp(F.lit(now))) - F.expr(f"interval {days} days")
    minutes = spark.range(days * 1440 + 1).select((first + F.make_interval(mins=F.col("id"))).alias("at"))
    hit = minutes.where(matches(expression, F.col("at")))
    if last_run:
        hit = hit.where(F.col("at") > F.to_timestamp(F.lit(last_run)))
    return hit.agg(F.max("at").alias("fire"))
