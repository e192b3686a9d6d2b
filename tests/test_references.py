import datetime as dt
import random

from quillstream.operators.references import dead_links, link_target, orphan_references
from pyspark.sql import functions as F

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def test_match_semantics_by_null_mask(spark, rowset):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", 9), (3, "a", None), (4, "z", None), (5, None, None)], "i int, x string, y int")
    parents = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "p string, q int")
    on = [("x", "p"), ("y", "q")]
    assert rowset(orphan_references(refs, parents, on, "simple"), "i", "reason") == [(2, "missing")]
    assert rowset(orphan_references(refs, parents, on, "full"), "i", "reason") == [(2, "missing"), (3, "partial_null"), (4, "partial_null")]
    assert rowset(orphan_references(refs, parents, on, "partial"), "i", "reason") == [(2, "missing"), (4, "missing")]


def test_empty_tables_repeats_and_clashing_columns(spark, rowset):
    refs = spark.createDataFrame([("a", "x", 0), ("a", "x", 0)], "k string, reason string, __k0 int")
    none = spark.createDataFrame([], "k string, reason string")
    assert rowset(orphan_references(refs, none, [("k", "k")]), "k", "__k0", "reason") == [("a", 0, "missing")] * 2
    assert orphan_references(refs.limit(0), none, [("k", "k")]).count() == 0


def test_validity_against_brute_force(spark, rowset):
    rng = random.Random(1)
    parents = [(rng.choice("abc"), at(rng.randrange(60)), at(rng.choice([None, rng.randrange(60)]))) for _ in range(40)]
    parents += [("a", at(10), at(10)), ("d", None, None), ("e", at(5), at(3))]
    refs = [(i, rng.choice("abcdef"), at(rng.choice([None, *range(60)]))) for i in range(200)]

    def reason(key, t):
        own = [p for p in parents if p[0] == key]
        if not own:
            return "missing"
        if t is None:
            return "late"
        if any(p[1] is not None and p[1] <= t and (p[2] is None or p[2] > t) for p in own):
            return None
        return "deleted" if any(p[1] is not None and p[1] <= t for p in own) else "late"

    want = sorted(((i, r) for i, k, t in refs if (r := reason(k, t))), key=repr)
    got = orphan_references(spark.createDataFrame(refs, "i int, k string, t timestamp"), spark.createDataFrame(parents, "k string, f timestamp, u timestamp"), [("k", "k")], at="t", valid=("f", "u"))
    assert rowset(got, "i", "reason") == want


def test_link_target(spark):
    cases = {" wiki/a/B c.md#x|y ": "B c", "n|l": "n", "#top": "", "a/b#c": "b", "../x.md": "x", "x.md.md": "x.md", " n ": "n"}
    df = spark.createDataFrame([(k,) for k in cases], "l string").select("l", link_target(F.col("l")).alias("t"))
    assert {r.l: r.t for r in df.collect()} == cases


def test_null_links(spark):
    notes = spark.createDataFrame([(1, None, None), (2, [None, "", "gone"], None)], "note_id int, outlinks array<string>, parsed_at timestamp")
    files = spark.createDataFrame([], "basename string, first_seen timestamp, removed_at timestamp")
    assert [tuple(r) for r in dead_links(notes, files).select("note_id", "target", "reason").collect()] == [(2, "gone", "missing")]
