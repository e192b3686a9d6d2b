import pytest
from pyspark.sql import functions as F

from quillstream.llm import confusables as C

CHANGED = {
    "Ｔｅｓｔ１２": "Test12", "cafe\u0301": "café", "\u1112\u1161\u11ab": "한", "zero\u200bwidth": "zerowidth", "soft\u00adhyphen": "softhyphen", "\ufeffx": "x", "a\u00a0b": "a b", "a\u3000b": "a b", "a\u202fb": "a b",
    "𝐞𝐯𝐞": "eve", "ℋ": "H", "m\u0430nifest": "manifest", "\u039doise": "Noise", "a\u200db": "ab", "ﾊﾟ": "パ", "\u200e": "",
    "\u13aapple": "Apple", "\ua4f3ne": "One", "re\u044c": "reb", "a\U000e0100": "a", "x\U000e0041y": "xy",
}
SAME = ["", "plain", "журнал", "журнал index", "λόγος and more", "👩\u200d💻 ok", "❤\ufe0f", "x² ½ ™ … – “q”", "日本語メモ", "한국어", "Über façade", "Δ value", "naïve", "\U0001f3f4\U000e0067\U000e0062\U000e007f flag"]


@pytest.mark.parametrize("text", [*CHANGED, *SAME])
def test_the_skeleton_is_that_of_the_one_form(text):
    assert C.skeleton(text) == C.skeleton(C.unify(text))
    assert C.one_form(text) == C.unify(text)


def test_no_character_changes_without_being_suspect():
    import sys

    for point in range(128, sys.maxunicode + 1):
        c = chr(point)
        for text in ("" if 0xD800 <= point < 0xE000 else c, "" if 0xD800 <= point < 0xE000 else f"a{c}b"):
            assert C.one_form(text) == C.unify(text), hex(point)


@pytest.mark.parametrize("text,want", CHANGED.items())
def test_one_form(text, want):
    assert C.unify(text) == want
    assert C.unify(want) == want


@pytest.mark.parametrize("text", SAME)
def test_what_stays(text):
    assert C.unify(text) == text


def test_tables_agree_with_python(spark):
    assert len(C.LOOKALIKE) == len(C.LATIN) == len(set(C.LOOKALIKE))
    texts = [*CHANGED, *SAME, None, "a" * 50_000 + "\u200b"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, unified string")
    got = {r.id: r.unified for r in C.unified(df, "text").collect()}
    assert got == {i: None if t is None else C.unify(t) for i, t in enumerate(texts)}
    assert {r.id for r in C.changed(df, "text").collect()} == {i for i, t in enumerate(texts) if t is not None and C.unify(t) != t}
    assert C.unified(df.limit(0), "text").count() == 0


def test_skeleton_groups(spark):
    texts = ["manifest", "m\u0430nifest", "ｍanifest", "other", "other", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = C.alike_groups(df, "id", "text").collect()
    assert [(r.n, r.n_forms, r.first_id) for r in got] == [(3, 3, 0)]


def test_fields_count_a_record_once(spark):
    notes = spark.createDataFrame([(1, "t\u200b", ["a", "b\u00a0c"]), (1, "t\u200b", ["a", "b\u00a0c"]), (2, None, None), (3, "ok", [None, "x"])], "note_id long, title string, body_lines array<string>")
    hits = spark.createDataFrame([(7, "e\u0301"), (8, None), (9, "")], "hit_id long, excerpt string")
    assert sorted(map(tuple, C.changed_fields(notes, hits).collect())) == [("body_lines", 1), ("excerpt", 7), ("title", 1)]
    assert C.unified_fields(notes, hits).where(F.col("field") == "title").count() == 3


def test_alike_groups_hold_body_lines(spark, tmp_path):
    from quillstream.llm.queries import p5_alike

    spark.createDataFrame([(1, "one", ["first", "m\u0430nifest line"]), (2, "two", ["manifest line", ""]), (3, None, None)], "note_id long, title string, body_lines array<string>").write.parquet(f"{tmp_path}/parsed_notes.parquet")
    spark.createDataFrame([(9, "else")], "hit_id long, excerpt string").write.parquet(f"{tmp_path}/search_hits.parquet")
    assert [(r.skeleton, r.n, r.n_forms, r.first_id) for r in p5_alike(spark, str(tmp_path)).collect()] == [("manifest line", 2, 2, 1)]
