import json
import math

import pytest
from pyspark.sql import functions as F

from quillstream.operators import components, graph, lint, notes, packs, ranking

NOTE = "note_id long, path string, basename string, type string, is_moc boolean, is_index boolean, title string, title_line int, headings array<struct<level:int,text:string,slug:string,line:int>>, tags array<string>, status string, body_lines array<string>, outlinks array<string>, body string, frontmatter string, updated date"


def note(i, name, title, body=(), tags=(), links=(), status="active", kind="theme", heads=(), moc=False, index=False):
    folder = "wiki/d/" if moc else "" if index else "wiki/d/themes/"
    return (i, f"{folder}{name}.md", name, kind, moc, index, title, 1, [(2, t, s, n) for t, s, n in heads], list(tags), status, list(body), list(links), "\n".join(body), '{"updated": "2024-05-01"}', None)


@pytest.fixture(scope="module")
def kb(spark):
    rows = [
        note(1, "index", "Home", links=["d-moc"], kind="index", index=True),
        note(2, "d-moc", "Domain", links=["alpha|Alpha start", "beta"], kind="moc", moc=True),
        note(3, "alpha", "Alpha engines", ["# Alpha engines", "They burn hydrogen."], ["rocket-fuel"], ["beta"]),
        note(4, "beta", "Beta", ["# Beta", "intro", "## Zebra stripes", "pattern words"], [], ["gamma", "nowhere"], heads=[("Zebra stripes", "zebra-stripes", 3)]),
        note(5, "gamma", "Gamma", ["quux appears here once"], status="deprecated"),
        note(6, "lonely", "Lonely", ["hydrogen hydrogen hydrogen"], links=["lonely"]),
    ]
    return spark.createDataFrame(rows, NOTE)


def ask(spark, kb, *questions):
    return [(r.qid, r.pos, r.path.split("/")[-1][:-3], r.match_reason, r.anchor) for r in ranking.rank(kb, ranking.questions_frame(spark, list(questions))).orderBy("qid", "pos").collect()]


def test_ranking_reasons(spark, kb):
    got = ask(spark, kb, "alpha engines", "zebra", "quux", "of the", "unseenword", "what is hydrogen")
    assert got[0][:4] == (0, 1, "alpha", "linked-theme")
    assert (1, 1, "beta", "heading", "zebra-stripes") in got
    assert not [g for g in got if g[0] in (3, 4)]
    assert [g[2] for g in got if g[0] == 5][0] in ("lonely", "alpha")
    assert [g[:2] for g in got if g[0] == 0] == [(0, i + 1) for i in range(sum(g[0] == 0 for g in got))]


def test_layout_does_not_matter(spark, kb):
    want = ask(spark, kb, "hydrogen engines", "stripes")
    assert ask(spark, kb.repartition(7), "hydrogen engines", "stripes") == want
    assert ask(spark, kb.orderBy(F.desc("path")), "hydrogen engines", "stripes") == want


def test_lexical_formula(spark, kb):
    row = {r.note_id: r.lex for r in ranking.lexical(ranking.field_tokens(kb), ranking.question_tokens(ranking.questions_frame(spark, ["quux"]))).collect()}
    tokens = {r.note_id: [r[f"f{i}"] for i in range(6)] for r in ranking.field_tokens(kb).collect()}
    avg = sum(len(t[5]) for t in tokens.values()) / 6
    idf = math.log(1 + (6 - 1 + 0.5) / 1.5)
    ftd = 1 / (0.25 + 0.75 * len(tokens[5][5]) / avg)
    raw = idf * ftd * 2.2 / (ftd + 1.2)
    assert row == {5: pytest.approx(raw / (raw + 1.5), abs=1e-6)}


def test_graph(spark, kb):
    links = notes.edges(kb)
    assert sorted(map(tuple, links.collect())) == [(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)]
    near = ranking.bounded_distances(ranking.seed_distances(kb, links), links)
    assert {r.note_id: r.d for r in near.collect()} == {1: 1, 2: 0, 3: 0, 4: 0, 5: 1}
    nodes = kb.select(F.col("note_id").alias("node"), "path")
    full = graph.full_distances(nodes, spark.createDataFrame([(1,)], "node long"), links)
    assert {r.node: r.d for r in full.collect()} == {1: 0, 2: 1, 3: 2, 4: 2, 5: 3, 6: graph.UNREACHED}
    assert [r.node for r in graph.orphans(nodes, links).orderBy("node").collect()] == [1, 6]
    around, inner = graph.ego(links, 5, 9)
    assert {r.node for r in around.collect()} == {1, 2, 3, 4, 5} and inner.count() == 5
    assert graph.ego(links, 99, 1)[0].count() == 0
    shown, cut, totals = graph.overview(nodes, links, 2)
    assert shown.count() == 2 and tuple(totals.first()) == (6, 5, True)
    assert sorted(map(tuple, notes.broken_links(kb).collect())) == [(4, "nowhere")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (None, 3)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_lines_and_headings(spark):
    body = "# T\n## A b\n```\n## not\n```\n## A b\ntext\n## !!\n## !!"
    own = notes.lines(spark.createDataFrame([(1, body)], "note_id long, body string"))
    got = [tuple(r) for r in notes.headings(own).select("line", "level", "text", "slug").orderBy("line").collect()]
    assert got == [(1, 1, "T", "t"), (2, 2, "A b", "a-b"), (6, 2, "A b", "a-b-1"), (8, 2, "!!", ""), (9, 2, "!!", "")]
    anchors = {r.line: r.anchor for r in notes.enclosing_heading(own, notes.headings(own)).collect()}
    assert anchors[4] == "a-b" and anchors[7] == "a-b-1"
    links = notes.body_links(spark.createDataFrame([(1, "[[a|b]] ![i](x.md) [t](d/y.md#z) [u](z.txt) [[c#d]]")], "note_id long, body string"))
    assert sorted(r.target for r in links.collect()) == ["a", "c", "y"]


def test_packs(spark):
    rows = [("a", 0.9, 10, False), ("b", 0.8, 95, False), ("c", 0.7, 30, True), ("d", 0.7, 60, True), ("e", 0.1, 1, True)]
    df = spark.createDataFrame(rows, "path string, score double, tokens long, h boolean")
    assert [r.path for r in packs.fill_budget(df, 100).orderBy("pos").collect()] == ["a", "c", "d"]
    assert packs.fill_budget(df.limit(0), 100).count() == 0
    assert sorted(r.path for r in packs.capped_share(df, "h").collect()) == ["a", "b", "c", "d"]
    lines = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "something else entirely here")], "id long, text string")
    near = packs.near_lines(lines, spark.createDataFrame([("The quick brown fox  jumps over!",)], "text string"))
    assert [r.id for r in near.collect()] == [1]


def front(**more):
    """Frontmatter that breaks no rule of a theme."""
    return json.dumps({"updated": "2024-05-01", "created": "2024-05-01", "summary": "s", "sources": ["raw/1"], **more})


@pytest.mark.parametrize(
    "change,code",
    [
        ({"basename": "alpha"}, "L1-1"), ({"outlinks": ["nope"]}, "L1-2"), ({"title": " "}, "L1-4"), ({"status": None}, "L1-4"), ({"frontmatter": front(related="x")}, "L1-4"), ({"frontmatter": front(confidence="sure")}, "L1-4"), ({"tags": ["odd"]}, "L1-5"),
        ({"type": "moc", "frontmatter": front(children=["[[alpha]]"])}, "L1-6"), ({"frontmatter": front(sources=[])}, "L1-7"), ({"status": "contested"}, "L1-10"), ({"status": "draft"}, "L1-11"), ({"type": "page"}, "L1-11"), ({"frontmatter": front(updated="May")}, "L1-12"), ({"frontmatter": front(created="2025-01-01")}, "L1-12"),
        ({"is_index": True}, "L1-13"), ({"type": "daily", "frontmatter": front(date="2024-05-01", run_id="2024-06-01T")}, "L1-14"), ({"body": "a\r\nb"}, "L1-16"), ({"frontmatter": front(origin="cli")}, "L1-19"), ({"body": "<!-- kb:body:start x -->"}, "L1-20"),
    ],
)
def test_lint_one_fault_each(spark, change, code):
    good = [note(1, "index", "Home", links=["alpha", "other name"], kind="index", index=True), note(3, "alpha", "Alpha", ["x"], ["ok"]), note(4, "zeta", "Zeta", ["<!-- kb:body:start x -->", "<!-- kb:body:end x -->"], ["ok"], links=["alpha"])]
    names = [c.split()[0] for c in NOTE.split(", ")]
    fronts = [front(children=[]), front(aliases=["other name"]), front()]
    dated = [r[:-2] + (f, None) for r, f in zip(good, fronts)]
    tags = spark.createDataFrame([("ok",)], "tag string")
    if "title" in change:
        assert lint.lint(spark.createDataFrame(dated, NOTE), tags, "2024-06-01").count() == 0
    bad = dict(zip(names, dated[2])) | change
    found = lint.lint(spark.createDataFrame([*dated[:2], tuple(bad[n] for n in names)], NOTE), tags, "2024-06-01")
    assert {r.code for r in found.collect()} == {code}
