import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream import config
from quillstream.desk import Desk
from quillstream.functions import text as X
from quillstream.operators import curation, follow, importing, parsing
from quillstream.sources import extract


def test_notes_from_markdown(spark):
    text = "---\ntitle: 'Said: so'\ntags:\n  - a-b\n  - c\nrelated: ['[[x]]', '[[y|Z]]']\ncreated: 2024-05-01\nstatus: ACTIVE \n---\n\n# Top ##\n## A\n```\n# not [[in]]\n``` [[gone]]\n## A\n# later\n[t](d/e.md#f) ![i](n.md) [[k|l]] [[x]]\n"
    rows = [("wiki/d/themes/n-one.md", text), ("wiki/d/d-moc.md", "no fence"), ("index.md", "---\nbroken: [\n---\nbody"), ("e.md", ""), ("f.md", None), ("g.md", "---\n---\n")]
    got = {r.path: r for r in parsing.parse_notes(spark.createDataFrame(rows, "path string, text string")).collect()}
    n = got["wiki/d/themes/n-one.md"]
    assert (n.title, n.title_line, n.status, n.tags, n.outlinks) == ("Top", 1, "active", ["a-b", "c"], ["in", "e", "k", "x", "y"])
    assert [(h.level, h.slug, h.line) for h in n.headings] == [(2, "a", 2), (2, "a-1", 6)] and json.loads(n.frontmatter)["created"] == "2024-05-01"
    assert got["wiki/d/d-moc.md"].is_moc and got["wiki/d/d-moc.md"].title == "d moc" and got["index.md"].is_index and got["index.md"].frontmatter is None
    assert set(got) == {"wiki/d/themes/n-one.md", "wiki/d/d-moc.md", "index.md", "e.md", "g.md"} and got["g.md"].body == ""
    files = spark.createDataFrame(rows[:2], "path string, text string")
    cached = parsing.parse_notes(files.limit(1)).withColumn("source_digest", F.sha2(F.lit(text), 256)).withColumn("title", F.lit("cached"))
    assert {r.path: r.title for r in parsing.parse_changed(files, cached).collect()} == {"wiki/d/themes/n-one.md": "cached", "wiki/d/d-moc.md": "d moc"}


def test_foreign_frontmatter_is_repaired(spark):
    rows = [(1, "---\nlinks: [[a]], [[b]]\nx: 1\n---\nbody"), (2, "---\nx: [\n---\nbody"), (3, "plain"), (4, "---\nx: 1\n---\nbody")]
    got = {r.i: (json.loads(r.frontmatter), r.body, r.repaired) for r in parsing.split_foreign(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert got == {1: ({"links": ["[[a]]", "[[b]]"], "x": 1}, "body", True), 2: ({}, "body", False), 3: ({}, "plain", False), 4: ({"x": 1}, "body", False)}


def test_imported_links(spark):
    rows = [(1, "wiki/d/themes/a.md", "a", "see [[b]] and [[b|B!]], [[none]], ![[b]], [[ ]]"), (2, "wiki/e/b.md", "b", "no links"), (3, "c.md", "c", "[[a]]"), (4, "d.md", "d", None)]
    own = spark.createDataFrame(rows, "note_id long, path string, basename string, body string")
    got = {r.note_id: (r.body, r.converted, r.unresolved) for r in importing.import_links(own).collect()}
    assert got[1] == ("see [b](../../e/b.md) and [B!](../../e/b.md), [[none]], ![[b]], [[ ]]", 2, ["none"])
    assert got[2] == ("no links", 0, []) and got[3] == ("[a](wiki/d/themes/a.md)", 1, []) and 4 not in got
    pages = spark.createDataFrame([(1, "- [A](x/a.md) z\n- [N](x/none.md)\n  - [B](b.md)\ntext")], "note_id long, body string")
    assert tuple(importing.synced_children(pages, own.select("basename")).first()) == (1, "- [A](x/a.md) z\n  - [B](b.md)\ntext", ["a"], ["none"])
    paths = {"wiki/a.md": True, ".obsidian/a.md": False, "_kb/a.md": False, "README.md": False, "a.txt": False, "x/.a.md": False, "a.md": True}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.k for r in df.select("p", importing.is_note_path(F.col("p")).alias("k")).collect()} == paths
    refs = {"raw/a.md": True, "raw/x/b_1.md": True, "raw/../a": False, "raw/./a": False, "raw/a.meta.yaml": False, "x/a.md": False, "raw/": False}
    df = spark.createDataFrame([(p,) for p in refs], "p string")
    assert {r.p: r.k for r in df.select("p", importing.raw_reference(F.col("p")).alias("k")).collect()} == refs


def test_followed_links_lose_no_pointer(spark):
    files = spark.createDataFrame([("m/a.md", "---\nx: 1\n---\n# Own\nbody a"), ("m/sub/b.md", "body b"), ("m/empty.md", "---\nx: 1\n---\n")], "path string, text string")
    blocks = [("m/i.md", 1, "- [A](a.md) - why"), ("m/i.md", 2, "- [B](./sub/../sub/b.md) [gone](none.md)"), ("m/i.md", 3, "prose"), ("m/i.md", 4, "- [E](empty.md)"), ("m/i.md", 5, "- [up](../../x.md)"), ("m/i.md", 6, "- ")]
    facts, notes = follow.followed_facts(spark.createDataFrame(blocks, "path string, block_no int, block string"), files)
    got = [(r.block_no, r.text, r.followed) for r in facts.orderBy("block_no", "pos").collect()]
    assert got == [(1, "> - why\n\n# Own\nbody a", True), (2, "# B\n\nbody b", True), (2, "- [B](./sub/../sub/b.md) [gone](none.md)", False), (3, "prose", False), (4, "- [E](empty.md)", False), (5, "- [up](../../x.md)", False)]
    assert sorted(r.block_no for r in notes.collect()) == [2, 4, 5]
    few, said = follow.followed_facts(spark.createDataFrame(blocks, "path string, block_no int, block string"), files, max_facts=2, max_followed=1)
    assert few.count() == 2 and said.where("note like 'past%'").count() == 3 and said.where("note like '%number of links%'").count() == 4


def test_extracted_documents(spark):
    def office(name, xml, extra=b""):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, xml)
            z.writestr("pad", extra)
        return out.getvalue()

    w = "<w:document xmlns:w='x'><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:t>two</w:t></w:p></w:document>"
    rows = [("a.docx", None, office("word/document.xml", w)), ("b.docx", None, office("word/document.xml", w, b"0" * 5000)), ("c.txt", "text/plain", "caf\u00e9".encode() + b"\xff"), ("d.pdf", "text/html", b"x"), ("e", None, b"x"), ("f.xlsx", None, b"no zip"), ("g.md", None, None)]
    got = {r.filename: (r.markdown, r.error) for r in extract.extracted(spark.createDataFrame(rows, "filename string, mime string, content binary"), most=4000).collect()}
    assert got["a.docx"] == ("Hello there\n\ntwo", None) and got["b.docx"] == (None, "declared size over the limit") and got["c.txt"] == ("caf\u00e9\ufffd", None)
    assert got["d.pdf"][1] == "name and media type disagree" and got["e"][1] == "unknown kind" and got["f.xlsx"][1] and got["g.md"][1] == "no content"
    sizes = spark.createDataFrame([(0, 5), (1, 50)], "pos int, size long")
    verdicts = lambda **k: [r.verdict for r in extract.within_caps(sizes, **k).orderBy("pos").collect()]
    assert verdicts(each=10) == ["ok", "file too large"] and verdicts(count=1) == ["too many files"] * 2 and verdicts(total=54) == ["batch too large"] * 2


def test_settings():
    got = config.load("kind: team\nconnectors:\n  - {name: 'file:bot', path: '~/x', scope: team}\nredact_classes: [aws_access_key_id]")
    assert got.connectors[0].agent == "bot" and got.admits(got.connectors[0]) and not config.load(None).admits(got.connectors[0]) and config.load("") == config.Settings()
    for bad in ("nope: 1", "redact_classes: [none]", "related: 0", "- a", "connectors: [{name: x, path: y}]", "connectors: [{nam: x}]"):
        with pytest.raises(config.ConfigError):
            config.load(bad)
    assert config.spec_hash({"b": 1, "a": 2}) == config.spec_hash({"a": 2, "b": 1})
    with pytest.raises(config.ConfigError):
        config.check_schema("0")


def test_run_records(spark):
    lines = ['{"run_id": "r", "event_ids": ["a", "b"]}', '{"run_id": "s", "event_ids": "c"}', "[1]", "no", "", '{"run_id": "t"}']
    got = curation.read_attempts(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.run_id, [e for e in r.event_ids if e]) for r in got] == [("r", ["a", "b"]), ("s", ["c"]), ("t", [])]
    log = spark.createDataFrame([("# log\n## r1\n- dispositions: DROP=1\n## r2\n- dispositions: no-op\n- note: a: b\n",)], "text string")
    assert [(r.run, r.fields) for r in curation.work_log(log).orderBy("pos").collect()] == [("r2", {"dispositions": "no-op", "note": "a: b"}), ("r1", {"dispositions": "DROP=1"})]
    spooled = spark.createDataFrame([("f/w/x.md", "1", "r"), ("f/w/y.md", "x", "s")], "path string, id string, run_id string")
    assert [r.id for r in curation.selected(spooled, "event", "x").collect()] == ["1"] and [r.id for r in curation.selected(spooled, "event", "1").collect()] == ["1"] and curation.selected(spooled, "run", "s").count() == 1
    when = spark.createDataFrame([("2024-01-02", "2024-01-01"), ("2024-01-01", "2024-01-01"), ("2024-01-01", "2024-01-02"), (None, "2024-01-01"), ("2024-01-01", None)], "f string, r string")
    assert [r[0] for r in when.select(curation.failure_is_current(F.col("f"), F.col("r"))).collect()] == [True, True, False, False, True]


def test_text_forms(spark):
    df = spark.createDataFrame([("x {\"a\": {\"b\": \"}\"}} y {",), ("none {",), (None,)], "t string")
    assert [r[0] for r in df.select(X.first_object("t")).collect()] == ['{"a": {"b": "}"}}', None, None]
    one = spark.range(1).select(
        X.tag_list(F.lit("a-b, c  a-b")).alias("ok"), X.tag_list(F.lit("A b")).alias("bad"), X.heading_anchor(F.lit("The `x_y` [[a|B c]] **bold**!")).alias("anchor"), X.slug_or_hash(F.lit("\ud55c\uad6d")).alias("name"),
        X.harvest_origin(F.array(F.lit("manual"), F.lit("harvest:b")), F.lit(None)).alias("origin"), X.bounded_list(F.array(*(F.lit("r" * 500) for _ in range(7)))).alias("reasons"),
    ).first()
    assert (one.ok, one.bad, one.anchor, one.origin) == (["a-b", "c"], None, "the-x-y-b-c-bold", "harvest:b") and one.name.startswith("note-") and len(one.name) == 13
    assert one.reasons.total == 7 and len(one.reasons.shown) == 5 and len(one.reasons.shown[0]) == 400


def test_the_desk(spark, data, tmp_path):
    from quillstream.plans.notes import corpus

    desk = Desk(spark, corpus(spark, data), str(tmp_path / "home"))
    facts = spark.createDataFrame([("2024-01-01T00-00-00.000Z--00000a", "w", "manual", "a fact with AKIA" + "A1" * 8, "k"), ("2024-01-01T00-00-00.000Z--00000b", "w", "cli", "no", None)], "id string, writer string, source string, text string, event_key string")
    assert desk.remember(facts) == 1 and desk.remember(facts) == 0 and "REDACTED" in desk.runs.log().first().body
    assert desk.curate(lambda e: e.select("id")) == ["desk-00000000"] and desk.status("2024-01-01").first().processed == 1
    path = desk.browse().first().path
    assert desk.note(path).count() >= 1 and desk.note("none.md").count() == 0 and desk.neighbors("none.md")[0].count() == 0
