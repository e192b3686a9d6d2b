from pyspark.sql import functions as F

from quillstream.functions import pages
from quillstream.operators import lint, regions


def marked(*pairs):
    return "top\n" + "\n".join(f"<!-- kb:body:start {i} -->\n{t}\n<!-- kb:body:end {i} -->" for i, t in pairs) + "\nend"


def test_regions(spark):
    before = spark.createDataFrame([("p", marked(("a", "_pending_"), ("b", "_pending_"), ("c", "old"))), ("bad", "<!-- kb:body:start x -->\n<!-- kb:body:start y -->")], "path string, body string")
    after = spark.createDataFrame([("p", marked(("a", "written"), ("b", "_pending_")))], "path string, body string")
    assert [(r.region_id, r.text) for r in regions.regions(before).orderBy("region_id").collect()] == [("a", "_pending_"), ("b", "_pending_"), ("c", "old")]
    assert {r.region_id: r.why for r in regions.unauthored(before, after).collect()} == {"b": "placeholder", "c": "missing"}
    same = spark.createDataFrame([("p", marked(("a", "x"), ("b", "y"), ("c", "z")))], "path string, body string")
    assert regions.outside_changed(before, same).count() == 0
    assert regions.outside_changed(same, same.withColumn("body", F.replace("body", F.lit("top"), F.lit("TOP")))).count() == 1
    made = spark.range(1).select(regions.empty_region(F.lit("r1--c1")).alias("body"), F.lit("q").alias("path"))
    assert [r.region_id for r in regions.regions(made).collect()] == ["r1--c1"]


def test_pages(spark):
    html = '<html><TITLE>\n A  b </TITLE><a href="x.html">x</a><a href=\'#top\'>t</a></html>'
    row = spark.createDataFrame([(html,)], "h string").select(pages.page_title(F.col("h")).alias("t"), pages.page_links(F.col("h")).alias("l")).first()
    assert (row.t, row.l) == ("A b", ["x.html"])
    ips = {"10.0.0.1": "private", "127.0.0.1": "loopback", "::ffff:127.0.0.1": "loopback", "169.254.1.1": "link_local", "8.8.8.8": None, "x": "invalid"}
    got = {r.a: r.b for r in spark.createDataFrame([(k,) for k in ips], "a string").select("a", pages.blocked("a").alias("b")).collect()}
    assert got == ips
    links = {"./a.md#x": "a.md", "<b c.md>": "b c.md", "http://x/a.md": None, "/a.md": None, "../a.md": None, ".h.md": None, "a%20.md": None, "a.txt": None}
    got = {r.a: r.b for r in spark.createDataFrame([(k,) for k in links], "a string").select("a", pages.local_link(F.col("a")).alias("b")).collect()}
    assert got == links


def test_more_rules(spark):
    rows = [
        ("a", "a", "theme", "active", '{"sources": [], "aliases": ["b", "z"]}', ""),
        ("b", "b", "theme", "active", '{"sources": ["raw/1.md", "raw/9.md", "raw/1.meta.yaml"], "aliases": ["z"], "origin": "odd", "schema_version": "0"}', ""),
        ("c", "c", "theme", "contested", '{"sources": ["raw/1.md"], "body_status": "pending"}', marked(("r", "done"))),
    ]
    own = spark.createDataFrame(rows, "path string, basename string, type string, status string, frontmatter string, body string")
    found = lambda df: sorted((r.code, r.path, r.message) for r in df.collect())
    raw = spark.createDataFrame([("raw/1.md",), ("raw/1.meta.yaml",)], "path string")
    assert found(lint.bare_themes(own)) == [("L1-7", "a", "no sources")]
    assert found(lint.sources(own, raw)) == [("L1-8", "b", "missing source raw/9.md"), ("L1-8b", "b", "sidecar raw/1.meta.yaml")]
    assert found(lint.contested_shape(own)) == [("L1-10", "c", "contested without its marks")]
    assert found(lint.alias_collisions(own)) == [("L1-15", "a", "alias b"), ("L1-15", "b", "alias z")]
    assert [f[0] for f in found(lint.schema_drift(own, "1"))] == ["L1-17"] and [f[1] for f in found(lint.origins(own))] == ["b"]
    assert found(lint.stale_status(own)) == [("L2-6", "c", "body_status is out of date")]
