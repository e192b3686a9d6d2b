import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import harvest, inbox, metrics, plans, schedule
from quillstream.sinks import snapshots
from quillstream.sources import files
from quillstream.streaming import curate

EVENT = "id string, source string, writer string, event_key string, kind string, confidence string, content_sha256 string, body string"


def event(n, writer="u", key=None, sha="s", kind="capture", sure="high"):
    return (f"2024-01-01T00-00-{n:02d}.000Z--{n:06x}", "manual", writer, key, kind, sure, sha, f"body {sha}")


def ids(df):
    return sorted(int(r.id[-6:], 16) for r in df.collect())


def test_delivery_claim_and_candidates(spark):
    rows = [event(1, key="k", sha="a"), event(2, key="k", sha="b"), event(3, "v", "k", "a"), event(4, sha="c", kind="candidate", sure="low"), event(5, sha="c"), event(6, sha="d"), event(7, sha="a")]
    own = spark.createDataFrame(rows, EVENT)
    first = inbox.first_deliveries(own)
    assert ids(first) == [1, 3, 4, 5, 6, 7]
    assert ids(inbox.undelivered(own, spark.createDataFrame([("u", "k")], "writer string, event_key string"))) == [3, 4, 5, 6, 7]
    assert ids(inbox.claim(first, 2)) == [1, 3, 4, 5] and ids(inbox.claim(first, 9)) == [1, 3, 4, 5, 6, 7] and inbox.claim(first.limit(0)).count() == 0
    found = {r.candidate_id: (r.content_sha256, r.n_events, r.kind, r.confidence, r.is_gated) for r in inbox.candidates(inbox.claim(first, 2)).collect()}
    assert found == {"c1": ("a", 2, "capture", "high", False), "c2": ("c", 2, "candidate", "low", True)}
    bad = spark.createDataFrame([event(1), ("x", *event(1)[1:]), (event(1)[0] + "\n", *event(1)[1:]), (event(2)[0], "odd!", *event(2)[2:])], EVENT)
    assert ids(inbox.valid_events(bad)) == [1]


def test_retry_requeue_and_triggers(spark):
    counts = inbox.attempt_counts(spark.createDataFrame([(["a", "a", "b"],), (["a"],)], "event_ids array<string>"))
    got = {r.event_id: (r.attempt, r.disposition) for r in inbox.retry(spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string"), counts).collect()}
    assert got == {"a": (4, "failed"), "b": (2, "inbox"), "c": (1, "inbox")}
    i = event(1)[0]
    spool = spark.createDataFrame([("p1", i, "u", None), ("p2", i, "u", None), ("p3", "?", "u", None), ("p4", event(2)[0], "u", "k"), ("p5", event(3)[0], "u", None)], "path string, id string, writer string, event_key string")
    out = inbox.requeue(spool, spark.createDataFrame([("u", "k")], "writer string, event_key string"), spark.createDataFrame([(event(3)[0],)], "id string"))
    assert {r.path: r.verdict for r in out.collect()} == {"p1": "movable", "p2": "occupied", "p3": "unreadable", "p4": "delivered", "p5": "occupied"}
    df = spark.createDataFrame([(9, 0, False), (1, 99, False), (1, 0, True), (0, 99, True)], "d int, m int, c boolean")
    assert [r.w for r in df.select(inbox.trigger(F.col("d"), F.col("m"), F.col("c"), 5, 30).alias("w")).collect()] == ["threshold", "idle", "cron", None]
    assert [r.s for r in spark.range(12).select(inbox.backoff_seconds(F.col("id"), 30).alias("s")).collect()][:6] == [30, 60, 120, 240, 480, 900]


def test_schedule(spark):
    fire = lambda cron, now, last=None: schedule.last_fire(spark, cron, now, last).first().fire
    assert fire("0 6 * * *", "2024-05-06 07:08:09") == dt.datetime(2024, 5, 6, 6, 0)
    assert fire("0 6 * * *", "2024-05-06 07:08:09", "2024-05-06 06:00:00") is None
    assert fire("0 0 13 * 5", "2024-05-12 00:00:00") == dt.datetime(2024, 5, 10, 0, 0)
    assert fire("0 0 * * 7", "2024-05-06 00:00:00") == dt.datetime(2024, 5, 5, 0, 0)
    for bad in ("61 * * * *", "* * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.matches(bad, F.current_timestamp())


def test_plan_rules_and_effects(spark):
    schema = "pos int, candidate_id string, event_ids array<string>, op string, basename string, target_basename string, status string, tags array<string>, title string, source string, domain string, summary string"
    good = (1, "c1", ["e1"], "CREATE_THEME", "new-page", None, None, ["t"], "New", "s1", "d", "x")
    merge = (2, "c2", ["e2"], "MERGE_INTO_THEME", None, "old", None, ["u"], None, "s2", "d", "y")
    other = (3, "c3", ["e3"], "MARK_CONTESTED", None, "old", None, None, None, "s3", "d", "z")
    daily = (4, "c4", ["e4"], "APPEND_DAILY", None, None, None, None, None, "s4", "d", "said")
    claimed = spark.createDataFrame([("e1",), ("e2",), ("e3",), ("e4",)], "event_id string")
    themes = spark.createDataFrame([("old", "Old", "active", ["t"], ["s0"], dt.date(2024, 1, 1))], "basename string, title string, status string, tags array<string>, sources array<string>, updated date")
    tags = spark.createDataFrame([("t",), ("u",)], "tag string")
    none = spark.createDataFrame([], "candidate_id string")
    check = lambda rows, gated=none: {r.check for r in plans.validate(spark.createDataFrame(rows, schema), claimed, themes, tags, gated).collect()}
    full = [good, merge, other, daily]
    assert check(full) == set()
    swap = lambda k, **kw: [*full[:k], tuple((dict(zip([c.split()[0] for c in schema.split(", ")], full[k])) | kw).values()), *full[k + 1 :]]
    assert check(full[1:]) == {"COVERAGE"} and check(swap(0, event_ids=["e1", "e9"])) == {"PROVENANCE"} and check(swap(0, event_ids=["e1", "e2"])) == {"COVERAGE"}
    assert check(swap(3, op="RENAME")) == {"CLOSED-VOCAB"} and check(swap(0, tags=["odd"])) == {"TAXONOMY"} and check(swap(0, basename="Bad Name")) == {"BASENAME"} and check(swap(0, basename="old")) == {"BASENAME"}
    assert check(swap(1, target_basename="gone")) == {"LINK-RESOLVABILITY"} and check(swap(0, status="done")) == {"STATUS"} and check(full, spark.createDataFrame([("c1",)], "candidate_id string")) == {"CANDIDATE-GATE"}
    after = {r.basename: (r.status, r.tags, r.sources, str(r.updated)) for r in plans.apply_themes(themes, spark.createDataFrame(full, schema), "2024-02-02").collect()}
    assert after == {"old": ("contested", ["t", "u"], ["s0", "s2", "s3"], "2024-02-02"), "new-page": ("active", ["t"], ["s1"], "2024-02-02")}
    days = plans.append_dailies(spark.createDataFrame([("d-2024-02-02", ["before"])], "basename string, sections array<string>"), spark.createDataFrame(full, schema), "2024-02-02")
    assert [(r.basename, r.sections) for r in days.collect()] == [("d-2024-02-02", ["before", "said"])]
    base = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "path string, text string")
    new = spark.createDataFrame([("a", "y"), ("b", "y"), ("d", "n")], "path string, text string")
    assert {r.path: r.problem for r in plans.author_diff(base, new, spark.createDataFrame([("a",)], "path string")).collect()} == {"b": "outside", "c": "removed", "d": "added"}


def test_transcripts(spark):
    said = [
        {"type": "user", "timestamp": "t", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "message": {"role": "odd", "content": [{"type": "text", "text": "hi"}, {"type": "thinking", "thinking": "no"}, {"type": "tool_use", "name": "Read", "input": {"p": 1}}]}},
        {"type": "system", "message": {"content": "no"}}, {"type": "user", "message": "no"}, ["no"],
    ]
    lines = [("f", i, json.dumps(x)) for i, x in enumerate(said)] + [("f", 9, '{"broken'), ("f", 10, "")]
    got = harvest.transcript_turns(spark.createDataFrame(lines, "file string, pos int, value string")).orderBy("pos", "sub").collect()
    assert [(r.pos, r.sub, r.role, r.text, r.tool_name) for r in got] == [(0, 0, "user", "hello", None), (1, 0, "assistant", "hi", None), (1, 2, "assistant", 'Read({"p":1})', "Read")]


def test_facts(spark):
    turns = spark.createDataFrame([("f", 1, "assistant", "plain\n\nRoot cause: token AKIA" + "A1" * 8 + "\n \n"), ("f", 2, "user", "root cause x"), ("g", 1, "assistant", "Root cause: token AKIA" + "B2" * 8)], "file string, pos int, role string, text string")
    facts = harvest.facts(harvest.salient(turns, ["file", "pos"]))
    assert [(r.text, r.redaction_hits) for r in facts.collect()] == [("Root cause: token [REDACTED:aws_access_key_id]", {"aws_access_key_id": 1})] * 2
    assert [(r.n, r.file, r.pos) for r in harvest.distinct_facts(facts).collect()] == [(2, "f", 1)]


def test_memory_segments(spark):
    text = "# H\nprose one\nprose two\n\n- item a\n  child\n\n  more child\n- item b\n\nafter\n## H2\n1. first\ntail"
    got = harvest.segments(spark.createDataFrame([("p", text)], "path string, text string")).orderBy("block_no").collect()
    assert [r.block for r in got] == ["prose one\nprose two", "- item a\n  child\n\n  more child", "- item b", "after", "1. first", "tail"]


def test_files(spark, tmp_path):
    (tmp_path / "wiki").mkdir()
    (tmp_path / "wiki" / "a.md").write_text("---\ntitle: A note\ntags: [x, y]\nsources:\n  - raw/1\n---\n\n# A\nbody\n\n")
    (tmp_path / "b.md").write_text("no fence")
    (tmp_path / "README.md").write_text("skip")
    got = {r.rel_path: r for r in files.read_notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"wiki/a.md", "b.md"}
    assert json.loads(got["wiki/a.md"].frontmatter) == {"title": "A note", "tags": ["x", "y"], "sources": ["raw/1"]} and got["wiki/a.md"].body == "# A\nbody" and got["wiki/a.md"].basename == "a"
    assert got["b.md"].frontmatter is None and got["b.md"].body == "no fence"
    with pytest.raises(Exception, match="no frontmatter"):
        files.read_notes(spark, str(tmp_path), strict=True).collect()
    parsed = files.read_notes(spark, str(tmp_path))
    assert files.parse_missing(parsed, parsed.where("basename = 'a'")).count() == 1
    spark.dataSource.register(files.MemoryFacts)
    assert [r.block for r in spark.read.format("memory_facts").option("pattern", str(tmp_path / "b.md")).load().collect()] == ["no fence"]
    assert files.read_memory(spark, str(tmp_path / "*.none"))[0].count() == 0 and files.read_memory(spark, str(tmp_path / "b.md"))[0].first().text == "no fence"
    some, left_out = files.read_memory(spark, str(tmp_path / "*.md"), max_files=1)
    assert some.count() == 1 and left_out.count() == 1 and files.read_memory(spark, str(tmp_path / "*.md"), max_bytes=1)[1].count() == 2
    said = spark.read.format("memory_facts").option("pattern", str(tmp_path / "*.md")).option("maxFiles", "1").load()
    assert said.where("note is not null").count() == 1
    assert [(r.pos, r.value) for r in files.read_transcripts(spark, str(tmp_path / "b.md")).collect()] == [(0, "no fence")]


def test_snapshots(spark, tmp_path):
    store = snapshots.Snapshots(spark, str(tmp_path / "s"))
    first = store.publish(spark.range(3).toDF("id"), None)
    second = store.publish(spark.range(5).toDF("id"), first, "r1")
    assert store.read().count() == 5 and store.read(first).count() == 3 and store.publish(spark.range(9).toDF("id"), first, "r1") == second
    third = store.publish(spark.range(2).toDF("id"), second, "r2", append=True)
    assert store.read().count() == 7 and store.publish(spark.range(9).toDF("id"), third, "r1") == second and store.read().count() == 7
    assert [r.run for r in store.published().orderBy("number").collect()] == [None, "r1", "r2"]
    with pytest.raises(snapshots.Conflict):
        store.publish(spark.range(1).toDF("id"), first)
    log = str(tmp_path / "log")
    events = spark.createDataFrame([event(1, key="k"), event(2, key="k"), event(3)], EVENT)
    assert snapshots.append_events(events, log) == 2 and snapshots.append_events(events, log) == 0
    new = snapshots.upsert(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), spark.createDataFrame([("a", 2)], "k string, v int"), "k", "v")
    assert sorted(map(tuple, new.collect())) == [("a", 2), ("b", 1)]
    made = snapshots.markdown(spark.createDataFrame([("p", {"title": "T"}, "body")], "path string, frontmatter map<string,string>, body string")).first().text
    assert made == "---\ntitle: T\n---\n\nbody\n"


def test_curation_stream_is_idempotent(spark, tmp_path):
    source, home = str(tmp_path / "in"), str(tmp_path / "home")
    plan = lambda claimed: claimed.select(F.col("content_sha256").alias("basename"), F.col("id").alias("source"))
    spark.createDataFrame([event(1, key="k", sha="a"), event(2, key="k", sha="a"), event(3, sha="b")], EVENT).write.parquet(source)
    for _ in range(2):
        curate.curate(curate.event_stream(spark, source), home, plan).awaitTermination()
    assert snapshots.Snapshots(spark, home + "/notes").read().count() == 2
    spark.createDataFrame([event(4, key="k", sha="c"), event(5, sha="d")], EVENT).write.mode("append").parquet(source)
    curate.curate(curate.event_stream(spark, source), home, plan).awaitTermination()
    assert sorted(r.basename for r in snapshots.Snapshots(spark, home + "/notes").read().collect()) == ["a", "b", "d"]


def test_a_batch_replayed_after_any_step_publishes_once(spark, tmp_path, monkeypatch):
    """Stop once after each step, then replay: every event is in one run, and every run is published once."""
    plan = lambda claimed: claimed.select(F.col("content_sha256").alias("basename"), F.col("id").alias("source"))
    steps = [(curate, "append_events"), (curate.Runs, "claim"), (curate.Runs, "finish"), (snapshots.Snapshots, "publish")]
    for n, (owner, name) in enumerate(steps):
        source, home = str(tmp_path / f"in{n}"), str(tmp_path / f"home{n}")
        spark.createDataFrame([event(1, sha="a"), event(2, sha="b"), event(3, sha="c")], EVENT).coalesce(1).write.parquet(source)
        real, calls = getattr(owner, name), []

        def stops(*args, _real=real, _calls=calls, **kwargs):
            out = _real(*args, **kwargs)
            _calls.append(1)
            if len(_calls) == 2 or (name == "append_events" and len(_calls) == 1):
                raise RuntimeError("stopped")
            return out

        monkeypatch.setattr(owner, name, stops)
        with pytest.raises(Exception, match="stopped"):
            curate.curate(curate.event_stream(spark, source), home, plan, cap=1).awaitTermination()
        monkeypatch.setattr(owner, name, real)
        curate.curate(curate.event_stream(spark, source), home, plan, cap=1).awaitTermination()
        runs = curate.Runs(spark, home)
        assert sorted(r.basename for r in runs.notes.read().collect()) == ["a", "b", "c"], name
        assert {r.status for r in runs.status().collect()} == {"processed"} and runs.notes.published().count() == 3
        assert runs.recover(plan) == []


def test_an_open_run_is_recovered(spark, tmp_path):
    home = str(tmp_path / "home")
    runs = curate.Runs(spark, home)
    assert runs.pending().count() == 0 and runs.manifests() == []
    snapshots.append_events(spark.createDataFrame([event(1, sha="a"), event(2, sha="b")], EVENT), home + "/log")
    assert runs.claim("run-1", 1) and [r.status for r in runs.status().orderBy("id").collect()] == ["processing", "inbox"]
    assert runs.recover(lambda e: e.select("id")) == ["run-1"] and runs.notes.read().count() == 1
    assert [(r.pos, r.run) for r in runs.claimed("run-1").collect()] == [(0, "run-1")]


def test_metrics_text(spark):
    rows = spark.createDataFrame([("m", 'a="1"', 2.0), ("m", "", 3.0)], "name string, labels string, value double")
    assert metrics.exposition(rows).first().text == '# TYPE m gauge\nm 3.0\nm{a="1"} 2.0'
