from pyspark.sql import functions as F

from quillstream.operators import graph, notes, packs, ranking
from quillstream.plans import notes as plans


def walk(seeds, links):
    """Distances from seeds (node to start), any number of hops."""
    out, depth = {}, 0
    while len(out) < len({*seeds, *(dst for _, dst in links)}) and depth <= len(links) + 2:
        level = {n for n, d in seeds.items() if d == depth} | {dst for src, dst in links if out.get(src) == depth - 1}
        out |= {n: depth for n in level if n not in out}
        depth += 1
    return out


def test_distances_have_no_bound(spark):
    links = [(i, i + 1) for i in range(110)] + [(200, 5), (201, 202)]
    seeds = {0: 0, 200: 1, 90: 1}
    want = walk(seeds, links)
    nodes = spark.createDataFrame([(i,) for i in [*range(111), 200, 201, 202]], "node int")
    got = graph.full_distances(nodes, spark.createDataFrame(list(seeds.items()), "node int, d int"), spark.createDataFrame(links, "src int, dst int"))
    assert {r.node: r.d for r in got.collect()} == {n: want.get(n, graph.UNREACHED) for n in [*range(111), 200, 201, 202]}
    assert want[89] > 80


def test_pack_scores_use_distances_of_any_length(spark, data):
    """The structure of a theme three or more hops from the seeds counts its hops."""
    own = plans.corpus(spark, data)
    links = notes.links(own)
    pairs = [(r.src, r.dst) for r in links.collect()]
    d = walk({r.note_id: r.d for r in ranking.seed_distances(own, links).collect()}, pairs)
    fit = packs.eligible(own).join(ranking.indegrees(links), "note_id", "left").collect()
    assert any(3 <= d.get(r.note_id, 0) for r in fit)
    most = max((sum(dst == r for _, dst in pairs) for r in {dst for _, dst in pairs}), default=0)
    frame = spark.createDataFrame([(r.note_id, d.get(r.note_id, graph.UNREACHED), r.indeg or 0, most) for r in fit], "note_id long, d int, indeg long, most long")
    structure = ranking.structural(*(frame[c] for c in ("d", "indeg", "most")), None)
    score = packs.pack_score(structure, F.col("updated"), F.get_json_object("frontmatter", "$.confidence"), F.lit(0), plans.REFERENCE)
    want = frame.join(own, "note_id").select("note_id", score.alias("score"))
    assert {r.note_id: r.score for r in plans.k_pack_scores(spark, data).collect()} == {r.note_id: r.score for r in want.collect()}


def test_short_lines_behind_many_long_ones_fill_the_pack(spark):
    rows = [("a", 0.9, 95)] + [(f"l{i:02}", 0.8, 20 + i) for i in range(10)] + [("y", 0.1, 3), ("z", 0.1, 3), ("zz", 0.05, 2)]
    df = spark.createDataFrame(rows, "path string, score double, tokens long")
    for block in (packs.BLOCK, 3, 1):
        assert [r.path for r in packs.fill_budget(df, 100, block=block).orderBy("pos").collect()] == ["a", "y", "zz"]
    assert [r.path for r in packs.fill_budget(df, 103, spent=3).orderBy("pos").collect()] == ["a", "y", "zz"]


def test_a_pack_is_within_its_budget(spark):
    rows = [(f"p{i:03}", 1 - i / 1000, f"- **T{i}** — words and more words  [p{i:03}]", "s") for i in range(400)]
    df = spark.createDataFrame(rows, "path string, score double, line string, content_sha256 string").withColumn("tokens", F.ceil((F.length("line") + 1 + 2) / 4).cast("long"))
    got = packs.pack_text(packs.fill_budget(df, 500, packs.frame_cost("main")), "main", "0" * 40).first()
    assert got.est_tokens <= 500 and got.note_count == len(got.inputs) > 20
    lines = [r.line for r in packs.pack_lines(spark.createDataFrame([(got.text,)], "text string")).collect()]
    assert len(lines) == got.note_count and lines[0] == rows[0][2]


def test_shares_other_than_one_half(spark):
    rows = [(f"h{i}", i / 10, True) for i in range(6)] + [(f"n{i}", i / 10, False) for i in range(6)]
    df = spark.createDataFrame(rows, "path string, score double, h boolean")
    for share, want in ((0.5, 6), (0.25, 2), (0.0, 0), (0.9, 6)):
        left = packs.capped_share(df, "h", share)
        assert left.where("h").count() == want and left.where("not h").count() == 6
    assert sorted(r.path for r in packs.capped_share(df, "h", 0.25).where("h").collect()) == ["h4", "h5"]
