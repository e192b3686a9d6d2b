import random
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import neardup as N
from quillstream.session import written


def brute(rows, t=0.7, least=5):
    bags = {}
    for i, text in rows:
        words = regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())
        if len(words) >= least:
            bags[i] = Counter(words)
    ids = sorted(bags)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sum((bags[a] & bags[b]).values()) >= t * sum((bags[a] | bags[b]).values()) - 1e-9}


def corpus(seed=4, n=120):
    rng = random.Random(seed)
    common = ["the", "of", "note", "queue", "and", "reads", "open"]
    out = []
    for i in range(n):
        base = [rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))]
        out.append((len(out), " ".join(base)))
        for _ in range(rng.randrange(3)):
            copy = list(base)
            for _ in range(rng.randrange(1, 2 + len(copy) // 5)):
                at = rng.randrange(len(copy) + 1)
                rng.choice((lambda: copy.insert(at, rng.choice(common)), lambda: copy.pop(at) if at < len(copy) > 1 else None, lambda: rng.shuffle(copy)))()
            out.append((len(out), " ".join(copy)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    rows += [(9001, None), (9002, ""), (9003, "  \n"), (9004, "one two three four"), (9005, rows[0][1]), (9005, rows[0][1]), (9006, rows[0][1].upper() + "!"), (9007, "very long " * 5000), (9008, "very long " * 4900)]
    want = brute(rows)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "id long, text string, n int")
    found = N.near_duplicates({"a": df, "b": df.limit(0)})
    got = {(r.id_a, r.id_b) for r in N.all_pairs(found).where("field = 'a'").collect()}
    assert got == want
    assert N.all_pairs(found).where("field = 'b'").count() == 0


def test_variants_of_common_words_are_found_whole(spark):
    """Shared words in more records than any count of rare ones, and words of their own beside them."""
    rng = random.Random(7)
    shared = [f"base{i}" for i in range(40)]
    rows = [(i, " ".join(shared + [f"own{i}x{k}" for k in range(4)])) for i in range(100)]
    rows += [(1000 + i, " ".join(rng.sample(shared, 20))) for i in range(100)]
    rows += [(2000, " ".join(shared[:20])), (2001, " ".join(shared[:20] + [f"new{k}" for k in range(5)]))]
    want = brute(rows)
    assert len(want) >= 4951
    df = spark.createDataFrame(rows, "id long, text string")
    for block in (N.BLOCK, 30):
        found = N.near_duplicates({"f": df}, block=block)
        assert {(r.id_a, r.id_b) for r in N.all_pairs(found).collect()} == want


def test_groups_follow_links_and_copies_are_one_class(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    rows = [(1, base), (2, base), (3, base + " lambda"), (4, base + " lambda my ny"), (5, "nothing like the others at all here")]
    found = N.near_duplicates({"f": spark.createDataFrame(rows, "id long, text string")})
    got = {r.id: (r.rep, r.group_id, r.n_links) for r in N.groups(found).collect()}
    assert got == {1: (1, 1, 2), 2: (1, 1, 2), 3: (3, 1, 2), 4: (4, 1, 2)}
    empty = N.near_duplicates({"f": spark.createDataFrame([], "id long, text string")})
    assert N.groups(empty).count() == 0 and N.all_pairs(empty).count() == 0


def random_words(rng, vocabulary, n):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_small_vocabularies_lose_no_pair(spark):
    """Records of few different words, so that segments are shared by chance, beside planted pairs."""
    rng = random.Random(11)
    rows = []
    for vocabulary in (12, 60, 300):
        for _ in range(80):
            base = random_words(rng, vocabulary, rng.randrange(5, 90))
            copy = [w for w in base if rng.random() > 0.12] + random_words(rng, vocabulary, len(base) // 12)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    df = spark.createDataFrame(rows, "id long, text string")
    for part in (N.PART, 3000):
        found = N.near_duplicates({"f": df}, part=part)
        assert {(r.id_a, r.id_b) for r in N.all_pairs(found).collect()} == brute(rows)


def bag(rng, n, d):
    a = rng.integers(0, 2**48, n).astype(np.uint64)
    b = a.copy()
    b[rng.choice(n, d, replace=False)] = rng.integers(0, 2**48, d).astype(np.uint64)
    return np.sort(a), np.sort(b)


def signed(levels, e, level):
    sig, _, role = N.signatures(e, np.zeros(len(e), int), np.zeros(1, np.uint64), level, int(levels.segments[level]))
    return dict(zip(sig.tolist(), role.tolist()))


@settings(max_examples=80, deadline=None)
@given(st.integers(5, 400), st.integers(0, 10**6))
def test_two_records_that_differ_as_much_as_allowed_meet(n, seed):
    levels = N.Levels(0.7, 5)
    a, b = bag(np.random.default_rng(seed), n, int(0.3 / 1.7 * n))
    level = int(levels.home(np.array([n]))[0])
    one, two = signed(levels, a, level), signed(levels, b, level)
    assert any(one[s] & two[s] == 0 for s in one.keys() & two.keys())


def test_variants_alone_find_a_pair():
    """Pairs that meet in no whole segment, only by one with an element taken out."""
    levels, only = N.Levels(0.7, 5), 0
    for seed in range(200):
        a, b = bag(np.random.default_rng(seed), 60, 10)
        level = int(levels.home(np.array([60]))[0])
        one, two = signed(levels, a, level), signed(levels, b, level)
        roles = [(one[s], two[s]) for s in one.keys() & two.keys() if one[s] & two[s] == 0]
        assert roles
        only += all(x or y for x, y in roles)
    assert only > 0


def test_sketches_never_differ_more_than_records():
    rng = np.random.default_rng(3)
    for n, d in ((20, 4), (200, 30), (2000, 400)):
        a, b = bag(rng, n, d)
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        for words in (1, 4, 16):
            x, y = (N.sketch(e, np.zeros(n, int), 1, words) for e in (a, b))
            assert np.bitwise_count(x ^ y).sum() <= apart


def test_rounds_bound_the_bytes_sent_and_send_the_same():
    """At hundreds of parts a level the records' headers outweigh their signatures; a round still sends about SENT bytes a word."""
    rng, levels, n = np.random.default_rng(5), N.Levels(0.7, 5), 300
    sizes = rng.integers(60, 200, n)
    lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), rng.integers(-(2**62), 2**62, sizes.sum()))
    records = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(sizes.astype(np.int32)), pa.array(np.zeros(n, np.int64)), lists], ["class", "n", "tag", "words"])
    held = {level: (int((levels.home(sizes) == level).sum()), int(sizes[levels.home(sizes) == level].sum())) for level in set(levels.home(sizes).tolist())}
    parts, rounds = N.plan(levels, held, 100, N.SENT)
    count = sum(many for _, many in parts.values())
    assert [a for a, _ in rounds] == [0, *(b for _, b in rounds[:-1])] and rounds[-1][1] == count
    send = lambda a, b: [(p + a, d) for batch in N._sign(levels, parts, a, b)(iter([records])) for p, d in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist())]
    by_round = [send(a, b) for a, b in rounds]
    assert sorted(row for r in by_round for row in r) == sorted(send(0, count))
    sent = [sum(len(d) for _, d in r) for r in by_round]
    # the plan counts signatures as compressed
    assert sum(sent) > 3 * N.SENT * sizes.sum() and max(sent) < 1.6 * N.SENT * sizes.sum()


def test_many_rounds_lose_no_pair(spark):
    rows = corpus(seed=9, n=60)
    found = N.near_duplicates({"f": spark.createDataFrame(rows, "id long, text string")}, part=3000, sent=5)
    assert {(r.id_a, r.id_b) for r in N.all_pairs(found).collect()} == brute(rows)


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    """The round's signatures are off the disk before the next one is signed."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    data = lambda: {x for x in (str(b) for b in blocks.getAllFiles().mkString("\n").split("\n")) if x.endswith(".data") and "shuffle_" in x}
    before = data()
    kept = written(spark.range(1000).repartition(3, "id"))
    assert data() <= before and kept.count() == 1000


def test_short_records_of_one_template_are_told_apart_before_their_texts_are_joined():
    """Titles that share all but their names: a single word of sketch lets a tenth of those two elements too far apart pass."""
    rng, levels, n = np.random.default_rng(2), N.Levels(0.7, 5), 400
    words = np.concatenate([np.concatenate((np.arange(1, 9), rng.integers(100, 2**40, 2))) << 16 for _ in range(n)]).astype(np.int64)
    lists = pa.ListArray.from_arrays(np.arange(0, 10 * n + 1, 10).astype(np.int32), words)
    records = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.full(n, 10, np.int32)), pa.array(np.zeros(n, np.int64)), lists], ["class", "n", "tag", "words"])
    parts, _ = N.plan(levels, {int(levels.home(np.array([10]))[0]): (n, 10 * n)}, N.PART, N.SENT)
    rows = [(p, d) for batch in N._sign(levels, parts, 0, len(parts))(iter([records])) for p, d in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist())]
    met = set()
    for part in {p for p, _ in rows}:
        data = pa.RecordBatch.from_arrays([pa.array([d for p, d in rows if p == part], pa.binary())], ["data"])
        met |= {x for out in N._meetings(levels, N.BLOCK)(iter([data])) for x in zip(out.column("ca").to_pylist(), out.column("cb").to_pylist())}
    # no two of them are similar (8 of 12); all 79,800 pairs share signatures
    assert len(met) < 0.04 * n * (n - 1) / 2
