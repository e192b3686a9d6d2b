import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import bpe, packing

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def exact():
    import base64

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a", "aaaaaaaaaaaaa aaaa", "ababababab", "<|endoftext|>", "don't  stop\n\n", "한국어 텍스트", "é é", "👩‍💻", "x" * 3000, "\x00\t", "123456 7890", "...!!!???", None]


def test_ids_equal_the_public_tokenizer(spark, exact):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("abcdefgh  .,'\nÄö한글12") for _ in range(rng.randrange(300))) for _ in range(200)] + ["word " * 20_000]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode(df, out="ids").collect()}
    assert all(got[i] == (exact.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    counts = {r.doc_id: (r.n, r.ids) for r in bpe.count_tokens(df, out="n").collect()}
    assert all(counts[i] == (len(got[i]), "kept") for i in got)


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "one two"), (1, "one two")], "doc_id long, text string")
    assert [r.ids for r in bpe.encode(df).collect()] == [[505, 734]] * 2 or bpe.encode(df).count() == 2
    assert bpe.encode(df.limit(0)).collect() == []


def test_documents_of_the_data(spark, data, exact):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.encode(docs).collect():
        assert r.ids == (exact.encode_ordinary(texts[r.doc_id]) if texts[r.doc_id] else [])
        assert exact.decode(r.ids) == (texts[r.doc_id] or "")


def check_packing(rows, sizes, capacity):
    used, places, pieces = {}, set(), {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.size
        assert (r.container, r.place) not in places
        places.add((r.container, r.place))
        pieces.setdefault(r.item_id, []).append((r.start, r.size))
    assert all(v <= capacity for v in used.values())
    for i, n in sizes.items():
        own = sorted(pieces.get(i, []))
        assert sum(s for _, s in own) == max(0, n or 0)
        assert len(own) == -(-max(0, n or 0) // capacity)
        assert [s for s, _ in own] == [k * capacity for k in range(len(own))]
    return sum(used.values()) / (capacity * max(1, len(used)))


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(5)
    sizes = {i: rng.choice([rng.randrange(1, 60), rng.randrange(40, 400), rng.randrange(300, 2048), rng.randrange(2049, 9000)]) if i % 7 else rng.choice([0, None, 1, 2048, 1024, 2049]) for i in range(3000)}
    df = spark.createDataFrame([(i, n, 1) for i, n in sizes.items()], "doc_id long, n int, place int")
    fill = check_packing(packing.pack(df, "doc_id", "n").collect(), sizes, 2048)
    assert fill > 0.93
    grouped = packing.pack(df.repartition(7), "doc_id", "n", group_rows=500)
    check_packing(grouped.collect(), sizes, 2048)
    again = packing.pack(df.repartition(3), "doc_id", "n", group_rows=500)
    assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, again.collect()))


def test_harmonic_classes_hold_a_fixed_count(spark):
    df = spark.range(1000).select("id", F.lit(300).alias("n"))  # class 6 of 2048
    per = [r["count"] for r in packing.pack(df, "id", "n").groupBy("container").count().collect()]
    assert sorted(set(per)) == [4, 6] and per.count(4) == 1


def test_packing_of_nothing_and_of_repeats(spark):
    none = spark.createDataFrame([], "id long, n int")
    assert packing.pack(none, "id", "n").count() == 0
    twice = spark.createDataFrame([(1, 5), (1, 5), (None, 7)], "id long, n int")
    assert sorted(r["size"] for r in packing.pack(twice, "id", "n").collect()) == [5, 5, 7]


def test_classes_by_count_alone():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 2049, 3000)
    bins, place = packing.pack_group(np.arange(3000), np.zeros(3000, np.int64), sizes, 2048, top_up=False)
    assert np.bincount(bins, sizes).max() <= 2048 and bins.min() == 0
    for b in np.unique(bins):
        own = bins == b
        k = 2048 // sizes[own]
        assert len(set(k.tolist())) == 1 and own.sum() <= k[0] and sorted(place[own]) == list(range(own.sum()))


def test_remembered_pairs_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    with open(bpe.VOCABULARY, "rb") as f:
        data = f.read()
    few, many = bpe.Encoder(data), bpe.Encoder(data)
    texts = ["some words of a text", None, "", "other words, 12 of them"]
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    got = list(few.batch(texts))
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 500_000)
    assert got == list(many.batch(texts))
