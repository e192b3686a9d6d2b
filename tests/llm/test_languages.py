import random

import numpy as np
import pytest

from quillstream.llm import languages as L

WORDS = {
    "en": "the and of which people should find their house during winter because nobody knows where river goes", "de": "der und die welche leute sollten ihr haus während winter weil niemand weiß wohin fluss geht",
    "fr": "le et la que les gens devraient trouver leur maison pendant hiver parce que personne sait où rivière va", "es": "el y la que la gente debería encontrar su casa durante invierno porque nadie sabe adónde río va",
    "pt": "o e a que as pessoas deveriam achar sua casa durante inverno porque ninguém sabe onde rio vai não", "it": "il e la che le persone dovrebbero trovare loro casa durante inverno perché nessuno sa dove fiume va",
    "nl": "de en het die mensen moeten hun huis vinden tijdens winter omdat niemand weet waar rivier heen gaat", "ko": "그리고 사람들은 겨울 동안 집을 찾아야 한다 왜냐하면 아무도 강이 어디로 가는지 모른다",
}


def sentence(rng, lang, n=14):
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)
    out = []
    for i in range(320):
        lang = L.LANGUAGES[i % 8]
        label = lang if i % 11 else rng.choice([None, "", "und", L.LANGUAGES[(i + 3) % 8]])
        out.append((i, "\n\n".join(sentence(rng, lang) for _ in range(3)), label, [(0, lang)]))
    for i in range(320, 360):
        a, b = L.LANGUAGES[i % 8], L.LANGUAGES[(i + 1) % 8]
        out.append((i, sentence(rng, a) + " " + sentence(rng, a) + "\n \n" + sentence(rng, b), a, [(0, a), (1, a), (2, b)]))
    out += [(900, None, "en", []), (901, " \n", None, []), (902, "12 34 !!", "de", []), (903, "```\nfor x in y:\n    pass\n```", "en", None)]
    return out


def test_held_out_accuracy(spark, docs):
    df = spark.createDataFrame([(i, t, label, "x") for i, t, label, _ in docs], "doc_id long, text string, lang string, confidence string")
    got: dict = {}
    for r in L.languages(df).collect():
        got.setdefault(r.doc_id, []).append((r.seg, r.lang))
        assert r.confidence is None or 0 <= r.confidence <= 1
    want = [(i, s, x) for i, _, _, segments in docs if segments for s, x in segments]
    hit = sum((s, x) in got[i] for i, s, x in want)
    assert hit >= 0.97 * len(want)
    assert all(got[i] == [(0, None)] for i in (900, 901, 902))
    extra = sum(len(got[i]) > len(s) for i, _, _, s in docs if s)
    assert extra <= 5


def test_labels(spark):
    cases = {"English": "en", "en_GB": "en", "de-AT": "de", "ger": "de", " FR ": "fr", "español": "es", "한국어": "ko", "ja": "ja", "und": None, "??": None, "n/a": None, "": None, None: None, "unknown": None, "Dutch": "nl"}
    df = spark.createDataFrame([(k,) for k in cases], "l string")
    got = {r.l: r.c for r in df.select("l", L.label_code(df.l).alias("c")).collect()}
    assert got == cases


def test_found_and_empty(spark, docs):
    df = spark.createDataFrame([(i, t, label) for i, t, label, _ in docs], "doc_id long, text string, lang string")
    found = L.languages(df)
    wrong = {(r.doc_id, r.seg) for r in L.mislabelled(found.where("seg = 0")).collect()}
    want = {i for i, _, label, s in docs if s and (label in (None, "", "und") or label != s[0][1])}
    assert len({i for i, _ in wrong} ^ want) <= 4
    assert L.languages(df.limit(0)).collect() == []
    assert {r.lang for r in L.languages(df.where("lang = 'none'")).collect()} <= {None}


def test_blocks():
    text = "---\ntags: [a]\n---\n# Title\n\nuser: This is a line of real prose.\n \n```python\nx = 1\n\ny = 2\n```\n\n- [[a-b]]\n\nmore prose that is long enough here"
    assert [n for n, _, _ in L.blocks(text)] == [2, 6]
    assert [n for n, _, _ in L.blocks("# Only a heading")] == [1]
    assert L.blocks("") == [] and L.blocks("\n\n") == []


def test_mixture_keeps_a_weak_block_with_its_document():
    ll = np.array([[-100.0, -200.0], [-50.0, -140.0], [-30.0, -28.0], [-90.0, -40.0]])
    which, sure = L.infer(ll, np.array([0, 0, 0, 1]), 2)
    assert which.tolist() == [0, 0, 0, 1]


def test_short_blocks_of_mixed_documents_have_a_language(spark, docs):
    long = [(i, t, label) for i, t, label, _ in docs if i < 320]
    rng = random.Random(5)
    mixed = [(1000, sentence(rng, "en") + "\n\n" + sentence(rng, "de") + "\n\n- der fluss geht\n\n# Heading here\n\n- nobody knows", "en")]
    plain = [(1001, sentence(rng, "en") + "\n\n- der fluss geht", "en")]
    df = spark.createDataFrame(long + mixed + plain, "doc_id long, text string, lang string")
    got = {(r.doc_id, r.seg): r.lang for r in L.languages(df).where("doc_id >= 1000").collect()}
    assert got == {(1000, 0): got[(1000, 0)], (1000, 1): "en", (1000, 2): "de", (1000, 3): "de", (1000, 5): "en", (1001, 0): "en"}


def test_the_sample_is_bounded(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('some text ', id) as text", "'en' as lang")
    texts, codes = L.sample(df, "doc_id", "text", "lang", most=200)
    assert 130 < len(texts) == len(codes) < 280 and texts == L.sample(df.repartition(7), "doc_id", "text", "lang", most=200)[0]
