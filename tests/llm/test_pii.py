import math
import random

import pytest
from pyspark.sql import functions as F

from quillstream.llm import pii as P

GIVEN = frozenset(["tom", "ada", "lena"])


@pytest.fixture(scope="module")
def weights():
    return dict(P.fitted())


def said(text, weights):
    return [(k, text[a:b]) for a, b, k, _ in P.find(text, GIVEN, weights)]


CASES = {
    "Write to x.y+z@mail.host.example, please.": [("email", "x.y+z@mail.host.example")],
    "[me](mailto:a_b [at] host.org) and <C@D.NET>": [("email", "a_b [at] host.org"), ("email", "C@D.NET")],
    "abc (at) mail dot host dot example; ok": [("email", "abc (at) mail dot host dot example")],
    "Call +44 20 7946 0551 ext. 12 or tel:(555) 123-4567.": [("phone", "+44 20 7946 0551"), ("phone", "(555) 123-4567")],
    "Im Notfall 030/23125-980 anrufen.": [("phone", "030/23125-980")],
    "SSN: 938 30 3769. Remove the passport (C9670456).": [("id", "938 30 3769"), ("id", "C9670456")],
    "주민등록번호: 711224-9996443": [("id", "711224-9996443")],
    "Meet at 57 Foral St at nine.": [("address", "57 Foral St")],
    "Treffpunkt ist Am Kosubruplatz 177 um neun.": [("address", "Am Kosubruplatz 177")],
    "Colis à envoyer au 9 bis, avenue de Veha, 00755 Vufi.": [("address", "9 bis, avenue de Veha")],
    "주소: 달누리로 101번길 35": [("address", "달누리로 101번길 35")],
    "According to Ada Brunel the run is fine.": [("name", "Ada Brunel")],
    "Dr. Orva Mibro-Fitru asked for it.": [("name", "Orva Mibro-Fitru")],
    "Signed, T. Karos <t@k.example>": [("name", "T. Karos"), ("email", "t@k.example")],
    "The Lane Index and the Court Digest are packs.": [],
    "Rose chart, Tom site, Ada period.": [],
    "git clone git@forge:kb/notes; worker@queue3; x-pack@2.3.1; @curator": [],
    "Budget was 900 12 4411 units. Version 555.0101.2, run 20250304-5550142, 10.0.31.7, 45-678-9012.": [],
    "작업의 하나로 28번 실패한 뒤에": [],
    "": [],
}


@pytest.mark.parametrize("text,want", CASES.items())
def test_cases(text, want, weights):
    assert said(text, weights) == want


def test_fit_on_held_out_sentences(weights):
    rng = random.Random(12345)
    given = frozenset(["alma", "boris", "chiara", "dora", "edgar", "flora"])
    data = rng.sample(P._practice(rng), 600)
    right = sum({(a, b, k) for a, b, k, _ in P.find(t, given, weights)} == set(s) for t, s in data)
    assert right >= 0.97 * len(data)


def test_programme_against_all_sets():
    spans = [(0, 3, "a", ("x",)), (2, 5, "b", ("y",)), (5, 8, "c", ("z",)), (3, 5, "d", ("x", "y"))]
    w = {"x": 0.7, "y": -0.2, "z": 1.1}
    sets = [s for m in range(16) for s in [[spans[i] for i in range(4) if m >> i & 1]] if all(a[1] <= b[0] or b[1] <= a[0] for i, a in enumerate(s) for b in s[i + 1 :])]
    score = lambda s: sum(w[f] for x in s for f in x[3])
    z = sum(math.exp(score(s)) for s in sets)
    assert score(P.best_spans(spans, w)) == pytest.approx(max(map(score, sets)))
    for span, p in zip(*P.marginals(spans, w)):
        assert p == pytest.approx(sum(math.exp(score(s)) for s in sets if span in s) / z)


def test_tables(spark, weights):
    names = spark.createDataFrame([("Ada",), (None,)], "given_name string")
    texts = [*CASES, None, "  ", "no one here. " * 20_000 + "Call +44 20 7946 0551 now."]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate([*texts, texts[0]])], "id long, text string, masked string")
    given = frozenset(["ada"])
    want = {(i, t[a:b]) for i, t in enumerate(texts) if t for a, b, _, _ in P.find(t, given, weights)} | {(len(texts), v) for _, v in said(texts[0], weights)}
    assert {(r.rec_id, r.value) for r in P.found(df, "id", "text", names).collect()} == want
    masked = {r.id: r.masked for r in P.masked(df, "text", names).collect()}
    assert masked[0] == "Write to [EMAIL], please." and masked[len(texts) - 3] is None and len(masked) == len(texts) + 1
    assert all(masked[i] == P.mask(t, P.find(t, given, weights)) for i, t in enumerate(texts) if t)
    assert P.found(df.limit(0), "id", "text", names).count() == 0 and P.masked(df.limit(0), "text", names).count() == 0


ADDRESS_FORMS = [
    *(f"12 {p}Mill{q} {t}" for p in ("", "North ", "Old ") for q in ("", " Hill", "-é") for t in "Street St Road Rd Avenue Ave Drive Lane Ln Court Ct Boulevard Blvd Way Place Square Terrace Close".split()),
    *(f"{p}Linden{t} {n}" for p in ("", "Am ", "An der ") for t in "straße strasse str. weg gasse allee platz ring damm ufer -Allee -Straße -Platz -Weg -Ring -Gasse".split() for n in ("7", "12 b", "1234")),
    *(f"{n} {t} {p}{q}" for n in ("7", "12 bis", "3b", "12,", "9 ter,") for t in "rue avenue boulevard place impasse quai chemin allée cours route passage".split() for p in ("", "de la ", "d’") for q in ("Paix", "Évian Été")),
    *(f"{t} {p}{q}{c} 12" for t in "C/ Calle Avenida Avda Avda. Plaza Paseo Camino Ronda Via Viale Piazza Corso Vicolo Rua Travessa Praça".split() for p in ("", "de la ", "do ") for q in ("Sol", "Bogotá", "Inê", "Sol Ñu", "SOL", "Mar’", "Mar-") for c in ("", ",")),
    *(f"Kerk{t} {n}" for t in "straat laan plein gracht kade dijk singel".split() for n in ("7", "7 a", "7-12")),
    *(f"세종{t}{b}{n}" for t in ("대로", "로", "길") for b in ("", " ") for n in ("12", "12번길 3", "12-3")),
]


def test_every_address_pattern_passes_its_gate(spark):
    texts = [f"{before}{form}{after}" for form in ADDRESS_FORMS for before in ("", "\n", "(", "\t", "x: ") for after in ("", ")", "\n", ", y")]
    held = [t for t in texts if any(k == "address" for _, _, k, _ in P.candidates(t, frozenset(), ["address"]))]
    assert {t for t in ("Avenida de la Sol, 12", "(Calle Bogotá 12", "\tRua Inê 12")} <= set(held) and len(held) > len(texts) // 2
    bit = 1 << list(P.GATES).index("address")
    df = spark.createDataFrame([(t,) for t in held], "text string")
    assert [r.text for r in df.where(P._gated(F.col("text")).bitwiseAND(F.lit(bit)) == 0).collect()] == []
