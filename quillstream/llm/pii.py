"""Personal information in free text: a semi-Markov conditional random field over whole spans.

Candidate spans come from patterns per kind (every sub-span of a run of capitalised words for names). Each is scored
by features of the whole span: its shape, its words, the cues to its left and right. A dynamic programme over span
boundaries then chooses, jointly, the best set of spans that do not overlap, with their types; text outside has score 0.
The weights are fitted here, on sentences made from the patterns below, by maximum likelihood: the same programme, in
log space, gives the partition function and the spans' marginals.

Built-in patterns decide first, per row, which kinds can occur at all; other rows never leave the JVM.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.session import settled

KINDS = ("email", "phone", "id", "address", "name")
#: A name has at most this many words; the list of given names at most this many entries.
MAX_NAME_WORDS, MAX_GIVEN = 4, 100_000

# Words that stand beside a kind, per side.
CUES = {
    "name<": "cordialement saludos atentamente regards sincerely cheers saluti cumprimentos groeten according to talked spoke after from by name is signed reviewed-by reviewed attn attention laut selon según segun ist heiße grüßen gruß m'appelle llamo chamo chiamo heet 담당자 작성자는 작성자 secondo segundo volgens dear hi hello hallo bonjour hola liebe lieber contact owner author mit von par por di da van door asked thanks",
    "name>": "wrote asked wants wanted said left joined hat pide demande a escribió ist tout todo 님 님이 님이다 ha schreef vraagt vroeg heeft pediu escreveu ha schrieb fragte sagte and und y et e en the",
    "title<": "mr mrs ms dr prof mme m mlle herr frau sr sra señor señora sig signora dhr mevr don doña",
    "phone<": "call texted text phone tel fax voice number reach dial ring on-call mobile cell anrufen rückruf unter telefon notfall appeler appelez numéro llamar teléfono ligar chiamare bellen 전화 막히면 연락처 week",
    "phone>": "ext extension after anrufen erbeten en si when durchwahl 번호로",
    "id<": "ssn social security insurance ni national passport id identity tax no number steuer-id steuernummer steuer ausweisnummer personalausweis ausweis passeport pasaporte dni nie nif sécurité sociale fiscal 주민등록번호 주민번호 여권번호 held form shows codice fiscale bsn",
    "id>": "as ssn social security insurance passport pasted ausweisnummer steuer-id steuer stand figure aparece 값이 ni national id",
    "address<": "meet moved office at site address lives home backup ship treffpunkt wohnhaft paket geht an adresse domicile colis domicilio caja envoyer mandar 주소 상자는 indirizzo morada adres",
    "address>": "last at um 주소로",
    "other<": "version run budget pages page ticket commit port gateway part iso coordinates took key build release sha line lines limit",
    "other>": "units items lines cable wins minutes was attempts",
}
_CUE = {side: {w: k[:-1] for k, words in CUES.items() if k[-1] == side for w in words.split()} for side in "<>"}
_CUES = {side: {} for side in "<>"}
for _k, _words in CUES.items():
    for _w in _words.split():
        _CUES[_k[-1]].setdefault(_w, set()).add(_k[:-1])

# First words of sentences and other capitalised words that begin no name.
NO_NAMES = frozenset(
    "cordialement saludos atentamente regards sincerely cheers thanks saluti cumprimentos groeten the a an this that our my their at in on by for after before during since last every each as meet main rose without send remove ship talked according signed call texted ask see home scanned attn reply-to "
    "das der die ein eine einen unser unsere jeder jede wie vor nach seit am im in während letzte ohne vorerst bitte laut mit mein treffpunkt paket rückfragen tel adresse wohnhaft "
    "le la les un une notre chaque après avant depuis pendant en par selon mme m contact domicile colis el los las una nuestro cada antes después desde durante por según me mandar correo domicilio "
    "il lo gli uno ogni dopo prima o os as uma nosso antes depois de het een onze elke na voor sinds monday tuesday wednesday thursday friday saturday sunday montag dienstag mittwoch donnerstag freitag samstag sonntag".split()
)
#: Capitalised words that end no name.
NO_FAMILIES = frozenset("street st road rd avenue ave drive lane court boulevard way place square index digest team page chart site period grüßen name export paket protokoll entwurf queue ledger linter cursor bundle manifest anchor sentinel heading transcript".split())

_W = r"\p{Lu}[\p{L}\p{M}]*(?:['’]\p{L}+)?(?:-\p{Lu}[\p{L}\p{M}]+)*"
_NAME_TOKEN = regex.compile(rf"{_W}\.?")
_NAME_RUN = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._/-])(?:{_W}\.?)(?:,?[  ](?:(?:de|del|da|di|van|von|der|den|la|le)[ ])?(?:{_W}\.?))+")
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_DOT = r"(?:\.|[ ](?:dot|punkt|punto|point)[ ]|[ ]?[\[(](?:dot|punkt|punto|point)[\])][ ]?)"
_LOCAL = rf"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+])?(?:[ ]dot[ ]{_LABEL})?"
_HOST = rf"{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}"
_EMAIL = regex.compile(rf"(?<![A-Za-z0-9._%+-])(?:{_LOCAL}(?:@|＠|[ ]?[\[({{](?:at|AT|@)[\])}}][ ]?){_HOST}|{_LABEL}(?:[._+-]{_LABEL})*[ ](?:at|AT)[ ]{_LABEL}(?:[ ](?:dot|DOT)[ ]{_LABEL})+)(?![A-Za-z0-9])")
_EDGE_L, _EDGE_R = r"(?<![\p{L}\p{N}_+.,/-]|\d[ ])", r"(?![\p{L}\p{N}_]|[-./,]\d|[ ]\d)"
_LOOSE_L, _LOOSE_R = r"(?<![\p{L}\p{N}_+./-])", r"(?![\p{L}\p{N}_]|[-./]\d)"
NUMBERS = [
    ("phone", "plus", r"\+\d{1,3}(?:[ ./-]?\(\d{1,5}\)|[ ./-]?\d{1,8})(?:[ ./-]?\d{1,8}){0,6}"),
    ("phone", "00", r"00\d{2}[ ]\d{1,4}(?:[ ./-]?\d{2,8}){1,4}"),
    ("phone", "brackets", r"\(\d{2,5}\)[ ]?\d{2,4}(?:[ ./-]?\d{2,4}){1,3}"),
    ("phone", "three", r"\d{3}([-. ])\d{3}\1\d{4}"),
    ("phone", "area", r"0\d{1,4}[ /-]\d{4,8}(?:-\d{1,4})?"),
    ("phone", "pairs", r"0\d(?:[. -]\d{2}){4}"),
    ("phone", "mobile", r"01\d[- .]\d{3,4}[- .]\d{4}"),
    ("phone", "nine", r"[679]\d{2}[ .-]\d{3}[ .-]\d{3}|[679]\d{2}(?:[ .-]\d{2}){3}"),
    ("id", "ssn-", r"\d{3}-\d{2}-\d{4}"),
    ("id", "ssn_", r"\d{3}[ ]\d{2}[ ]\d{4}"),
    ("id", "ni", r"[A-Z]{2}[ ]?\d{2}[ ]?\d{2}[ ]?\d{2}[ ]?[A-D]"),
    ("id", "pass", r"[A-Z]\d{7,8}"),
    ("id", "pass2", r"\d{2}[A-Z]{2}\d{5}|[A-Z]{2,3}\d{6,7}"),
    ("id", "tax", r"\d{2}[ ]\d{3}[ ]\d{3}[ ]\d{3}"),
    ("id", "secu", r"\d[ ]\d{2}[ ]\d{2}[ ]\d{2}[ ]\d{3}[ ]\d{3}(?:[ ]\d{2})?"),
    ("id", "dni", r"\d{8}-?[A-Z]"),
    ("id", "nie", r"[XYZ]-?\d{7}-?[A-Z]"),
    ("id", "rrn", r"\d{6}-\d{7}"),
    ("id", "fiscal", r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]"),
    ("id", "digits", r"\d{9,11}|\d{3}[ .]\d{3}[ .]\d{3}"),
]
_NUMBERS = [(k, s, regex.compile((_EDGE_L if s in ("ssn_", "tax", "secu", "digits") else _LOOSE_L) + f"(?:{p})" + (_EDGE_R if s in ("ssn_", "tax", "secu", "digits", "three") else _LOOSE_R))) for k, s, p in NUMBERS]
_P = r"\p{Lu}[\p{L}'’-]+"
ADDRESSES = [
    ("en", rf"\d{{1,5}}[a-z]?[ ](?:(?:North|South|East|West|Old|New|Upper|Lower|Great)[ ])?{_P}(?:[ ]{_P})?[ ](?:Street|St|Road|Rd|Avenue|Ave|Drive|Lane|Ln|Court|Ct|Boulevard|Blvd|Way|Place|Square|Terrace|Close)"),
    ("de", r"(?:(?:Am|Im|Zum|Zur|An der|Auf dem|In der)[ ])?\p{Lu}[\p{L}-]*?(?:straße|strasse|str\.|weg|gasse|allee|platz|ring|damm|ufer|-Allee|-Straße|-Platz|-Weg|-Ring|-Gasse)[ ]\d{1,4}(?:[ ]?[a-z])?"),
    ("fr", rf"\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[a-d]))?,?[ ](?:rue|avenue|boulevard|place|impasse|quai|chemin|allée|cours|route|passage)[ ](?:(?:de la|de l['’]|du|des|de|d['’]|la|le|les)[ ]?)?{_P}(?:[ ]{_P})?"),
    ("es", rf"(?:C/|Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda|Via|Viale|Piazza|Corso|Vicolo|Rua|Travessa|Praça)[ ](?:(?:de la|de los|de las|del|de|da|do|dos|das|della|dei)[ ])?{_P}(?:[ ]{_P})?,?[ ]\d{{1,4}}(?:[ ]?[a-z])?"),
    ("nl", r"\p{Lu}[\p{L}-]*(?:straat|laan|plein|gracht|kade|dijk|singel)[ ]\d{1,4}(?:[ ]?[a-z])?(?:-\d{1,3})?"),
    ("ko", r"[가-힣]{1,8}(?:대로|로|길)[ ]?\d{1,4}(?:번길[ ]?\d{1,4}(?:-\d{1,4})?|-\d{1,4})?(?![번줄개분시월일년]|-?\d)"),
]
_ADDRESSES = [(s, regex.compile(rf"(?<![\p{{L}}\p{{N}}_/.-]){p}(?![\p{{L}}\p{{N}}_])" if s != "ko" else rf"(?<![\p{{L}}\p{{N}}]){p}")) for s, p in ADDRESSES]
_TOKEN = regex.compile(r"[\p{L}\p{M}\p{N}'’-]+")

#: By kind, what a text must hold for it to occur: one of the strings (if any are named), and the Java pattern.
GATES = {
    "mail": (("@", "＠", "at]", "at)", "at}", "AT]", "AT)", "AT}", " dot ", " DOT "), r"@|＠|[\[({](?:at|AT)[\])}]|(?i: at [a-z0-9-]+ dot )"),
    "number": ((), r"\d[\d ().\-/]{5,}\d|[A-Z]{1,3}[ -]?\d{2}[ ]?\d{2}|\d{2}[A-Z]{2}\d{5}|\d{8}-?[A-Z]|[A-Z]{6}\d{2}[A-Z]"),
    "address": (
        (
            " St", " Road", " Rd", " Ave", " Drive", " Lane", " Ln", " Court", " Ct", " Boulevard", " Blvd", " Way", " Place", " Square", " Terrace", " Close",
            "straße ", "strasse ", "str. ", "weg ", "gasse ", "llee ", "platz ", "ring ", "damm ", "ufer ", "straat ", "laan ", "plein ", "gracht ", "kade ", "dijk ", "singel ", "-Straße ", "-Platz ", "-Weg ", "-Ring ", "-Gasse ",
            "rue ", "avenue ", "boulevard ", "place ", "impasse ", "quai ", "chemin ", "allée ", "cours ", "route ", "passage ",
            "C/ ", "Calle ", "Avenida ", "Avda", "Plaza ", "Paseo ", "Camino ", "Ronda ", "Via ", "Viale ", "Piazza ", "Corso ", "Vicolo ", "Rua ", "Travessa ", "Praça ", "로", "길",
        ),
        r"\d[a-z]? (?:\p{Lu}[\p{L}'’-]+ ){1,3}(?:St|R|A|D|L|C|B|W|P|S|T)|[\p{L}.'’-] \d{1,4}|\d,? ?(?:bis|ter|quater|[a-d])?,? [a-zé]{3,9} |[가-힣] ?\d|, \d",
    ),
    "name": ((), r"\p{Lu}[\p{L}\p{M}.'’-]* (?:[a-z]{2,3} )?\p{Lu}[\p{L}\p{M}.]|\p{Lu}\p{L}+, \p{Lu}\p{L}"),
}

Span = tuple[int, int, str, tuple[str, ...]]


def _sides(text: str, start: int, end: int) -> tuple[set[str], set[str]]:
    """Kinds whose cues stand among the three words to either side, within the line."""
    left = text[max(0, start - 40) : start]
    left = left[left.rfind("\n") + 1 :]
    before = [w.lower() for w in _TOKEN.findall(left)][-3:]
    right = text[end : end + 30].split("\n", 1)[0]
    after = [w.lower() for w in _TOKEN.findall(right)][:3]
    return set().union(*(_CUES["<"].get(w, ()) for w in before)), set().union(*(_CUES[">"].get(w, ()) for w in after))


def _features(text: str, start: int, end: int, kind: str, shape: str) -> tuple[str, ...]:
    left, right = _sides(text, start, end)
    near = left | right
    out = [kind, f"{kind}:{shape}"]
    out += [f"{kind}:{shape}:{'cue' if kind in near else 'no'}", f"{kind}{'+' if 'other' in near and kind not in near else '-'}other"]
    return tuple(out)


def _name_features(text: str, start: int, end: int, words: list[str], given: frozenset[str], reverse: bool) -> tuple[str, ...]:
    before = text[max(0, start - 30) : start]
    before = before[before.rfind("\n") + 1 :]
    left = [w.lower() for w in _TOKEN.findall(before)][-2:]
    after = text[end : end + 24].split("\n", 1)[0]
    right = [w.lower() for w in _TOKEN.findall(after)][:1]
    first, last = (words[-1], words[0]) if reverse else (words[0], words[-1])
    gaz = first.rstrip(".").lower() in given
    cue_l = bool(left) and any("name" in _CUES["<"].get(w, ()) for w in left[-1:])
    title = bool(left) and any("title" in _CUES["<"].get(w, ()) for w in left[-1:])
    cue_r = bool(right) and "name" in _CUES[">"].get(right[0], ())
    cut = not before.strip() or before.rstrip()[-1:] in ".!?:;|<([-*>\"“„,"
    initial = len(first.rstrip(".")) == 1
    out = ["name", f"name:{len(words)}{'r' if reverse else ''}:{'gaz' if gaz else 'init' if initial else 'open'}"]
    who = "gaz" if gaz else "init" if initial else "open"
    out.append(f"name:{who}:{'title' if title else 'cue' if cue_l else 'cut' if cut else 'none'}<")
    out.append(f"name:{who}:{'cue' if cue_r else 'mail' if after.lstrip()[:1] == '<' else 'none'}>")
    if cue_l or title:
        out.append("name:cue<")
    if cut:
        out.append("name:cut<")
    if cue_r:
        out.append("name:cue>")
    if any(w.rstrip(".").lower() in NO_NAMES for w in words):
        out.append("name:noname")
    if last.lower() in NO_FAMILIES:
        out.append("name:nofamily")
    if len(last.rstrip(".")) < 2:
        out.append("name:short")
    if any(w.rstrip(".").lower() in given for w in (words if reverse else words[1:])) and not (reverse and gaz):
        out.append("name:inner")
    if any(len(w.rstrip(".")) > 1 and w.endswith(".") for w in words):
        out.append("name:dot")
    if any(len(w) > 1 and w.isupper() for w in words) and not all(len(w.rstrip(".")) == 1 or w.isupper() for w in words):
        out.append("name:mixedcase")
    if before.lstrip().startswith("#"):
        out.append("name:heading")
    return tuple(out)


def candidates(text: str, given: frozenset[str], gates: Iterable[str] = tuple(GATES)) -> list[Span]:
    """(start, end, kind, features) of every candidate span."""
    out: list[Span] = []
    if "mail" in gates:
        for m in _EMAIL.finditer(text):
            shape = "plain" if "@" in m[0] else "spelt" if " dot " in m[0].lower() else "bracket"
            out.append((m.start(), m.end(), "email", ("email", f"email:{shape}")))
    if "number" in gates:
        for kind, shape, pattern in _NUMBERS:
            for m in pattern.finditer(text, overlapped=False):
                digits = sum(c.isdigit() for c in m[0])
                if kind != "phone" or 7 <= digits <= 15:
                    out.append((m.start(), m.end(), kind, _features(text, m.start(), m.end(), kind, shape)))
    if "address" in gates:
        for shape, pattern in _ADDRESSES:
            for m in pattern.finditer(text):
                out.append((m.start(), m.end(), "address", _features(text, m.start(), m.end(), "address", shape)))
    if "name" in gates:
        for run in _NAME_RUN.finditer(text):
            tokens = [(run.start() + t.start(), run.start() + t.end(), t[0]) for t in _NAME_TOKEN.finditer(run[0])]
            # a final full stop belongs to the sentence unless it ends an initial
            tokens = [(s, e - 1, w[:-1]) if w.endswith(".") and len(w) > 2 and w[:-1].lower() not in _CUES["<"] else (s, e, w) for s, e, w in tokens]
            for i in range(len(tokens)):
                for j in range(i + 1, min(len(tokens), i + MAX_NAME_WORDS)):
                    words = [w for _, _, w in tokens[i : j + 1]]
                    inside = text[tokens[i][0] : tokens[j][1]]
                    commas = inside.count(",")
                    if commas and not (commas == 1 and len(words) >= 2 and inside.startswith(words[0] + ",")):
                        continue
                    if "." in inside.replace(words[-1], "") and any(len(w) > 2 and w.endswith(".") for w in words):
                        continue
                    out.append((tokens[i][0], tokens[j][1], "name", _name_features(text, tokens[i][0], tokens[j][1], words, given, bool(commas))))
    return out


def _chain(spans: list[Span]) -> tuple[list[Span], list[int]]:
    """Spans by end, and for each how many end at or before its start."""
    spans = sorted(spans, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in spans]
    return spans, [bisect_right(ends, s[0], 0, i) for i, s in enumerate(spans)]


def best_spans(spans: list[Span], weights: dict[str, float]) -> list[Span]:
    """The set of spans without overlap whose scores add up to most."""
    spans, prior = _chain(spans)
    best, taken = [0.0], []
    for s, p in zip(spans, prior):
        gain = best[p] + sum(weights.get(f, 0.0) for f in s[3])
        taken.append(gain > best[-1])
        best.append(max(gain, best[-1]))
    out, i = [], len(spans)
    while i:
        if taken[i - 1]:
            out.append(spans[i - 1])
            i = prior[i - 1]
        else:
            i -= 1
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def marginals(spans: list[Span], weights: dict[str, float]) -> tuple[list[Span], list[float]]:
    """Spans and the probability of each, over all sets without overlap."""
    spans, prior = _chain(spans)
    score = [sum(weights.get(f, 0.0) for f in s[3]) for s in spans]
    ahead = [0.0]
    for s, p in zip(score, prior):
        ahead.append(_log_add(ahead[-1], ahead[p] + s))
    total = ahead[-1]
    # mass[i]: probability that the first i spans are decided with nothing open, passed down from the end
    mass = [0.0] * (len(spans) + 1)
    mass[-1] = 1.0
    out = [0.0] * len(spans)
    for i in range(len(spans), 0, -1):
        take = math.exp(min(0.0, ahead[prior[i - 1]] + score[i - 1] - ahead[i]))
        out[i - 1] = mass[i] * take
        mass[prior[i - 1]] += out[i - 1]
        mass[i - 1] += mass[i] * (1 - take)
    assert total >= 0
    return spans, out


def _practice(rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their spans, made by filling slots; invented names and numbers throughout."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    syl = lambda n: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(n))
    cap = lambda n: syl(n).capitalize()
    known = ["Alma", "Boris", "Chiara", "Dora", "Edgar", "Flora"]

    def name() -> str:
        first = rng.choice([rng.choice(known)] * 5 + [cap(2) + "a", cap(3), rng.choice(known) + f" {rng.choice('ABCDEGHKLMNPRST')}.", f"{rng.choice('ABCDEGHKLMNPRST')}."])
        last = cap(rng.choice((2, 3))) + rng.choice(("", "n", "r", "s", "l")) + (f"-{cap(3)}" if rng.random() < 0.15 else "")
        if rng.random() < 0.08 and not first.endswith("."):
            return f"{last}, {first}"
        both = f"{first} {last}"
        return both.upper() if rng.random() < 0.06 else both

    def phone() -> str:
        return rng.choice([f"+{digit(2)} {digit(2)} {digit(4)} {digit(4)}", f"+1 ({digit(3)}) {digit(3)}-{digit(4)}", f"+1{digit(10)}", f"{digit(3)}-{digit(3)}-{digit(4)}", f"({digit(3)}) {digit(3)} {digit(4)}", f"{digit(3)}.{digit(3)}.{digit(4)}", f"0{digit(2)}/{digit(5)}-{digit(3)}", f"00{digit(2)} {digit(2)} {digit(8)}", f"01{digit(3)} {digit(6)}", f"0{digit(1)}.{digit(2)}.{digit(2)}.{digit(2)}.{digit(2)}", f"010-{digit(4)}-{digit(4)}", f"+33 1 {digit(2)} {digit(2)} {digit(2)} {digit(2)}", f"+34 {digit(3)} {digit(2)} {digit(2)} {digit(2)}", f"+49 {digit(2)} {digit(5)} {digit(3)}", f"6{digit(2)} {digit(3)} {digit(3)}"])

    def ident() -> tuple[str, str]:
        return rng.choice([(f"{digit(3)}-{digit(2)}-{digit(4)}", "SSN"), (f"{digit(3)} {digit(2)} {digit(4)}", "social security no."), (f"QQ {digit(2)} {digit(2)} {digit(2)} {rng.choice('ABCD')}", "NI number"), (f"QQ{digit(6)}{rng.choice('ABCD')}", "national insurance"), (f"{rng.choice('CPLX')}{digit(rng.choice((7, 8)))}", "passport"), (f"{digit(2)} {digit(3)} {digit(3)} {digit(3)}", "Steuer-ID"), (f"{digit(1)} {digit(2)} {digit(2)} {digit(2)} {digit(3)} {digit(3)}", "numéro de sécurité sociale"), (f"{digit(8)}{rng.choice('ABKLMX')}", "DNI"), (f"X-{digit(7)}-{rng.choice('ABKL')}", "NIE"), (f"{digit(6)}-{digit(7)}", "주민등록번호"), (f"{digit(2)}XX{digit(5)}", "passeport"), (f"{digit(9)}", "BSN")])

    def address() -> str:
        n = str(rng.randint(2, 240)) + rng.choice(("", "", "", "a", "b"))
        return rng.choice([f"{n} {cap(3)} {rng.choice(('Street', 'St', 'Road', 'Avenue', 'Drive'))}", f"{n} {rng.choice(('Old', 'North'))} {cap(3)} {rng.choice(('Lane', 'Court'))}", f"{cap(3)}{rng.choice(('straße', 'weg', 'gasse', 'str.'))} {n}", f"Am {cap(3)}platz {n}", f"{cap(3)}-Allee {n}", f"{n} rue {cap(3)}", f"{n} bis, avenue de {cap(3)}", f"{n}, boulevard {cap(2)}", f"{n} impasse du {cap(3)}", f"Calle {cap(3)} {n}", f"C/ {cap(3)} {n}", f"Avenida de {cap(3)}, {n}", f"Plaza {cap(3)} {n}", f"달누리로 {n}", f"은마루길 {rng.randint(2, 99)}-{rng.randint(2, 40)}", f"{cap(2)}straat {n}"])

    def email() -> str:
        local = rng.choice((syl(3), f"{syl(2)}.{syl(3)}", f"{syl(2)}_{rng.choice('abc')}", f"{syl(2)}+kb{digit(2)}", f"{syl(2)}{digit(2)}"))
        return rng.choice((f"{local}@{syl(3)}.example", f"{local}@mail.{syl(3)}.test", f"{local} [at] {syl(3)}.org", f"{local} (at) {syl(3)} dot example", f"{local.upper()}@{syl(3).upper()}.ORG"))

    slots = {"N": ("name", name), "P": ("phone", phone), "A": ("address", address), "E": ("email", email)}
    with_ids = ["The {L} {I} was in the file.", "{L}: {I}", "Please delete {I} ({L}) now.", "It held {I} as {L}.", "{L} {I} stand im Text.", "{L}={I}", "Remove the {L} ({I}) today.", "El {L} {I} aparece en el texto.", "{L} {I} 값이 있다.", "Le {L} {I} figure ici."]
    plain = [
        "According to {N} the run is fine.", "I talked to {N} about it.", "{N} asked for a copy.", "{N} wrote this page.", "Signed, {N}", "Attn: {N}", "reviewed-by: {N}", "It came from {N} on Monday.", "My name is {N} and I work here.", "Laut {N} ist alles gut.", "Mein Name ist {N} und ich warte.",
        "{N} hat den Text geschrieben.", "Selon {N} tout va bien.", "Mme {N} demande une copie.", "Según {N} todo va bien.", "Me llamo {N} y trabajo.", "{N} pide una copia.", "{N} escribió el texto.", "담당자: {N}", "{N} 님이 썼다.", "작성자는 {N} 님이다.", "Mit freundlichen Grüßen, {N}", "Moved after {N} and others left.", "Dr. {N} wants it gone.", "{N} wants it gone.",
        "Attn: {N} <{E}>", "Call {P} when it stops.", "Texted {P} about it.", "Their number is {P}, after six.", "Fax and voice ({P}) are dead.", "| phone | {P} |", "tel:{P}", "Im Notfall {P} anrufen.", "Rückruf unter {P} erbeten.", "Appeler {P} ce soir.", "Llamar al {P} hoy.", "전화: {P}", "On-call this week: {P} ext. 4",
        "Meet at {A} at nine.", "The office moved to {A} last year.", "Home address: {A}, 00123 Bova", "Treffpunkt ist {A} um neun.", "Wohnhaft: {A}", "Domicile : {A}", "Domicilio: {A}", "주소: {A}", "상자는 {A} 주소로 보낸다.", "Das Paket geht an {A}, 00321 Dena.", "| site | {A} | 00999 Dena |", "Ship it to {A}.",
        "Write to {E} today.", "<{E}>", "cc {E}, please.", "[owner](mailto:{E})", "owner={E}; retries=3", "Bitte an {E} schicken.", "SendMail(to={E})", "{E} 주소로 보내 주세요.",
    ]
    other = [
        "The Lane Index and the Court Digest are packs.", "Rose chart, Boris site, Flora period.", "Version 555.0{d}.2 is out.", "Budget was 9{d} 12 4{d}1 units in all.", "Part no. 45-678-9{d} is a cable.", "Run 2025{d}0-555{d}2 was retried.", "Pages 1{d}-1{d} of it.", "Took 03:14:07 in all.", "git clone git@forge:kb/notes", "worker@queue3 stopped.",
        "Pinned to pack-x@2.3.1 for now.", "Key 7c9e6679-7425-40de-944b-e07fc1f90ae7 is random.", "The gateway 10.0.31.7 was late.", "Das Prüfteam sammelt. Am Montag liest Die Rangfolge.", "Nach Dem Lauf zählt Der Kurator 28 Einträge.", "# Dora Heading", "## Boris Index", "작업의 하나로 28번 실패한 뒤에", "Main Loop and Road Map are themes.", "The Curator Team and Our Linter", "Meet The Team at nine.",
        "Ein Alter Zweig liest den Kopf. Unser Prüfwerkzeug ist da.", "ISO 8601-1:2019 wins.", "Ticket KB-48{d}-77 is closed.", "Budget 9{d} 44 1{d}2 units.", "La Semana Pasada leyó.", "Vor Der Freigabe ist Die Liste da.", "sent After The Last run.",
    ]
    out = []
    for _ in range(26):
        for template in plain + other + with_ids * 3:
            value, label = ident()
            text, spans = "", []
            for part in regex.split(r"(\{\w\})", template.replace("{d}", digit(2)).replace("{L}", label)):
                if regex.fullmatch(r"\{\w\}", part):
                    kind, filled = ("id", value) if part == "{I}" else (slots[part[1]][0], slots[part[1]][1]())
                    spans.append((len(text), len(text) + len(filled), kind))
                    text += filled
                else:
                    text += part
            out.append((text, spans))
    return out


@lru_cache(1)
def fitted() -> tuple[tuple[str, float], ...]:
    """The weights, by stochastic gradient ascent of the conditional likelihood with a small quadratic penalty."""
    rng = random.Random(7)
    given = frozenset(["alma", "boris", "chiara", "dora", "edgar", "flora"])
    data = [(candidates(t, given), {*spans}) for t, spans in _practice(rng)]
    weights: dict[str, float] = {}
    seen: dict[str, float] = {}
    for _ in range(4):
        rng.shuffle(data)
        for spans, gold in data:
            if not spans:
                continue
            chain, chance = marginals(spans, weights)
            step: dict[str, float] = {}
            for s, p in zip(chain, chance):
                miss = ((s[0], s[1], s[2]) in gold) - p
                if abs(miss) > 1e-3:
                    for f in s[3]:
                        step[f] = step.get(f, 0.0) + miss
            for f, g in step.items():
                g -= 1e-4 * weights.get(f, 0.0)
                seen[f] = seen.get(f, 0.01) + g * g
                weights[f] = weights.get(f, 0.0) + 0.5 * g / math.sqrt(seen[f])
    return tuple(sorted(weights.items()))


def find(text: str, given: frozenset[str], weights: dict[str, float], gates: Iterable[str] = tuple(GATES)) -> list[Span]:
    """The personal information in a text, in order."""
    spans = candidates(text, given, gates)
    return best_spans(spans, weights) if spans else []


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by a placeholder of its kind."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def _gated(text: Column) -> Column:
    """Bits of the gates that a text passes."""
    bits = []
    for i, (strings, pattern) in enumerate(GATES.values()):
        test = text.rlike(pattern)
        if strings:
            test = reduce(Column.__or__, (text.contains(x) for x in strings)) & test
        bits.append(F.when(test, 1 << i).otherwise(0))
    return reduce(Column.__add__, bits)


def _given(given_names: DataFrame) -> frozenset[str]:
    rows = given_names.select(F.lower(given_names.columns[0])).limit(MAX_GIVEN + 1).collect()
    if len(rows) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    return frozenset(r[0] for r in rows if r[0])


def found(df: DataFrame, rec_id: str, text: str, given_names: DataFrame) -> DataFrame:
    """rec_id, kind, value: what each text mentions, exactly as written, once per record and value.

    Null, empty and blank texts mention nothing; records met twice count once; texts of any length are read whole, and
    spans do not cross lines of their own making (a name or address lies within one line). An empty table gives an
    empty result. Other columns are left out.
    """
    given, names = _given(given_names), tuple(GATES)
    model = df.sparkSession.sparkContext.broadcast(dict(fitted()))
    own = df.select(F.col(rec_id).alias("rec_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    own = settled(own, gates=_gated(F.col("text"))).where("gates > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            ids, kinds, values = [], [], []
            for i, t, g in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for start, end, kind, _ in find(t, given, weights, [n for k, n in enumerate(names) if g >> k & 1]):
                    ids.append(i)
                    kinds.append(kind)
                    values.append(t[start:end])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["rec_id", "kind", "value"])

    return own.mapInArrow(run, f"rec_id {own.schema['rec_id'].dataType.simpleString()}, kind string, value string").distinct()


def masked(df: DataFrame, text: str, given_names: DataFrame, out: str = "masked") -> DataFrame:
    """df with out: the text with placeholders, all else kept. Texts that pass no gate never leave the JVM."""
    given, names = _given(given_names), tuple(GATES)
    model = df.sparkSession.sparkContext.broadcast(dict(fitted()))
    own = settled(df, __gates=F.coalesce(_gated(F.col(text)), F.lit(0)))
    schema = df.withColumn(out, F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.value
        for batch in batches:
            texts, gates = batch.column(text).to_pylist(), batch.column("__gates").to_pylist()
            new = [mask(t, find(t, given, weights, [n for k, n in enumerate(names) if g >> k & 1])) for t, g in zip(texts, gates)]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "__gates"} | {out: pa.array(new, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in schema], [f.name for f in schema])

    return own.where("__gates = 0").drop("__gates").withColumn(out, F.col(text)).unionByName(own.where("__gates > 0").mapInArrow(run, schema))


def kb_texts(turns: DataFrame, author_regions: DataFrame, extracted_docs: DataFrame) -> list[tuple[str, DataFrame, str, str]]:
    """(table, rows, key, text) of the three texts."""
    return [("turns", turns, "turn_id", "text"), ("author_regions", author_regions, "region_no", "source_text"), ("extracted_docs", extracted_docs, "ext_id", "markdown")]


def kb_found(turns: DataFrame, author_regions: DataFrame, extracted_docs: DataFrame, given_names: DataFrame) -> DataFrame:
    """tab, rec_id, kind, value over the three texts."""
    parts = [found(df, key, text, given_names).select(F.lit(tab).alias("tab"), "rec_id", "kind", "value") for tab, df, key, text in kb_texts(turns, author_regions, extracted_docs)]
    return reduce(DataFrame.unionByName, parts)


def kb_masked(turns: DataFrame, author_regions: DataFrame, extracted_docs: DataFrame, given_names: DataFrame) -> DataFrame:
    """tab, rec_id, masked over the three texts."""
    parts = [masked(df.select(F.col(key).alias("rec_id"), F.col(text).alias("text")), "text", given_names).select(F.lit(tab).alias("tab"), "rec_id", "masked") for tab, df, key, text in kb_texts(turns, author_regions, extracted_docs)]
    return reduce(DataFrame.unionByName, parts).distinct()
