"""Languages of documents and of their blocks, by multilingual mixture inference.

Each block's likelihood under each language comes from hashed character n-grams. Expectation-maximisation then estimates
every document's language proportions from its blocks, and the set of its languages is the one with the best penalised
likelihood. The n-gram model is fitted on a bounded sample of labelled documents and refitted once on its own labels,
as given labels may be wrong; all else reads every document whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The languages told apart.
LANGUAGES = ("en", "de", "fr", "es", "pt", "it", "nl", "ko")
#: Bounds of the sample the model is fitted on: documents (about), and characters of one.
SAMPLE_DOCS, SAMPLE_CHARS = 4000, 20_000
#: Cost in nats of one more language in a document.
PENALTY = 14.0
ORDERS, BITS = (2, 3, 4), 17
BUCKETS = 1 << BITS
ROUNDS = 12
#: Words (or a third as many Hangul syllables) that a line needs to be prose.
MIN_WORDS = 5

# Names and three-letter codes under which labels give these languages, and labels that give none.
NAMES = {
    "en": "eng english englisch anglais inglés", "de": "deu ger german deutsch allemand", "fr": "fra fre french français francais französisch",
    "es": "spa spanish español espanol castellano spanisch", "pt": "por portuguese português portugues", "it": "ita italian italiano italienisch",
    "nl": "nld dut dutch nederlands niederländisch", "ko": "kor korean 한국어 한국말", "ja": "jpn japanese 日本語", "zh": "zho chi chinese 中文",
}
UNKNOWN = ("", "und", "unknown", "??", "?", "n/a", "na", "none", "null", "xx", "-", "zxx", "mul")


def label_code(label: Column) -> Column:
    """The two-letter code that a label means, null when it is missing or says unknown."""
    said = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    base = F.substring_index(F.substring_index(said, "-", 1), "_", 1)
    names = F.create_map(*(F.lit(x) for code, words in NAMES.items() for w in words.split() for x in (w, code)))
    return F.when(said.isNull() | said.isin(*UNKNOWN), None).otherwise(F.coalesce(F.element_at(names, said), F.element_at(names, base), F.when(base != "", base)))


_FENCE = re.compile(r"\s*(```|~~~)")
_SPEAKER = re.compile(r"(?m)^[^\S\n]*(?:[-*>][^\S\n]*)*(?:\*\*)?[^\W\d]{2,12}(?:\*\*)?:[^\S\n]+")
_NOISE = re.compile(r"`[^`\n]*`|\[\[[^\]\n]*\]\]|(?<!\S)[^\s@/_\\]*[@/_\\]\S*")
_DIGITS, _OTHER = re.compile(r"[\d_]+"), re.compile(r"[^\w\n]+")
_HANGUL = re.compile("[ᄀ-ᇿ㄰-㆏가-힣]")


def _skipped(lines: list[str]) -> set[int]:
    """Lines of front matter and of fenced code."""
    skip: set[int] = set()
    start = next((i for i, x in enumerate(lines) if x.strip()), 0)
    if lines and lines[start].strip() == "---":
        end = next((i for i in range(start + 1, len(lines)) if lines[i].strip() == "---"), None)
        if end is not None:
            skip.update(range(start, end + 1))
    inside = False
    for i, line in enumerate(lines):
        if i not in skip and _FENCE.match(line):
            inside = not inside
            skip.add(i)
        elif inside:
            skip.add(i)
    return skip


def blocks(text: str) -> list[tuple[int, str, int]]:
    """(number, prose, characters) of each block that has prose; blocks lie between blank lines, counted from 1.

    Prose leaves out front matter, fenced and inline code, headings, speaker marks, addresses and paths, and lines of fewer
    than MIN_WORDS words, which are names or marks. Where no block has any, short lines count, then headings.
    """
    return _blocks(text)[0]


def _blocks(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """The blocks that have prose, and those that have none but other words outside headings."""
    lines = text.splitlines()
    skip = _skipped(lines) if "```" in text or "~~~" in text or "---" in text else ()
    bare = _OTHER.sub(" ", _DIGITS.sub(" ", _NOISE.sub(" ", _SPEAKER.sub("", "\n".join(lines))))).lower().split("\n")
    rows, number, open_ = [], 0, False  # (block, words, line, characters, heading)
    for i, (line, plain) in enumerate(zip(lines, bare)):
        if not line or line.isspace():
            open_ = False
            continue
        if not open_:
            number, open_ = number + 1, True
        if i not in skip:
            plain = plain.strip()
            if plain:
                rows.append((number, plain.count(" ") + 1, plain, len(line), line.lstrip().startswith("#")))
    for headings, least in ((False, MIN_WORDS), (False, 1), (True, 1)):
        out: dict[int, tuple[list[str], int]] = {}
        for number, n, plain, size, head in rows:
            if (headings or not head) and (n >= least or len(_HANGUL.findall(plain)) >= 3 * least):
                prose, total = out.get(number, ([], 0))
                prose.append(plain)
                out[number] = (prose, total + size)
        if out:
            short: dict[int, list[str]] = {}
            for number, _, plain, _, head in rows:
                if number not in out and not head:
                    short.setdefault(number, []).append(plain)
            return [(k, " ".join(prose), size) for k, (prose, size) in out.items()], [(k, " ".join(prose), 0) for k, prose in short.items()]
    return [], []


def _buckets(units: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Per order the bucket of the n-gram that starts at each character, and where each unit starts."""
    joined = "".join(f" {u} " for u in units)
    starts = np.cumsum([0] + [len(u) + 2 for u in units])[:-1]
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    padded = np.concatenate((c, np.full(max(ORDERS), 32, np.uint32)))
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h ^ padded[n - 1 : n - 1 + len(c)]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            out.append(((h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int64))
    return out, starts


def likelihoods(units: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood of each unit under each language, one n-gram order's worth."""
    out = np.zeros((len(units), len(table)))
    at = 0
    while at < len(units):  # about 300,000 characters at once, or one unit
        end, room = at + 1, 300_000 - len(units[at])
        while end < len(units) and room >= len(units[end]):
            room -= len(units[end])
            end += 1
        orders, starts = _buckets(units[at:end])
        for b in orders:
            for cut in range(0, len(b), 500_000):  # one very long unit is added up in parts
                piece = b[cut : cut + 500_000]
                inside = starts[(starts > cut) & (starts < cut + len(piece))]
                first = np.searchsorted(starts, cut, "right") - 1
                edges = np.concatenate(([0], inside - cut))
                for k, row in enumerate(table):
                    out[at + first : at + first + len(edges), k] += np.add.reduceat(row[piece], edges)
        at = end
    return out / len(ORDERS)


def fit(texts: list[str], codes: list[str], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log-probabilities (languages x buckets) from labelled texts; one more round on the labels found corrects wrong ones."""
    units, label = [], []
    for text, code in zip(texts, codes):
        for _, prose, _ in blocks(text):
            units.append(prose)
            label.append(languages.index(code))
    table = np.zeros((len(languages), BUCKETS), np.float32)
    owner = np.array(label, np.int64)
    for _ in range(3):
        counts = np.zeros((len(languages), BUCKETS))
        for k in range(len(languages)):
            own = [u for u, x in zip(units, owner.tolist()) if x == k]
            if own:
                for b in _buckets(own)[0]:
                    counts[k] += np.bincount(b, minlength=BUCKETS)
        counts += 0.05
        table = np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)
        if units:
            owner = likelihoods(units, table).argmax(1)
    return table


def infer(ll: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of units (ll: units x languages, doc: their document, ascending): each one's language and its probability.

    Proportions per document are found by expectation-maximisation over all languages. Of the sets made of the one,
    two, ... most probable ones, that with the highest likelihood less PENALTY per language is the document's.
    """
    k = ll.shape[1]
    share = np.full((n_docs, k), 1.0 / k)

    def expect(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore"):
            joint = np.log(share)[doc] + ll
        top = joint.max(1, keepdims=True)
        weight = np.exp(joint - top)
        total = weight.sum(1, keepdims=True)
        return weight / total, (top + np.log(total))[:, 0]

    def maximise(weight: np.ndarray) -> np.ndarray:
        out = np.zeros((n_docs, k))
        np.add.at(out, doc, weight)
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)

    for _ in range(ROUNDS):
        share = maximise(expect(share)[0])
    totals = np.zeros((n_docs, k))
    np.add.at(totals, doc, ll)
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1, kind="stable")
    single = totals.argmax(1)
    best = totals.max(1) - PENALTY
    chosen = np.zeros((n_docs, k))
    chosen[np.arange(n_docs), single] = 1.0
    for size in range(2, k + 1):
        allowed = np.where((rank < size) & (share > 0), np.maximum(share, 1e-6), 0.0)
        allowed /= np.maximum(allowed.sum(1, keepdims=True), 1e-300)
        allowed[allowed.sum(1) == 0] = 1.0 / k
        total = np.zeros(n_docs)
        np.add.at(total, doc, expect(allowed)[1])
        total -= PENALTY * size
        better = total > best
        best = np.where(better, total, best)
        chosen[better] = allowed[better]
    post, _ = expect(np.maximum(chosen, 1e-12))
    open_ = np.exp(np.clip((ll - ll.max(1, keepdims=True)) * 0.25, -700, 0))  # n-grams overlap: a quarter of the evidence
    return post.argmax(1), (open_ / open_.sum(1, keepdims=True))[np.arange(len(ll)), post.argmax(1)]


def sample(df: DataFrame, doc_id: str, text: str, lang: str, most: int = SAMPLE_DOCS) -> tuple[list[str], list[str]]:
    """Texts and codes of about most labelled documents, of those of at most SAMPLE_CHARS characters, by a hash of the id.

    Labels are counted first; the share of hashes that most is of them then bounds what all tasks together send.
    """
    code = label_code(F.col(lang))
    labelled = df.where(code.isin(*LANGUAGES))
    n = labelled.count()
    share = min(1 << 30, math.ceil((most << 30) / max(1, n)))
    own = labelled.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 30)) < share).where((F.length(text) <= SAMPLE_CHARS) & (F.trim(text) != ""))
    rows = own.select(F.col(text), code, F.xxhash64(F.col(doc_id)).alias("h")).toArrow()
    order = np.lexsort((rows.column(0).combine_chunks().to_numpy(zero_copy_only=False), rows.column(2).to_numpy())).tolist() if rows.num_rows else []
    texts, codes = rows.column(0).to_pylist(), rows.column(1).to_pylist()
    return [texts[i] for i in order], [codes[i] for i in order]


@lru_cache(1)
def _table(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(-1, BUCKETS)


def languages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, seg, lang, confidence, n_langs, label_code of every document (seg 0) and of every block of a mixed one.

    seg 0 carries the main language, the one with most characters, and the share of confidence its blocks give it.
    Blocks of short lines alone do not make a document mixed; in a mixed one they have the likeliest of its languages.
    Null and blank texts, and texts without a letter outside code, come out with a null language and no segments.
    Very long texts are read whole; repeated rows each come out; an empty table, or one without a usable label, gives
    null languages. Other columns are left out. The model (4 MB) is sent to all workers.
    """
    texts, codes = sample(df, doc_id, text, lang)
    model = df.sparkSession.sparkContext.broadcast(fit(texts, codes).tobytes() if texts else b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(model.value) if model.value else None
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                part = whole.slice(at, 1000)
                ids, labels = part.column(0).to_pylist(), part.column(2).to_pylist()
                units, doc, number, size, short = [], [], [], [], {}
                for i, t in enumerate(part.column(1).to_pylist()):
                    prose_blocks, short[i] = _blocks(t) if t and table is not None else ([], [])
                    for n, prose, chars in prose_blocks:
                        units.append(prose)
                        doc.append(i)
                        number.append(n)
                        size.append(chars)
                rows: list[tuple] = []
                found: dict[int, list[tuple[int, int, float, int]]] = {}
                if units:
                    own = np.array(doc)
                    which, sure = infer(likelihoods(units, table), own, len(ids))
                    for d, n, w, s, c in zip(doc, number, which.tolist(), sure.tolist(), size):
                        found.setdefault(d, []).append((n, w, s, c))
                for i, key in enumerate(ids):
                    parts = found.get(i)
                    if not parts:
                        rows.append((key, 0, None, None, 0, labels[i]))
                        continue
                    chars, weight = [0] * len(LANGUAGES), [0.0] * len(LANGUAGES)
                    for _, w, s, c in parts:
                        chars[w] += c
                        weight[w] += s * c
                    main = max(range(len(LANGUAGES)), key=lambda k: chars[k])
                    n_langs = sum(c > 0 for c in chars)
                    rows.append((key, 0, LANGUAGES[main], weight[main] / max(1, chars[main]) * chars[main] / max(1, sum(chars)), n_langs, labels[i]))
                    if n_langs > 1:
                        if short[i]:
                            own_langs = [k for k in range(len(LANGUAGES)) if chars[k]]
                            near = likelihoods([prose for _, prose, _ in short[i]], table)[:, own_langs]
                            odds = np.exp((near - near.max(1, keepdims=True)) * 0.25)
                            parts = sorted([*parts, *((n, own_langs[k], float(p[k] / p.sum()), 0) for (n, _, _), k, p in zip(short[i], near.argmax(1).tolist(), odds))])
                        rows += [(key, n, LANGUAGES[w], s, n_langs, labels[i]) for n, w, s, _ in parts]
                columns = list(zip(*rows)) or [()] * 6
                kinds = [part.schema.field(0).type, pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "seg", "lang", "confidence", "n_langs", "label_code"])

    own = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), label_code(F.col(lang)).alias("label_code"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(run, f"doc_id {kind}, seg bigint, lang string, confidence double, n_langs int, label_code string")


def mislabelled(found: DataFrame) -> DataFrame:
    """doc_id, seg, lang: documents whose label is missing or names another language (seg 0), and blocks of mixed ones."""
    return found.where("lang is not null and (seg > 0 or label_code is null or label_code <> lang)").select("doc_id", "seg", "lang").distinct()
