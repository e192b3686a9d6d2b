"""Scalar functions over text, as built-in expressions; the few that SQL has no words for are Arrow functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that carry no meaning in a question, and the CJK ranges of the tokenizer and the estimator.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it",
    "of", "on", "or", "that", "the", "to", "was", "what", "when", "where", "which", "who", "why", "with",
)
CJK = ((0x1100, 0x11FF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3130, 0x318F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0xF900, 0xFAFF), (0xFF00, 0xFFEF))
CJK_CLASS = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in CJK)
#: Characters that canonical composition may change: marks, parts of syllables, and letters that stand for another.
UNCOMPOSED = r"[\p{M}\x{374}\x{37e}\x{387}\x{1100}-\x{11ff}\x{1f71}-\x{1ffd}\x{2000}\x{2001}\x{2126}\x{212a}\x{212b}\x{2329}\x{232a}\x{2adc}\x{f900}-\x{faff}\x{fb1d}-\x{fb4e}\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1d}]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
# What is a fence, a heading and a link.
FENCE = r"^[ \t]*(```+|~~~+)"
HEADING = r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$"
WIKILINK = r"\[\[([^\]]+)\]\]"
MDLINK = r"(?<!!)\[[^\]\r\n]*\]\(([^)\r\n]+)\)"


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Canonical composition."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def cut_utf8(texts: pd.Series, limits: pd.Series) -> pd.Series:
    """The longest prefix of whole characters within so many bytes."""
    return pd.Series([None if t is None else t.encode("utf-8")[: int(n)].decode("utf-8", "ignore") for t, n in zip(texts, limits)], dtype=object)


def trim(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column, limit: int = 240) -> Column:
    """Runs of blanks as one space, trimmed, cut."""
    return F.substring(trim(F.regexp_replace(c, r"(?U)\s+", " ")), 1, limit)


def tokens(c: Column) -> Column:
    """Tokens of a composed text: ASCII words and bigrams of CJK runs (a lone letter stays), without stopwords."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(rf"[a-z0-9]+|[\p{{L}}\p{{N}}&&[{CJK_CLASS}]]+"), 0)
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    split = F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]") | (F.length(r) == 1), F.array(r)).otherwise(pairs(r)))
    return F.filter(F.flatten(split), lambda t: ~t.isin(*STOPWORDS))


def tag_tokens(tags: Column) -> Column:
    """A kebab tag's full form and its parts."""
    return F.flatten(F.transform(tags, lambda t: F.when(t.contains("-"), F.concat(F.array(F.lower(t)), tokens(t))).otherwise(tokens(t))))


def labels(c: Column) -> Column:
    """Links as their labels: [[target|label]] and [label](target)."""
    wiki = F.regexp_replace(c, r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1")
    return F.regexp_replace(wiki, r"\[([^\]]*)\]\([^)]*\)", "$1")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def title_of_slug(c: Column) -> Column:
    """A kebab name as words, each with an upper first letter and the rest untouched."""
    words = F.filter(F.split(c, "-"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def normal_body(c: Column) -> Column:
    """A composed body with line feeds, no blanks at line ends and one line feed at the end."""
    lines = F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?mU)[\s&&[^\n]]+$", "")
    return F.concat(F.regexp_replace(lines, r"\n+\z", ""), F.lit("\n"))


def content_sha(c: Column) -> Column:
    """SHA-256 of the normal body."""
    return F.sha2(normal_body(c), 256)


def event_id(ts: Column, number: Column) -> Column:
    """Time-sortable id: UTC instant with truncated milliseconds, and six hexadecimal digits."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss.SSS'Z'"), F.lit("--"), F.lpad(F.lower(F.hex(number)), 6, "0"))


def event_time(c: Column) -> Column:
    """The instant of an event id; null for another text."""
    return F.try_to_timestamp(F.when(c.rlike(r"\A\d{4}-\d\d-\d\dT\d\d-\d\d-\d\d\.\d{3}Z--[0-9a-f]{6}\z"), F.substring(c, 1, 23)), F.lit("yyyy-MM-dd'T'HH-mm-ss.SSS"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def token_estimate(c: Column) -> Column:
    """CJK characters, and a quarter of the bytes of all else, rounded up."""
    cjk = F.length(F.regexp_replace(c, rf"[^{CJK_CLASS}]", ""))
    return (cjk + F.ceil(F.octet_length(F.regexp_replace(c, rf"[{CJK_CLASS}]", "")) / 4)).cast("long")


def window_excerpt(line: Column, token: Column, around: int = 32) -> Column:
    """So many words to either side of the first word that is the token, in their own case; the whole line if none is."""
    parts = F.regexp_extract_all(line, F.lit("[^A-Za-z0-9]*[A-Za-z0-9]+"), 0)
    at = F.array_position(F.transform(parts, lambda p: F.lower(F.regexp_replace(p, "^[^A-Za-z0-9]*", ""))), token).cast("int")
    first = F.greatest(at - around, F.lit(1))
    cut = F.array_join(F.slice(parts, first, F.greatest(at + around - first + 1, F.lit(0))), "")
    return F.when(at > 0, collapse(cut)).otherwise(collapse(line))


def shingles(c: Column, k: int = 8) -> Column:
    """Distinct runs of k characters of the lower-cased, collapsed text; a shorter text is its own."""
    plain = F.lower(collapse(c, 1_000_000))
    return F.when(F.length(plain) <= k, F.array(plain)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(plain) - (k - 1)), lambda i: F.substring(plain, i, F.lit(k)))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def first_paragraph(c: Column, limit: int = 200) -> Column:
    """The first paragraph, cut at a word boundary."""
    text = collapse(F.get(F.filter(F.split(c, r"\n\s*\n"), lambda p: trim(p) != ""), F.lit(0)), 1_000_000)
    return F.when(F.length(text) <= limit, text).otherwise(F.regexp_replace(F.substring(text, 1, limit), r"\s+\S*$", ""))


def bounded(c: Column, limit: int = 400) -> Column:
    """Blanks collapsed; cut texts end in an ellipsis."""
    text = collapse(c, 1_000_000)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(F.substring(text, 1, limit - 1), r"\s+$", ""), F.lit("…")))


def without_spans(c: Column, prefix: str = "kb") -> Column:
    """Without marked spans (<!-- prefix:x:start --> to its end) and lone markers."""
    spans = F.regexp_replace(c, rf"(?is)<!--\s*{prefix}:[^>]*:start\b[^>]*-->.*?<!--\s*{prefix}:[^>]*:end\b[^>]*-->", "")
    return F.regexp_replace(spans, rf"(?i)<!--\s*{prefix}:[^>]*-->", "")


def neutral(c: Column, prefix: str = "kb") -> Column:
    """With openers of markers broken, so that none can end a span early."""
    return F.regexp_replace(c, rf"(?i)<!--(\s*{prefix}:)", "<!- -$1")


def wikilink_key(c: Column) -> Column:
    """The key of a wikilink: before | and #, trimmed."""
    return trim(F.regexp_replace(c, r"(?s)[|#].*$", ""))


def mdlink_key(c: Column, strip_anchor: bool = True) -> Column:
    """The basename of a markdown link's target, null unless it ends in .md."""
    path = F.regexp_replace(c, r"(?s)#.*$", "") if strip_anchor else c
    return F.when(path.endswith(".md"), F.regexp_replace(F.regexp_replace(path, r"(?s)^.*/", ""), r"\.md$", ""))


def is_moc_path(c: Column) -> Column:
    """wiki/<d>/<d>-moc.md"""
    return c.rlike(r"\Awiki/([^/]+)/\1-moc\.md\z")


def path_domain(c: Column) -> Column:
    """The folder below wiki of a path of at least three parts."""
    parts = F.split(c, "/")
    return F.when((F.size(parts) >= 3) & (parts[0] == "wiki"), parts[1])


def safe_component(c: Column) -> Column:
    """Whether a name may be one part of a path."""
    return c.rlike(r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z") & ~c.contains("..")


# Files and folders that a run may write.
ALLOWED_FILES, ALLOWED_FOLDERS = ("index.md", "log.md"), ("wiki/", "assets/")


def may_write(path: Column) -> Column:
    """Whether a run may add or change a path."""
    inside = path.isin(*ALLOWED_FILES)
    for folder in ALLOWED_FOLDERS:
        inside = inside | path.startswith(folder)
    return inside


def heading_anchor(c: Column) -> Column:
    """The slug of a heading's visible text: links as their labels, code and emphasis without their marks."""
    plain = F.regexp_replace(F.regexp_replace(c, r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), r"\[\[([^\]]*)\]\]", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"`([^`]*)`", "$1"), r"\[([^\]]*)\]\([^)]*\)", "$1")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2"), r"(?<![\w*])\*([^*\s][^*]*)\*(?![\w*])", "$1")
    return F.regexp_replace(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slug_or_hash(c: Column) -> Column:
    """The slug of a text, or note- and eight digits of its hash when nothing of it is left."""
    return F.when(slug(c) != "", slug(c)).otherwise(F.concat(F.lit("note-"), F.substring(F.sha2(c, 256), 1, 8)))


def at_boundary(c: Column, limit: int = 200) -> Column:
    """A text cut after its last whole sentence within limit, else its last whole word, else at limit; a cut keeps a quarter at least."""
    clip, least = F.substring(c, 1, limit), max(1, limit // 4)
    sentence = trim(F.regexp_extract(F.substring(c, 1, limit + 1), rf"(?s)\A(.{{0,{limit - 1}}}[.!?。！？…])(?=\s)", 1))
    word = trim(F.regexp_extract(clip, r"(?s)\A(.+)\s\S*\z", 1))
    return F.when(F.length(c) <= limit, c).when(F.length(sentence) >= least, sentence).when(F.length(word) >= least, word).otherwise(clip)


def prose(c: Column) -> Column:
    """Written text fit for a region: without fences and comments, wikilinks as their text, trimmed."""
    plain = F.replace(F.regexp_replace(c, r"```[^\n]*\n?", ""), F.lit("```"), F.lit(""))
    return trim(F.regexp_replace(F.regexp_replace(plain, r"(?s)<!--.*?-->", ""), r"\[\[([^\]]*)\]\]", "$1"))


def without_stray_links(c: Column, allowed: Column, depth: int = 8) -> Column:
    """A text whose wikilinks of keys that are not allowed (an array) are their text; nested ones up to depth, then all brackets go."""
    out = c
    for _ in range(depth):
        parts = F.regexp_extract_all(out, F.lit(r"(?s)(?:(?!\[\[[^\[\]\r\n]*\]\]).)*(?:\[\[[^\[\]\r\n]*\]\]|\z)"), 0)
        inner = lambda p: F.regexp_extract(p, r"\[\[([^\[\]\r\n]*)\]\]\z", 1)
        key = lambda p: F.regexp_replace(F.regexp_replace(inner(p), r"\|.*$", ""), r"^[ \t\f\x0b]+|[ \t\f\x0b]+$", "")
        out = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"\[\[[^\[\]\r\n]*\]\]\z") & ~F.array_contains(allowed, key(p)), F.regexp_replace(p, r"\[\[([^\[\]\r\n]*)\]\]\z", "$1")).otherwise(p)), "")
    return out


def harvest_origin(sources: Column, origin: Column) -> Column:
    """The origin held, else the first source of a harvest."""
    return F.coalesce(origin, F.get(F.filter(sources, lambda s: s.rlike(r"(?s)\Aharvest:.+")), F.lit(0)))


def bounded_list(reasons: Column, most: int = 5, limit: int = 400) -> Column:
    """shown (the first ones, each bounded) and total of a list of reasons."""
    return F.struct(F.transform(F.slice(reasons, 1, most), lambda r: bounded(r, limit)).alias("shown"), F.size(reasons).alias("total"))


def as_routes(c: Column, base: str = "/notes/") -> Column:
    """Wikilinks as links to a route: [[key|shown]] and [[key#anchor]]."""
    anchored = F.regexp_replace(c, r"(?<!!)\[\[([^\[\]|#\r\n]+)(#[^\[\]|\r\n]*)?\|([^\[\]\r\n]*)\]\]", f"[$3]({base}$1$2)")
    return F.regexp_replace(anchored, r"(?<!!)\[\[([^\[\]|#\r\n]+)(#[^\[\]|\r\n]*)?\]\]", f"[$1]({base}$1$2)")


def tag_list(c: Column) -> Column:
    """Tags of a text separated by commas or blanks, each once; null if one is no kebab name."""
    tags = F.array_distinct(F.filter(F.split(c, r"[,\s]+"), lambda t: t != ""))
    return F.when(F.forall(tags, lambda t: t.rlike(r"\A[a-z0-9]+(-[a-z0-9]+)*\z")), tags)


@F.pandas_udf(T.StringType())
def first_object(texts: pd.Series) -> pd.Series:
    """The first JSON object of a text, as it stands; null if there is none that parses."""
    import json

    decoder = json.JSONDecoder()

    def find(text: str) -> str | None:
        at = text.find("{")
        while at >= 0:
            try:
                return text[at : decoder.raw_decode(text, at)[1]]
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find, na_action="ignore")
