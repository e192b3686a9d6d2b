"""Visually identical text with different characters: one form, and the skeleton by which look-alikes are equal.

The skeleton decomposes a text, replaces every character by its prototype in a look-alike table, and decomposes again;
texts of equal skeleton look alike. The table is the letters below, what Unicode's character names tell (small capitals
and script forms of Latin letters), and compatibility decomposition (full-width, half-width and styled forms).

A text whose characters are their own prototypes, and which has no mark or part of a syllable written apart, is in its
one form already. Only the others are candidates; for them the one form (unify) is made, which keeps what is meant:
accents and Hangul parts are joined to their letters, forms made for width or style become plain, other blanks become
the plain space, invisible characters go, and a look-alike letter of another alphabet inside a Latin word becomes Latin.
Emoji sequences, words of another script and signs such as ², ½, ™ have prototypes but stay. Texts of ASCII alone never
leave the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of Cyrillic, Greek and Armenian, of Cherokee and of Lisu, that look like the Latin letter beneath them.
LOOKALIKE = "аеорсухіјѕһԁԛԝӏкАВЕЅІЈКМНОРСТУХԌԚԜΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινκραυօսոհьЬ" + "ᎪᏴᏟᎠᎬᏀᎻᎥᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ" + "ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ"
LATIN     = "aeopcyxijshdqwlkABESIJKMHOPCTYXGQWABEZHIKMNOPTYXoivkpauounhbb" + "ABCDEGHiJKLMPRSTVWZ" + "ABCDEFGHIJKLMNOPRSTUVWXYZ"
PROTOTYPES = dict(zip(LOOKALIKE, LATIN))
# Characters of the Latin script and digits that share a prototype, for the skeleton alone.
ALIKE = {"1": "l", "I": "l", "|": "l", "0": "O", "ı": "i", "ǀ": "l"}

INVISIBLE = "­͏؜ᅟᅠ᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿"
BLANKS = "\u0085   -     　"
WIDE = "！-￮"
STYLED = "ℂℊ-ℓℕ℘-ℝℤℨℬℭℯ-ℱℳℴⅅ-ⅉ\U0001d400-\U0001d7ff"
JAMO = "ᄀ-ᇿꥠ-꥿ힰ-퟿"
MARKS = "̀-ͯ"


_INVISIBLE = regex.compile(rf"(?<=\p{{ExtPict}}[️\U0001f3fb-\U0001f3ff]?)‍(?=\p{{ExtPict}})(*SKIP)(*FAIL)|(?<=[\p{{ExtPict}}0-9#*])️(*SKIP)(*FAIL)|[{INVISIBLE}\U000e0100-\U000e01ef]|(?<!\U0001f3f4[\U000e0020-\U000e007e]*)[\U000e0001\U000e0020-\U000e007f]")
_BLANK = regex.compile(f"[{BLANKS}]")
_FORM = regex.compile(f"[{WIDE}{STYLED}]+")
_APART = regex.compile(f"[^{MARKS}][{MARKS}]+|[{JAMO}]+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
_TO_LATIN = str.maketrans(PROTOTYPES)
_HAS_LATIN = regex.compile(r"\p{Latin}")
_APART_ONE = regex.compile(f"[{MARKS}{JAMO}]")


class _Table(dict):
    """Code point to a string, found when first asked for; there are at most as many as Unicode has characters."""

    def __init__(self, find):
        self.find = find

    def __missing__(self, point: int) -> str:
        self[point] = out = self.find(chr(point))
        return out


def prototype(char: str) -> str:
    """What stands for a character in a skeleton: of each part of its decomposition the look-alike table's entry."""
    if _BLANK.fullmatch(char):
        return " "
    if _INVISIBLE.fullmatch(char):
        return ""
    out = []
    for c in unicodedata.normalize("NFKD", char):
        c = PROTOTYPES.get(c, c)
        named = regex.fullmatch(r"LATIN (?:LETTER SMALL CAPITAL|SMALL LETTER (?:SCRIPT|DOTLESS)) ([A-Z])", unicodedata.name(c, ""))
        c = named[1].lower() if named else c
        out.append(ALIKE.get(c, c))
    return unicodedata.normalize("NFKD", "".join(out))


_PROTOTYPE = _Table(prototype)
#: Whether a character tells that a text may have another form: its prototype is not its bare decomposition, or it stands apart.
_SUSPECT = _Table(lambda c: _PROTOTYPE[ord(c)] != "".join(ALIKE.get(x, x) for x in unicodedata.normalize("NFD", c)) or _APART_ONE.fullmatch(c) is not None)


def skeleton(text: str) -> str:
    """Equal for texts that look alike: decompose, replace by prototypes, decompose again; blanks and case stay."""
    return unicodedata.normalize("NFKD", text.translate(_PROTOTYPE))


def unify(text: str) -> str:
    """The one form of a text."""
    text = _BLANK.sub(" ", _INVISIBLE.sub("", text))
    text = _FORM.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    text = _APART.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)
    return _LETTERS.sub(lambda m: m[0].translate(_TO_LATIN) if _HAS_LATIN.search(m[0]) else m[0], text)


def one_form(text: str) -> str:
    """unify, for the candidates that the skeleton's table finds; other texts are returned as they are."""
    return unify(text) if any(_SUSPECT[ord(c)] for c in set(text)) else text


@F.pandas_udf(T.StringType())
def _unify(texts: pd.Series) -> pd.Series:
    return texts.map(one_form, na_action="ignore")


@F.pandas_udf(T.BooleanType())
def _differs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: one_form(t) != t, na_action="ignore")


@F.pandas_udf(T.StringType())
def _skeleton(texts: pd.Series) -> pd.Series:
    return texts.map(skeleton, na_action="ignore")


def beyond_ascii(text: Column) -> Column:
    """Whether a text has a character that is not ASCII; false for null."""
    return F.coalesce(F.octet_length(text) > F.length(text), F.lit(False))


def unified(df: DataFrame, text: str, out: str = "unified") -> DataFrame:
    """df with the one form of text in out (null for null).

    ASCII texts pass unchanged and never leave the JVM. Empty texts stay empty, repeated rows each come out, a text of
    any length is taken whole; a column of df named like out is replaced.
    """
    other = beyond_ascii(F.col(text))
    return df.where(~other).withColumn(out, F.col(text)).unionByName(df.where(other).withColumn(out, _unify(text)))


def changed(df: DataFrame, text: str) -> DataFrame:
    """The rows of df whose text has another form; null texts have none."""
    return df.where(beyond_ascii(F.col(text))).where(_differs(text))


def skeletons(df: DataFrame, text: str, out: str = "skeleton") -> DataFrame:
    """df with the skeleton of text in out. ASCII texts are done by built-in functions."""
    ascii_ = ~beyond_ascii(F.col(text))
    simple = "".join(k for k in ALIKE if k.isascii())
    return (
        df.where(ascii_)
        .withColumn(out, F.translate(text, simple, "".join(ALIKE[k] for k in simple)))
        .unionByName(df.where(~ascii_).withColumn(out, _skeleton(text)))
    )


def alike_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """skeleton, n, n_forms, first_id: groups of at least two different texts of equal skeleton.

    Rows are counted per text before they meet by skeleton, so a text held by most rows is one row in the shuffle;
    ids are not gathered, first_id is the least of them. Null and blank texts are in no group.
    """
    texts = df.where(F.trim(F.col(text)) != "").groupBy(F.col(text).alias("__t")).agg(F.count(F.lit(1)).alias("__n"), F.min(key).alias("__first"))
    return (
        skeletons(texts, "__t")
        .groupBy("skeleton")
        .agg(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_forms"), F.min("__first").alias("first_id"))
        .where("n_forms > 1")
    )


def text_fields(parsed_notes: DataFrame, search_hits: DataFrame) -> list[DataFrame]:
    """(field, rec_id, text) of titles, body lines (joined by line feeds) and excerpts; repeated rows as they are."""
    rows: list[tuple[str, DataFrame, str, Column]] = [
        ("title", parsed_notes, "note_id", F.col("title")),
        ("body_lines", parsed_notes, "note_id", F.array_join("body_lines", "\n")),
        ("excerpt", search_hits, "hit_id", F.col("excerpt")),
    ]
    return [df.select(F.lit(name).alias("field"), F.col(key).alias("rec_id"), text.alias("text")) for name, df, key, text in rows]


def unified_fields(parsed_notes: DataFrame, search_hits: DataFrame) -> DataFrame:
    """field, rec_id, unified: every record's field in its one form, each record once."""
    return reduce(DataFrame.unionByName, (unified(df, "text") for df in text_fields(parsed_notes, search_hits))).select("field", "rec_id", "unified").distinct()


def changed_fields(parsed_notes: DataFrame, search_hits: DataFrame) -> DataFrame:
    """field, rec_id: the records that had to change."""
    return reduce(DataFrame.unionByName, (changed(df, "text") for df in text_fields(parsed_notes, search_hits))).select("field", "rec_id").distinct()
