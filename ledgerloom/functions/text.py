"""Cleaning, tokenising and measuring text as Column functions. All are NULL in, NULL out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.whitespace import JAVA

# Ligatures with several letters, then single characters and those that go.
LIGATURES = (("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb00", "ff"))
SINGLE_FROM, SINGLE_TO = "\u2019\u2018\u201c\u201d\u2013\u2014\u00a0\u200b\ufffd", "''\"\"-- "
# Noise, in the order in which it goes, as (pattern, replacement).
NOISE = (
    (r"(?i)Page \d+ of \d+", ""), (r"(?m)^\s*\d+\s*$", ""), (r"(?im)CONFIDENTIAL.*?$", ""), (r"(?:www\.|http)[^\s]+", ""), (r"\b[A-Z]{2,6}\d{6,}\b", ""),
    (r"(?i)CIN[:\s]+[A-Z0-9]+", ""), (r"(?i)(?:Tel|Fax|Email|Website)[:\s].{0,60}", ""), (r"[^\x00-\x7F\u0900-\u097F]", " "),
)
UNIT_WORDS = (("Cr", "Crore"), ("Lk", "Lakh"), ("Mn", "Million"), ("Bn", "Billion"))


def fix_ligatures(c: Column) -> Column:
    for a, b in LIGATURES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, SINGLE_FROM, SINGLE_TO)


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no built-in for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def remove_noise(c: Column) -> Column:
    for pattern, new in NOISE:
        c = F.regexp_replace(c, pattern, new)
    return c


def unit_words(c: Column) -> Column:
    for short, full in UNIT_WORDS:
        c = F.regexp_replace(c, rf"(?i)\b{short}\.?\b", full)
    return c


def tidy(c: Column) -> Column:
    """Runs of blanks become one, more than two line breaks two; line ends and the whole are trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)[ \t]+$", ""), r"^\s+|\s+$", "")


def clean(c: Column, aggressive: bool = False, normal_form: bool = True) -> Column:
    """Ligatures, normal form, noise (only if aggressive), unit words, white space, in that order."""
    c = fix_ligatures(c)
    if normal_form:
        c = nfkc(c)
    return tidy(unit_words(remove_noise(c) if aggressive else c))


def words(c: Column) -> Column:
    """Runs of non-space characters; an empty array for blank text."""
    return F.filter(F.split(c, f"[{JAVA}]+"), lambda w: w != "")


def approx_tokens(c: Column) -> Column:
    return F.floor(F.size(words(c)) * F.lit(1.3)).cast("int")


def letter_share(c: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(c))


def is_garbage(c: Column, min_words: int = 20) -> Column:
    """Too few words, or letters under two fifths."""
    return (F.size(words(c)) < min_words) | (F.coalesce(letter_share(c), F.lit(0.0)) < 0.4)


def tokens(c: Column, compat: bool = False) -> Column:
    """Lexical tokens: runs of a-z and 0-9 of the lower case. compat keeps a percent sign and takes whole words only."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"\b[a-z0-9%]+\b" if compat else "([a-z0-9]+)"), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: s != "")


def any_of(c: Column, terms: tuple[str, ...]) -> Column:
    """Whether the lower case of a text contains one of the terms: one alternation, quoted."""
    return F.lower(c).rlike("|".join("\\Q" + t + "\\E" for t in terms))
