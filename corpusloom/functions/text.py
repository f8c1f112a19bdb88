"""Columns over transcripts: white space, words, characters, scripts and normal forms.

One symbol is one code point throughout. White space is Python's: the Unicode blanks and U+001C to U+001F.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Classes of characters and names of scripts.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TAMIL = r"[\x{b80}-\x{bff}]"
LATIN = r"[A-Za-z\x{c0}-\x{24f}\x{1e00}-\x{1eff}]"
SCRIPTS = ("tamil", "latin", "digit", "punctuation", "symbol", "whitespace", "other")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def words(text: Column) -> Column:
    """The pieces between white space; an empty array for an empty or blank text, null for null."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def characters(text: Column) -> Column:
    """Code points in order; an empty array for an empty text, null for null."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def unspaced(text: Column) -> Column:
    """The text without any white space."""
    return F.regexp_replace(text, SPACE, "")


def _normal(form: str):
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form!r}")

    @F.pandas_udf(T.StringType())
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return run


def normalize_text(text: Column, form: str = "NFC") -> Column:
    """The text in a normal form; null stays null. An unknown form raises ValueError."""
    return _normal(form)(text)


def prepare_text(text: Column, form: str = "NFC", include_space: bool = True) -> Column:
    """Normal form, inner white space as one blank, outer white space removed; no blanks at all without include_space."""
    out = F.trim(F.regexp_replace(normalize_text(text, form), SPACE + "+", " "))
    return out if include_space else F.replace(out, F.lit(" "), F.lit(""))


def script_of(char: Column) -> Column:
    """The class of one code point: white space, then the Tamil block, Latin ranges, digits, punctuation, symbols, other."""
    return (
        F.when(char.rlike(f"^{SPACE}$"), "whitespace").when(char.rlike(f"^{TAMIL}$"), "tamil").when(char.rlike(f"^{LATIN}$"), "latin")
        .when(char.rlike(r"^\p{Nd}$"), "digit").when(char.rlike(r"^\p{P}$"), "punctuation").when(char.rlike(r"^\p{S}$"), "symbol").otherwise("other")
    )


def inventory_class(char: Column) -> Column:
    """The coarser classes of the character inventory; an ASCII blank is ``ascii_other``."""
    return (
        F.when(char.rlike(f"^{TAMIL}$"), "tamil_block").when(char.rlike("^[0-9]$"), "ascii_digit").when(char.rlike("^[A-Za-z]$"), "ascii_latin")
        .when(char.rlike(r"^[\x00-\x7f]$"), "ascii_other").when(char.rlike(f"^{SPACE}$"), "whitespace").otherwise("other_non_tamil")
    )
