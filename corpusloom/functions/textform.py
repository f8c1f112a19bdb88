"""The consistent form of a text: composed characters, one blank, nothing invisible, one script a word.

Every function takes and gives Python strings; ``consistent_column`` and ``letters_column`` are the Arrow
kernels over columns. A null text stays null, an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts that are drawn like Latin ones, with the Latin letter.
CYRILLIC_LATIN = {
    "а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ј": "j", "ѕ": "s",
    "А": "A", "В": "B", "Е": "E", "І": "I", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "Ј": "J", "Ѕ": "S",
}
CYRILLIC_LATIN_RARE = {"һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l"}
GREEK_LATIN = {
    "ο": "o", "ν": "v", "ρ": "p", "υ": "u", "α": "a", "ι": "i", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H",
    "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
# Malayalam signs drawn like Tamil ones.
MALAYALAM_TAMIL = {"ഉ": "உ", "ജ": "ஜ", "ണ": "ண", "ഴ": "ழ", "ി": "ி", "ീ": "ீ"}
# Tamil digits and the length mark that are drawn like Tamil letters.
TAMIL_SIGN_LETTER = {"௧": "க", "௨": "உ", "௪": "ச", "௭": "எ", "௮": "அ", "௰": "ய"}
AU_MARK, AU_LETTER = "ௗ", "ள"
#: Tamil digits without a look-alike: a run that holds one of them is a number.
PLAIN_TAMIL_DIGITS = frozenset("௦௩௫௬௯௱௲")

LATIN, GREEK, CYRILLIC, TAMIL, MALAYALAM = "latin", "greek", "cyrillic", "tamil", "malayalam"


def _table() -> dict[tuple[str, str], str]:
    """(letter, wanted script) -> letter of that script; both directions, and Greek and Cyrillic through Latin."""
    made: dict[tuple[str, str], str] = {}
    for script, pairs in ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN)):
        for letter, latin in pairs.items():
            made[letter, LATIN] = latin
            made[latin, script] = letter
    for letter, latin in CYRILLIC_LATIN_RARE.items():
        made[letter, LATIN] = latin
    for letter, tamil in MALAYALAM_TAMIL.items():
        made[letter, TAMIL] = tamil
        made[tamil, MALAYALAM] = letter
    for a, to_a, other in ((GREEK_LATIN, CYRILLIC, CYRILLIC_LATIN), (CYRILLIC_LATIN, GREEK, GREEK_LATIN)):
        back = {latin: letter for letter, latin in other.items()}
        made |= {(letter, to_a): back[latin] for letter, latin in a.items() if latin in back}
    return made


LOOK_ALIKE = _table()

_PLAIN = re.compile("[\n -~ஂ-ௐఀ-౿]*")  # ASCII, Tamil without digits and length mark, Telugu
#: What composition may change in such a text: parts of vowels that compose, and marks that may be out of order.
_LOOSE = re.compile("[\u0bc6\u0bc7]\u0bbe|\u0c46[\u0c55\u0c56]|[\u0bcd\u0c3c\u0c4d\u0c55\u0c56]{2}")
_INVISIBLE = regex.compile(r"[[\p{Cf}\p{Default_Ignorable_Code_Point}\p{Cc}]--[\t\n\x0b\x0c\r\x85]]+", regex.V1)
_BLANK = regex.compile(r"[\p{White_Space}--[\n]]", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_NOT_LETTER = regex.compile(r"[\p{White_Space}\p{P}]+")
_PUNCTUATION = regex.compile(r"\p{P}+")
_ALL_BLANK = regex.compile(r"\p{White_Space}+")
_EAST = re.compile("[Ͱ-ϿЀ-ԯ]")
_TAMIL, _MALAYALAM = re.compile("[஀-௿]"), re.compile("[ഀ-ൿ]")
_SIGNS = re.compile("[ௗ௧-௰]")


def script_block(char: str) -> str:
    """The script a letter or mark is written in; '' for what belongs to every script."""
    code = ord(char)
    if code < 0x80:
        return LATIN if char.isalpha() else ""
    if 0xC0 <= code <= 0x24F or 0x1E00 <= code <= 0x1EFF:
        return LATIN
    if 0x300 <= code <= 0x36F:
        return ""
    if 0x370 <= code <= 0x3FF:
        return GREEK
    if 0x400 <= code <= 0x52F:
        return CYRILLIC
    if 0xB80 <= code <= 0xBFF:
        return TAMIL
    if 0xD00 <= code <= 0xD7F:
        return MALAYALAM
    return _named_script(char)


@lru_cache(maxsize=100_000)
def _named_script(char: str) -> str:
    """The Unicode script that a character's name begins with, if it has that script; else ''."""
    name = unicodedata.name(char, "").split(" ")[0].replace("-", "_")
    try:
        return name.lower() if name and regex.match(rf"\p{{Script={name}}}", char) else ""
    except regex.error:  # a name that begins with no script
        return ""


def _tamil_signs(word: str) -> str:
    """Tamil digits and length marks inside a Tamil word become the letters they are drawn like."""
    if not any(unicodedata.category(c)[0] == "L" for c in word if script_block(c) == TAMIL):
        if not (AU_MARK in word and any(c in TAMIL_SIGN_LETTER for c in word)):
            return word
    word = word.replace(AU_MARK, AU_LETTER)
    if PLAIN_TAMIL_DIGITS.isdisjoint(word):
        word = "".join(TAMIL_SIGN_LETTER.get(c, c) for c in word)
    return word


def confusables(jvm: object) -> dict[tuple[str, str], str]:
    """(letter, wanted script) -> letter of that script, for all letters, marks and digits that Unicode's security data
    (UTS 39) call confusable, as the ICU library that Spark brings along has them; fixed values above go before them.

    Letters stand in for each other if their skeletons are equal. Of several letters of the wanted script the one that is
    the skeleton itself is taken; without it a letter that two of one script are like has none there.
    """
    chars = [c for c in map(chr, range(0x30, 0x20000)) if unicodedata.category(c) in ("Lu", "Ll", "Lo", "Mn", "Mc", "Nd") and script_block(c) not in ("", "cjk", "hangul")]
    chars = [c for c in chars if len(unicodedata.normalize("NFKD", c)) == 1 and unicodedata.is_normalized("NFKC", c)]
    skeletons = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(chars)).split("\n")
    groups: dict[str, dict[str, list[str]]] = {}
    for c, skeleton in zip(chars, skeletons, strict=True):
        groups.setdefault(skeleton, {}).setdefault(script_block(c), []).append(c)
    made = {}
    for skeleton, held in groups.items():
        for target, own in held.items():
            if len(own) == 1 or skeleton in own:
                made |= {(c, target): skeleton if skeleton in own else own[0] for script, others in held.items() if script != target for c in others}
    return made | LOOK_ALIKE


def readings(word: str, table: dict[tuple[str, str], str] = LOOK_ALIKE) -> list[str]:
    """Every way to write a word of several scripts in one of them, the dominant script's first.

    Empty for a word of one script, and for one that no look-alikes lead to a single script.
    """
    counts = Counter(s for s in map(script_block, word) if s)
    if len(counts) < 2:
        return []
    firm = Counter(s for c in word if (s := script_block(c)) and not any((c, t) in table for t in counts if t != s))
    made = []
    for target in sorted(counts, key=lambda s: (-firm[s], -counts[s], s != LATIN, s)):
        out = []
        for c in word:
            if (s := script_block(c)) and s != target:
                c = table.get((c, target), "")
                if not c:
                    break
            out.append(c)
        else:
            made.append(unicodedata.normalize("NFKC", "".join(out)))
    return made


def fold(text: str) -> str:
    """Compatibility composition, one blank, nothing invisible; the scripts stay as they are."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _BLANK.sub(" ", _INVISIBLE.sub("", text))


def _suspect(text: str) -> bool:
    return bool(_SIGNS.search(text) or _EAST.search(text) or _MALAYALAM.search(text) and _TAMIL.search(text))


def repair_word(word: str) -> str:
    word = _tamil_signs(word) if _SIGNS.search(word) else word
    made = readings(word)
    return made[0] if made else word


def consistent(text: str | None, word: Callable[[str], str] = repair_word, every: bool = False) -> str | None:
    """The consistent form; ``word`` writes one word in its own script. It's asked about words of scripts that the fixed
    values tell of, or with ``every`` about those of any script."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return unicodedata.normalize("NFC", text) if _LOOSE.search(text) else text
    text = fold(text)
    if every or _suspect(text):
        text = unicodedata.normalize("NFKC", _WORD.sub(lambda m: word(m[0]), text))
    return text


def letters(text: str | None) -> str:
    """Consistent form without white space, punctuation and case; '' for null."""
    return _NOT_LETTER.sub("", consistent(text).casefold()) if text else ""


def words(text: str | None) -> list[str]:
    """Words of the consistent form without case and punctuation; none for null."""
    return _PUNCTUATION.sub("", consistent(text).casefold()).split() if text else []


def filled(text: str | None) -> int:
    """Characters of the consistent form that aren't blank; 0 for null."""
    return len(_ALL_BLANK.sub("", consistent(text))) if text else 0


@F.pandas_udf(T.StringType())
def consistent_column(text: pd.Series) -> pd.Series:
    return text.map(consistent, na_action="ignore")


@F.pandas_udf(T.StringType())
def letters_column(text: pd.Series) -> pd.Series:
    return text.map(letters, na_action="ignore")


@F.pandas_udf(T.IntegerType())
def filled_column(text: pd.Series) -> pd.Series:
    return text.map(lambda t: filled(t) if isinstance(t, str) else 0)
