"""Text functions built from native expressions, so they stay in generated code."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from signalloom.functions import lexicons

# Every character that counts as white space, and the letters and digits of words.
_SPACES = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0", r"\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# One comparison keeps all later characters from the list of wide spaces.
SPACE = rf"[{_SPACES[0]}[\u1680-\u3000&&[{_SPACES[1]}]]]"
NOT_SPACE = rf"[^{''.join(_SPACES)}]"
SPACE_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}"

# Patterns of markup, links and personal data.
TAG_PATTERN = r"(?d)<.*?>"
LINK_PATTERN = rf"https?://{NOT_SPACE}+|www\.{NOT_SPACE}+"
# (The looks ahead are for speed: most places of a text fail them at once.)
EMAIL_PATTERN = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
HANDLE_PATTERN = r"(?<![A-Za-z0-9_])@[A-Za-z0-9_.-]{2,}"
PHONE_PATTERN = r"(?U)(?=[+\d])(?<!\d)(?:\+?\d[\d .()-]{7,}\d)(?!\d)"
REDACTED = "redacted"

# Blocks of pictographs removed before keyword extraction.
EMOJI_PATTERN = (
    r"[\x{2600}-\x{1FAFF}&&[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}"
    r"\x{2600}-\x{26FF}]]+"
)


def strip(col: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.btrim(col, F.lit(SPACE_CHARACTERS))


def collapse(col: Column) -> Column:
    """Turn every run of white space into one blank and trim."""
    return F.trim(F.regexp_replace(col, rf"{SPACE}+", " "))


def is_blank(col: Column) -> Column:
    """True for NULL, empty and white-space-only texts."""
    return col.isNull() | ~col.rlike(NOT_SPACE)


def blank_to_null(col: Column) -> Column:
    """Stripped text, NULL when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def clean_text(col: Column) -> Column:
    """Remove tags and links, collapse white space; NULL becomes empty."""
    text = F.coalesce(col, F.lit(""))
    return collapse(F.regexp_replace(F.regexp_replace(text, TAG_PATTERN, ""), LINK_PATTERN, ""))


def casefold(col: Column) -> Column:
    """Caseless form: lower case plus the folds that lower case leaves out."""
    source, target = _fold_table()
    return F.replace(F.translate(F.lower(col), source, target), F.lit("ß"), F.lit("ss"))


@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    pairs = [
        (c, c.casefold())
        for c in map(chr, range(0x80, 0x10000))
        if c == c.lower() and c.casefold() != c and len(c.casefold()) == 1
    ]
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """All characters that decompose into one base character and accents."""
    source, target = [], []
    for code in range(0xC0, sys.maxunicode + 1):
        c = chr(code)
        if 0xD800 <= code <= 0xDFFF or not unicodedata.decomposition(c):
            continue
        bare = [d for d in unicodedata.normalize("NFD", c) if unicodedata.category(d) != "Mn"]
        if len(bare) == 1 and bare[0] != c:
            source.append(c)
            target.append(bare[0])
    return "".join(source), "".join(target)


def strip_accents(col: Column) -> Column:
    """Base letters without accents; letters such as đ that have none stay."""
    source, target = _accent_table()
    plain = F.regexp_replace(F.translate(col, source, target), r"\p{Mn}+", "")
    # Texts of one byte per character need no table at all.
    return F.when(F.octet_length(col) != F.length(col), plain).otherwise(col)


def normalize_key(col: Column) -> Column:
    """Key under which spelling variants of one term meet."""
    return collapse(strip_accents(F.lower(col)))


@lru_cache(1)
def _changing() -> str:
    """Class of the characters that composing can change or join to the one before."""
    codes = [
        c for c in range(0x80, 0x110000)
        if not 0xD800 <= c < 0xE000
        and (unicodedata.category(chr(c))[0] == "M" or 0x1100 <= c <= 0x11FF or unicodedata.normalize("NFC", chr(c)) != chr(c))
    ]
    ranges: list[list[int]] = []
    for c in codes:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    # The first half of the intersection is one comparison, which keeps the hundreds of ranges from ASCII and Latin letters.
    return f"[\\x{{{codes[0]:X}}}-\\x{{10FFFF}}&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]]"


@F.pandas_udf(StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def compose_accents(col: Column) -> Column:
    """Composed form of texts that hold loose accents or letter variants.

    Spark has no such function. Only texts that hold a character that could
    change travel to Python; all others pass as NULL and keep their value.
    """
    loose = col.rlike(_changing())
    return F.coalesce(_compose(F.when(loose, col)), col)


def literal_pattern(value: Column) -> Column:
    """Pattern that matches ``value`` literally."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def redact(col: Column, identifiers: Column | None = None) -> Column:
    """Hide known identifiers, then e-mail addresses, handles and phone numbers.

    ``identifiers`` is an array column with the account values known for the
    row. Longer ones go first, so one that contains another is hidden whole.
    """
    text = col
    if identifiers is not None:
        values = F.filter(F.transform(identifiers, strip), lambda v: v != "")
        ordered = F.array_sort(
            F.array_distinct(values),
            lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
            .when(a < b, F.lit(-1))
            .when(a > b, F.lit(1))
            .otherwise(F.lit(0)),
        )
        token = r"[A-Za-z0-9_.-]"

        def hide(acc: Column, value: Column) -> Column:
            exact = literal_pattern(value)
            bounded = F.concat(F.lit(f"(?<!{token})"), exact, F.lit(f"(?!{token})"))
            pattern = F.when(value.rlike(f"^{token}+$"), bounded).otherwise(exact)
            hidden = F.regexp_replace(acc, F.concat(F.lit("(?iu)"), pattern), F.lit(REDACTED))
            # Letters beyond ASCII can match others than their lower case, so such texts are always searched.
            wide = (F.octet_length(acc) != F.length(acc)) | (F.octet_length(value) != F.length(value))
            return F.when(wide | F.lower(acc).contains(F.lower(value)), hidden).otherwise(acc)

        text = F.when(F.size(ordered) > 0, F.aggregate(ordered, col, hide)).otherwise(col)

    def addresses(found: Column) -> Column:
        hidden = F.regexp_replace(F.regexp_replace(found, EMAIL_PATTERN, REDACTED), HANDLE_PATTERN, f"@{REDACTED}")
        return F.when(found.contains("@"), hidden).otherwise(found)

    # The array gives the text a name, so that it is not built again for the test; it is NULL where the text is.
    text = F.get(F.transform(F.array(text), addresses), 0)
    return F.regexp_replace(text, PHONE_PATTERN, REDACTED)


def primary_language(col: Column) -> Column:
    """First part of a language tag: en for en-US and EN_us."""
    return F.element_at(F.split(F.lower(strip(col)), "[-_]"), 1)


def supports_language(col: Column, languages: tuple[str, ...] = lexicons.SUPPORTED_LANGUAGES) -> Column:
    """True for an unknown language and for the given ones."""
    return is_blank(col) | F.coalesce(primary_language(col).isin(*languages), F.lit(False))


def word_set(col: Column, stop_words: tuple[str, ...] = lexicons.FIT_STOP_WORDS) -> Column:
    """Distinct lower-case words of a text without stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(rf"([{WORD}_]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop_words)))
