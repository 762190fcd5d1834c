"""Column functions that clean text. All but Unicode normalisation stay inside Spark."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..settings import EXOTIC_SPACES, FOOTERS, LIGATURES

#: White space at either end, Unicode's and the separators U+001C to U+001F included.
_SPACE = r"[\s\x1c-\x1f\x85]"


#: The same characters one by one, and those of them that typesetting leaves inside words or that end a line (with a carriage return before it, a line feed ends one with it).
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_INNER = "\u00a0\u2007\u202f\u2009\u200a"
_BREAKS = ("\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def strip(text: Column) -> Column:
    """The text without white space at its ends; only the ends are looked at."""
    return F.btrim(text, F.lit(_SPACES))


def lead(text: Column) -> Column:
    """How much white space a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(_SPACES)))


def fewer_words(text: Column, n: int) -> Column:
    """Whether a text has fewer than n words; no more of it than these is looked at."""
    if n < 1:
        return F.lit(False) & text.isNotNull()
    space, word = _SPACE, rf"[^{_SPACE[1:]}"
    return ~F.rlike(text, F.lit(rf"(?U)\A{space}*+(?:{word}++{space}++){{{n - 1}}}{word}"))


def replaced(text: Column, found: str, written: str) -> Column:
    """Characters of `found` become those of `written`; unlike `translate` this goes by bytes, and a text without any of them stays as it is."""
    for a, b in zip(found, written, strict=True):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def normalize_unicode(text: Column) -> Column:
    """Ligatures spelled out, then compatibility normalisation (NFKC)."""
    for found, written in LIGATURES.items():
        text = F.replace(text, F.lit(found), F.lit(written))
    return _nfkc(text)


def join_hyphenated(text: Column) -> Column:
    """Words split at a line end are joined where the next line goes on in lower case."""
    # looking for the hyphen behind a letter first leaves most places at once, and of the word its last letter
    return F.regexp_replace(text, r"(?U)(?=(?s:.)-)(\w+)-\n([a-z])", "$1$2")


def collapse_whitespace(text: Column) -> Column:
    """Exotic spaces go inside words and become spaces elsewhere; runs of white space shrink."""
    # one range holds them all and leaves plain letters at once; which it is, and what is before it, is asked behind it
    text = F.regexp_replace(text, rf"(?U)[\u00A0-\u202F](?<=\w{EXOTIC_SPACES})(?=\w)", "")
    for space in (*_INNER, "\t"):
        text = F.replace(text, F.lit(space), F.lit(" "))
    text = F.replace(F.regexp_replace(text, "  +", " "), F.lit(" \n"), F.lit("\n"))
    return strip(F.regexp_replace(text, r"\n\n\n+", "\n\n"))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end begins no further line.

    `text` is mentioned once, as Spark works out an expression again for every mention. All line
    ends become line feeds first, so that the pattern has one character to look for.
    """
    for end in _BREAKS:
        text = F.replace(text, F.lit(end), F.lit("\n"))
    return F.regexp_extract_all(text, F.lit(r"([^\n]+)(?:\n|\z)|\n"), F.lit(1))


def line_key(line: Column) -> Column:
    """A line as compared between pages: stripped, inner white space as one space."""
    # a blank before a plain character is its own key
    return F.regexp_replace(strip(line), rf"(?U)(?=[^!-~])(?! [!-~]){_SPACE}+", " ")


def without_footers(text: Column) -> Column:
    """Lines that are page numbers or stamps go."""

    footer = r"\A(?:" + "|".join(f"(?:{p})" for p in FOOTERS) + ")"
    return F.array_join(F.filter(lines(text), lambda line: ~F.rlike(line, F.lit(footer))), "\n")


def without_lines(text: Column, repeated: Column) -> Column:
    """Lines whose key is in the array `repeated` go; null removes none."""
    known = F.coalesce(repeated, F.array().cast("array<string>"))
    return F.array_join(F.filter(lines(text), lambda x: ~F.array_contains(known, line_key(x))), "\n")


def clean_text(text: Column, repeated: Column | None = None) -> Column:
    """The whole cleaning, in its fixed order; line removal only if `repeated` is given."""
    text = join_hyphenated(normalize_unicode(text))
    if repeated is not None:
        text = without_lines(text, repeated)
    return collapse_whitespace(without_footers(text))


def initials(name: Column) -> Column:
    """First letters of the first and last word of a name, in capitals; a question mark without any."""
    words = F.filter(F.split(strip(name), r"\s+"), lambda w: w != "")
    ends = F.when(F.size(words) > 1, F.concat(F.substring(words[0], 1, 1), F.substring(F.element_at(words, -1), 1, 1)))
    return F.upper(F.coalesce(ends, F.when(F.size(words) == 1, F.substring(words[0], 1, 2)), F.lit("?")))


def shown_date(iso: Column) -> Column:
    """A time in ISO form (UTC) as "Mar 5, 2024"; a dash for none, and what is no time as it is."""
    at = F.try_to_timestamp(F.regexp_replace(iso, "Z$", ""))
    return F.when(F.coalesce(iso, F.lit("")) == "", "—").otherwise(F.coalesce(F.date_format(at, "MMM d, yyyy"), iso))


def truncated(text: Column, most: int) -> Column:
    """The first `most` characters and an ellipsis, if there are more."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)
