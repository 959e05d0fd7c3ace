"""Text normalisation, case folds and tokenisers as column expressions.

Four folds exist on purpose; they are not interchangeable:

* ``text_fold``    - NFC, full lower case, U+0307 dropped (keyword model)
* ``loose_fold``   - ``text_fold`` plus diacritics erased (signal model)
* ``marker_fold``  - dotted capital I first, then NFC and lower (language, behaviour)
* ``ascii_fold``   - lower plus a six-letter translate, U+0307 kept (priority, identity)
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

COMBINING_DOT = "\u0307"
LOOSE_FROM, LOOSE_TO = "ışğüöçâîûêô", "isguocaiueo"
ASCII_FROM, ASCII_TO = "ığüşöç", "igusoc"
# Letters as Python's [^\W\d_] sees them: letters plus letter-like numbers.
LETTER = r"\p{L}\p{Nl}\p{No}"
# Python's \w: letters, every numeric category and the underscore.
WORD = r"\p{L}\p{N}_"
# Below U+0300 every code point is already NFC-stable on its own, and so is
# common punctuation; anything else goes through the Arrow normaliser.
NFC_SUSPECT = r"[\u0300-\u200F\u2028-\u202F\u205F-\u209F\u20C1-\x{10FFFF}]"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``: a local binding for the
    interpreted bodies of lambdas, where repeated subexpressions are not shared."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@F.pandas_udf(StringType())
def _nfc_batch(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


def nfc_suspect(col: Column) -> Column:
    """Whether a string may change under NFC."""
    return F.coalesce((F.octet_length(col) != F.length(col)) & F.regexp_like(col, F.lit(NFC_SUSPECT)), F.lit(False))


def nfc(col: Column) -> Column:
    """NFC form. Only strings that may change are shipped to Python; the rest
    travel as nulls, so Latin text costs no serialisation."""
    plain_ascii = F.octet_length(col) == F.length(col)
    suspect = F.when(~plain_ascii & F.regexp_like(col, F.lit(NFC_SUSPECT)), col)
    return F.coalesce(_nfc_batch(suspect), col)


def strip(col: Column) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def collapse_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, r"(?U)\s+", " "))


def normalize_text(col: Column) -> Column:
    """Unix line ends, NFC, control and format characters dropped (tab and LF kept)."""
    lines = F.regexp_replace(col, r"\r\n?", "\n")
    return F.regexp_replace(nfc(lines), r"[\p{Cc}\p{Cf}&&[^\t\n]]", "")


def casefold(col: Column) -> Column:
    """Lower case plus the two foldings that occur in running European text."""
    return F.replace(F.replace(F.lower(col), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def text_fold(col: Column, is_nfc: bool = False) -> Column:
    return F.replace(casefold(col if is_nfc else nfc(col)), F.lit(COMBINING_DOT), F.lit(""))


def loose_fold(col: Column, is_nfc: bool = False) -> Column:
    return F.translate(text_fold(col, is_nfc), LOOSE_FROM, LOOSE_TO)


def marker_fold(col: Column) -> Column:
    return casefold(nfc(F.replace(col, F.lit("İ"), F.lit("i"))))


def ascii_fold(col: Column) -> Column:
    return F.translate(F.lower(F.coalesce(col, F.lit(""))), ASCII_FROM, ASCII_TO)


def letter_tokens(col: Column) -> Column:
    """Letter runs of the loosely folded text."""
    return F.regexp_extract_all(loose_fold(col), F.lit(f"[{LETTER}]+"), F.lit(0))


def token_line(folded: Column) -> Column:
    """`` tok tok tok `` of already folded text. Looking a word up as ``' word '``
    and a stem as ``' stem'`` turns token tests into plain substring searches."""
    return F.concat(F.lit(" "), F.regexp_replace(folded, f"[^{LETTER}]+", " "), F.lit(" "))


def tokenize_tr(col: Column, stopwords, charset: str = "a-zçğıöşü0-9") -> Column:
    """Retrieval tokens: dotless/dotted I fixed first, short and stop words dropped."""
    lowered = F.lower(F.replace(F.replace(F.coalesce(col, F.lit("")), F.lit("I"), F.lit("ı")), F.lit("İ"), F.lit("i")))
    tokens = F.regexp_extract_all(lowered, F.lit(f"[{charset}]+"), F.lit(0))
    stop = sorted(stopwords)
    keep = lambda t: (F.length(t) > 1) & ~t.isin(stop) if stop else F.length(t) > 1
    return F.filter(tokens, keep)


def round_half_even(col: Column, digits: int = 0) -> Column:
    return F.bround(col.cast("double"), digits)


def number_matches(col: Column, pattern: str, label: str) -> Column:
    """Replace the n-th match of ``pattern`` by ``{{REDACTED_<label>_n}}``."""
    parts = F.split(col, pattern, -1)
    numbered = F.transform(
        parts,
        lambda part, i: F.when(i > 0, F.concat(F.lit("{{REDACTED_" + label + "_"), i.cast("string"), F.lit("}}"), part)).otherwise(part),
    )
    return F.array_join(numbered, "")


def quote_pattern(col: Column) -> Column:
    """Escape every character that could be read as regex syntax."""
    return F.regexp_replace(col, r"([^\p{L}\p{N}\s])", r"\\$1")
