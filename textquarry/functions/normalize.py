"""Unicode folding of perturbed text.

The fold has four layers in a fixed order: the explicit look-alike and
typographic tables, compatibility decomposition with non-spacing marks removed
and recomposed, removal of format characters, and collapsing of runs of blanks.

Two routes exist. ``fold_native`` covers the two tables and the blanks inside
whole-stage codegen. The full fold needs compatibility decomposition, for which
Spark has no expression, and runs as an Arrow UDF: one C-level ``str.translate``
per text with a table that learns each code point when it first sees it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textquarry import tables

BLANK_RUN = re.compile("  +")
#: Code points Python's ``\s`` matches, written out so that the JVM agrees.
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class _FoldTable(dict):
    """Code point to folded text, filled on demand; context-free part of the fold."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        plain = unicodedata.normalize("NFKD", tables.FOLDS.get(char, char))
        kept = "".join(c for c in plain if unicodedata.category(c) != "Mn")
        self[code] = out = unicodedata.normalize("NFC", kept)
        return out


class _FormatTable(dict):
    """Deletes the code points of category Cf."""

    def __missing__(self, code: int) -> int | None:
        self[code] = out = None if unicodedata.category(chr(code)) == "Cf" else code
        return out


class _LetterTable(dict):
    """Code point to its folded, lower-cased letters and digits a-z, 0-9."""

    def __missing__(self, code: int) -> str:
        self[code] = out = re.sub("[^a-z0-9]", "", _FOLD[code].lower())
        return out


_FOLD, _FORMAT, _LETTERS = _FoldTable(), _FormatTable(), _LetterTable()


def fold_text(text: str | None) -> str | None:
    """The full fold of one text; null stays null, empty stays empty."""
    if not text:
        return text
    out = text.translate(_FOLD)
    if not out.isascii():
        if not unicodedata.is_normalized("NFC", out):
            out = unicodedata.normalize("NFC", out)
        out = out.translate(_FORMAT)
    return BLANK_RUN.sub(" ", out)


def fold_text_collapsed(text: str | None) -> str | None:
    """The fold with every run of white space made one blank and the edges trimmed."""
    folded = fold_text(text)
    return " ".join(folded.split()) if folded else folded


def fold_letters(text: str | None) -> str:
    """What is left of the folded, lower-cased text when only a-z and 0-9 stay; '' for null."""
    return text.translate(_LETTERS) if text else ""


def _compat(text: str | None) -> str | None:
    if not text:
        return text
    out = unicodedata.normalize("NFKC", text).translate(_FORMAT)
    return " ".join(out.split())


@F.pandas_udf(StringType())
def _fold_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(fold_text, na_action="ignore")


@F.pandas_udf(StringType())
def _fold_collapsed_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(fold_text_collapsed, na_action="ignore")


@F.pandas_udf(StringType())
def _compat_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(_compat, na_action="ignore")


def fold(text: Column, collapse: bool = True) -> Column:
    """Full fold (N1-N6). ``collapse`` also makes every white-space run one blank. Null gives null."""
    return _fold_collapsed_udf(text) if collapse else _fold_udf(text)


def fold_compat(text: Column) -> Column:
    """The NFKC variant without the tables."""
    return _compat_udf(text)


def _mapped(text: Column, folds: dict[str, str]) -> Column:
    single = {k: v for k, v in folds.items() if len(v) == 1}
    gone = [k for k, v in folds.items() if not v]
    out = F.translate(text, "".join([*single, *gone]), "".join(single.values()))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), ((k, v) for k, v in folds.items() if len(v) > 1), out)


def fold_native(text: Column) -> Column:
    """The explicit tables and blank runs only (N1, N2, N5), inside codegen."""
    return F.regexp_replace(_mapped(text, tables.FOLDS), "  +", " ")


def fold_first(text: Column) -> Column:
    """The first, smaller normaliser (N7): its table, then format characters dropped."""
    return F.regexp_replace(_mapped(text, tables.FIRST_FOLDS), r"\p{Cf}", "")


def collapse_white(text: Column) -> Column:
    """Runs of white space become one blank; the edges are trimmed."""
    return F.trim(F.regexp_replace(text, WHITE + "+", " "))


def escape_markup(text: Column) -> Column:
    """``&``, ``<`` and ``>`` as entities."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def beyond_ascii(text: Column) -> Column:
    """Number of characters outside ASCII; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(text, r"[\x00-\x7F]", "")), F.lit(0))
