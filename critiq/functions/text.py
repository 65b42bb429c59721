"""Text cleaning, case folding and tokenising."""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The 29 white-space characters of Unicode text stripping.
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680]
        + [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# Fixed value: line boundaries of Unicode text, as a Java pattern.
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Characters on which NFKC changes nothing, no two of which compose, and whose
# case folding is their lower case: such text is folded inside the JVM.
_PLAIN_RANGES = (
    (0x00, 0x7F),
    (0xA1, 0xA7),
    (0xA9, 0xA9),
    (0xAB, 0xAC),
    (0xAE, 0xAE),
    (0xB0, 0xB1),
    (0xB6, 0xB7),
    (0xBB, 0xBB),
    (0xBF, 0xDE),
    (0xE0, 0x12F),
    (0x139, 0x13E),
    (0x141, 0x148),
    (0x14A, 0x17E),
    (0x400, 0x481),
    (0x490, 0x4FF),
    (0x2010, 0x2010),
    (0x2012, 0x2014),
    (0x2018, 0x201E),
    (0x2020, 0x2022),
    (0x20AC, 0x20AC),
    (0x3041, 0x3096),
    (0x30A1, 0x30FA),
    (0x4E00, 0x9FEF),
    (0xAC00, 0xD7A3),
)
PLAIN_TEXT = "^[%s]*$" % "".join(r"\x{%x}-\x{%x}" % pair for pair in _PLAIN_RANGES)

# A maximal run of word characters that is at least two long and has no
# underscore in it.
TOKEN = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}]{2,}+(?!_)"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def clean_text(col: Column) -> Column:
    """Strip; blank becomes null."""
    return F.nullif(strip(col.cast("string")), F.lit(""))


@F.pandas_udf(StringType())
def _nfkc_fold(text: pd.Series) -> pd.Series:
    return text.map(
        lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore"
    )


@F.pandas_udf(StringType())
def _fold(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s.casefold(), na_action="ignore")


def _is_plain(col: Column) -> Column:
    return (F.length(col) == F.octet_length(col)) | col.rlike(PLAIN_TEXT)


def _with_jvm_fast_path(col: Column, slow) -> Column:
    # A Python function sees every row of its batch; rows the JVM can fold are
    # handed over as null.
    plain = _is_plain(col)
    return F.coalesce(slow(F.when(~plain, col)), F.lower(col))


def nfkc_casefold(col: Column) -> Column:
    return _with_jvm_fast_path(col, _nfkc_fold)


def casefold(col: Column) -> Column:
    """Full case folding of long text."""
    return _with_jvm_fast_path(col, _fold)


@cache
def _special_folds() -> dict[str, str]:
    """Characters whose case folding is not their lower case."""
    characters = map(chr, range(sys.maxunicode + 1))
    return {c: c.casefold() for c in characters if c.casefold() != c.lower()}


# As JSON, which Spark folds into one constant map at plan time.
_SPECIAL_FOLDS = json.dumps(_special_folds(), ensure_ascii=False)


def casefold_label(col: Column) -> Column:
    """Full case folding of a short label without leaving the JVM."""
    table = F.from_json(F.lit(_SPECIAL_FOLDS), "map<string,string>")
    by_character = F.array_join(
        F.transform(
            F.split(col, ""),
            lambda c: F.coalesce(F.try_element_at(table, c), F.lower(c)),
        ),
        "",
    )
    return F.when(_is_plain(col), F.lower(col)).otherwise(by_character)


def tokens(col: Column) -> Column:
    """``array<string>`` of folded word tokens, in text order."""
    return F.regexp_extract_all(nfkc_casefold(col), F.lit(TOKEN), F.lit(0))


def plain_name(name: str) -> str:
    """Column name reduced to folded ASCII letters and digits."""
    return "".join(c for c in str(name).casefold() if c in _NAME_CHARACTERS)


_NAME_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def plain_name_col(col: Column) -> Column:
    """``plain_name`` of a column of names."""
    folded = col
    for c, fold in _special_folds().items():
        if _NAME_CHARACTERS & set(fold):
            folded = F.replace(folded, F.lit(c), F.lit(fold))
    name = F.when(F.length(col) == F.octet_length(col), col).otherwise(folded)
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
