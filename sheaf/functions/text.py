"""Text functions: normalisation, tokens, search predicates."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no function for it. Texts go to Python in small batches."""
    small_batches(SparkSession.active())
    return _nfc(text)


@F.pandas_udf(T.StringType())
def _strip_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"), na_action="ignore")


def strip_marks(text: Column) -> Column:
    """Text without combining marks, for accent-insensitive search with wildcards."""
    small_batches(SparkSession.active())
    return _strip_marks(text)


def tidy(text: Column) -> Column:
    """Control signs go (but line feed, return and tab), blanks become one space, line breaks one line feed, ends are trimmed."""
    text = F.regexp_replace(text, r"[\p{C}&&[^\n\r\t]]", "")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    text = F.regexp_replace(text, r"(?U)\s*\n\s*", "\n")
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def normalize_text(text: Column) -> Column:
    """tidy() of composed text; null becomes empty."""
    return tidy(nfc(F.coalesce(text, F.lit(""))))


def tokens(text: Column) -> Column:
    """Words between white space. A segmenter for another language may take its place."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), "")


def matches_any(pattern: str | None, *columns: Column) -> Column | None:
    """Whether any column holds the pattern, case aside; % _ and \\ in it are wildcards. No pattern: no predicate."""
    if not pattern:
        return None
    return reduce(lambda a, b: a | b, [c.ilike(f"%{pattern}%") for c in columns])


def matches_any_accentless(pattern: str | None, *columns: Column) -> Column | None:
    """matches_any() with accents aside on both sides."""
    if not pattern:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", pattern) if unicodedata.category(c) != "Mn")
    return matches_any(plain, *[strip_marks(c) for c in columns])


#: How the tables compare texts: case, accents and trailing spaces aside.
COLLATION = "UNICODE_CI_AI_RTRIM"


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case, accents and trailing spaces."""
    return F.collate(a, COLLATION) == F.collate(b, COLLATION)


def collated(rows: DataFrame, column: str) -> Column:
    """A column as a key of groups, joins and windows: texts by the tables' collation, others as they are."""
    return F.collate(F.col(column), COLLATION) if isinstance(rows.schema[column].dataType, T.StringType) else F.col(column)
