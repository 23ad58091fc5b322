"""Text functions as Column expressions. Every function maps null to null unless it says otherwise."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def preprocess(c: Column) -> Column:
    """Index form: ASCII letters lower-cased, white space as a blank, all else deleted.

    Deleting comes first: lower() knows all of Unicode and would let in letters such as the Kelvin sign.
    """
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z\s]", ""), r"\s", " "))


def preprocess_letters(c: Column) -> Column:
    """As preprocess, with the blanks deleted too."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


def clean_text(c: Column) -> Column:
    """Letters and single blanks, case kept; null becomes the empty string."""
    letters = F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z ]", " ")
    return F.trim(F.regexp_replace(letters, r"\s+", " "))


def trigrams(c: Column) -> Column:
    """Overlapping trigrams of c in order, repeats kept; empty below three characters. Meant for index-form texts.

    A look-ahead that captures three characters matches at every position; one pass, where a substring by position
    would count from the start of the text each time.
    """
    return F.regexp_extract_all(c, F.lit("(?s)(?=(...))"), F.lit(1))


def extract_words(c: Column, min_len: int = 3) -> Column:
    """Lower-cased runs of at least min_len ASCII letters, in order."""
    runs = F.regexp_extract_all(c, F.lit("([A-Za-z]+)"), F.lit(1))
    return F.transform(F.filter(runs, lambda w: F.length(w) >= min_len), lambda w: F.lower(w))


def title_of(line: Column) -> Column:
    """Content of the first title element of a line, empty where there is none."""
    return F.regexp_extract(line, "<title>(.*?)</title>", 1)


def unescape_html(c: Column | str) -> Column:
    """HTML entities resolved. No built-in knows the entity table, so this runs on Arrow batches."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(html.unescape, na_action="ignore")

    return F.pandas_udf(run, "string")(c)


def is_blank(c: Column, placeholders: tuple[str, ...] = ()) -> Column:
    """True for null, white space only, or one of the placeholders (compared in lower case)."""
    t = F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.coalesce((t == "") | t.isin(*placeholders) if placeholders else t == "", F.lit(True))


def has_common(a: Column, b: Column) -> Column:
    """Do two lists share an element? Never null for lists that are not."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
