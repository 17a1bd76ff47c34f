"""Matching topics and titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Han, kana and hangul are written without spaces and need n-grams.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]+"
_SPACED = r"[\p{L}\p{N}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]]+"


def occurrences(text: Column, n: int = 2) -> Column:
    """Terms of a text, repeats included: lower-case words, then n-grams of runs written without spaces (a shorter run is one term). Null: none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    runs = F.regexp_extract_all(lowered, F.lit(_UNSPACED), F.lit(0))
    grams = F.flatten(
        F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (n - 1), F.lit(1))), lambda i: F.substring(r, i, F.lit(n))))
    )
    return F.concat(F.regexp_extract_all(lowered, F.lit(_SPACED), F.lit(0)), grams)


def terms(text: Column, n: int = 2) -> Column:
    """Different terms of a text."""
    return F.array_distinct(occurrences(text, n))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of different terms; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def trimmed(text: Column) -> Column:
    """Trims ASCII blanks and the ideographic space alike."""
    return F.btrim(text, F.lit(" \t\r\n　"))
