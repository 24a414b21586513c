"""Tokens of names and addresses as array columns.

`base`, `full` and `address` are normalised strings (normalize_name with and without
suffixes, normalize_address); `raw` is an address as it was read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .lexicon import LEGAL_SUFFIXES, SUFFIX_FOLDS
from .text import mapped


def empty() -> Column:
    return F.array().cast("array<string>")


def words(text: Column, least: int = 2) -> Column:
    """Distinct words of at least `least` characters, in order."""
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: F.length(w) >= least))


def pieces(text: Column, n: int) -> Column:
    """All substrings of n characters, in order; none if the text is shorter."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substring(text, i, F.lit(n)))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-grams without spaces; a shorter text is its own gram, an empty one has none."""
    tight = F.replace(text, F.lit(" "), F.lit(""))
    return F.when(F.length(tight) >= n, F.array_distinct(pieces(tight, n))).when(tight != "", F.array(tight)).otherwise(empty())


def name_bigrams(base: Column) -> Column:
    """Neighbours among the sorted words."""
    sorted_ = F.array_sort(words(base))
    places = F.when(F.size(sorted_) > 1, F.sequence(F.lit(1), F.size(sorted_) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat_ws(" ", F.element_at(sorted_, i), F.element_at(sorted_, i + 1)))


def name_abbreviation(base: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(words(base)), lambda w: F.left(w, F.lit(1))), "")


def first_word(base: Column) -> Column:
    return F.split_part(base, F.lit(" "), F.lit(1))


def numbers(raw: Column, digits: str = P.DIGITS) -> Column:
    """The words of raw that are digits throughout, in order; words are runs of letters, digits and underscores."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), P.BETWEEN_WORDS), lambda w: F.rlike(w, F.lit(digits)))


def numeric_tokens(raw: Column) -> Column:
    return F.array_distinct(numbers(raw))


def postal_tokens(raw: Column) -> Column:
    """Numbers of five or six digits, and French delivery words with their number."""
    return F.array_union(numbers(raw, P.POSTAL_DIGITS), F.regexp_extract_all(F.lower(F.coalesce(raw, F.lit(""))), F.lit(P.DELIVERY), 0))


def phone_tokens(raw: Column) -> Column:
    """Runs of 7 to 15 digits once the usual signs between them are gone; the last ten digits of each."""
    digits = F.regexp_extract_all(F.translate(F.coalesce(raw, F.lit("")), P.PHONE_SIGNS, ""), F.lit(P.PHONE_DIGITS), 0)
    return F.array_distinct(F.transform(digits, lambda d: F.right(d, F.lit(10))))


def blocking_tokens(base: Column) -> Column:
    """Words, then every 3-gram of the base name without spaces; repeats are kept, since they weigh."""
    return F.concat(F.filter(F.split(base, " "), lambda w: F.length(w) >= 2), pieces(F.replace(base, F.lit(" "), F.lit("")), 3))


def legal_suffix(full: Column) -> Column:
    """The last legal suffix, folded; null if there is none."""
    found = F.filter(F.split(full, " "), lambda w: w.isin(LEGAL_SUFFIXES))
    return mapped(F.try_element_at(found, F.lit(-1)), SUFFIX_FOLDS)


def street_number(raw: Column) -> Column:
    """The first number; null if there is none."""
    return F.try_element_at(numbers(raw), F.lit(1))
