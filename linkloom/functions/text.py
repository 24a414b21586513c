"""Normalisers as Column expressions: inlined into the plan and run in generated code, no Python on the way."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .lexicon import COUNTRY_FOLDS, DOMAIN_ENDINGS, LEGAL_SUFFIXES, LETTERS, STREET_FOLDS, SUFFIX_FOLDS


#: U+0300 to U+036F: marks that stand behind the letter that they belong to.
MARKS = "".join(map(chr, range(0x300, 0x370)))


SEP, IS = "\x01", "\x02"


def ascii_form(letter: str) -> str:
    """What compatibility decomposition leaves of a character without its marks, or the letter that a Latin letter is named after; empty if that isn't ASCII."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", letter) if not unicodedata.combining(c)).replace("\u2044", "/")
    if not plain.isascii():
        name = unicodedata.name(letter, "").split(" WITH ")[0].split()
        plain = name[3] if len(name) == 4 and name[0] == "LATIN" and name[2] == "LETTER" and len(name[3]) == 1 else ""
        plain = plain.lower() if name[1:2] == ["SMALL"] else plain
    return plain if plain.isprintable() else ""


@cache
def letter_folds() -> tuple[tuple[str, str], dict[str, str]]:
    """Characters of the basic plane with one ASCII character for them, as two strings, and those with several."""
    forms = {chr(c): ascii_form(chr(c)) for c in range(0xA0, 0xFFF0) if not 0xD800 <= c < 0xE000} | {x: y for x, y in LETTERS.items() if len(y) == 1}
    one = {x: y for x, y in forms.items() if len(y) == 1}
    several = {x: y for x, y in forms.items() if len(y) > 1} | {x: y for x, y in LETTERS.items() if len(y) > 1}
    return ("".join(one), "".join(one.values())), several


def let(value: Column, made: Callable[[Column], Column]) -> Column:
    """made(value), with value computed once however often made reads it: nested copies would grow the plan with each level."""
    return F.element_at(F.transform(F.array(value), made), F.lit(1))


def as_map(folds: dict[str, str]) -> Column:
    """One literal that is folded to a map, instead of one for each word."""
    return F.str_to_map(F.lit(SEP.join(x + IS + y for x, y in folds.items())), F.lit(SEP), F.lit(IS))


def fold(text: Column) -> Column:
    """Lower case, with Latin letters reduced to ASCII, marks behind letters dropped; other scripts stay."""
    (those, plain), several = letter_folds()
    table = as_map(several)
    spelt = lambda out: F.array_join(F.transform(F.split(out, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    # The marks have no counterpart, so they go.
    folded = F.translate(text, those + MARKS, plain)
    return F.lower(let(folded, lambda out: F.when(F.rlike(out, F.lit("[" + "".join(several) + "]")), spelt(out)).otherwise(out)))


def mapped(word: Column, folds: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(as_map(folds), word), word)


def basic_clean(text: Column) -> Column:
    """Folded, punctuation as spaces, single spaces; null and blank give the empty string."""
    spaced = F.regexp_replace(fold(F.coalesce(text, F.lit(""))), P.NOT_WORD, " ")
    return F.trim(F.regexp_replace(spaced, P.SPACE, " "))


def host_of(name: Column) -> Column:
    """The host that a trimmed name consists of, without www and port: what stands between an optional scheme and the first slash. Null if that has anything but letters, digits, dots and hyphens, or a line ends in the path."""

    def of_server(rest: Column, server: Column) -> Column:
        short = let(F.regexp_replace(server, P.WWW, ""), lambda short: F.when(short == "", server).otherwise(short))
        return F.when(F.rlike(server, F.lit(P.HOST_LETTERS)) & ~F.contains(rest, F.lit("\n")), short)

    return let(F.regexp_replace(name, P.SCHEME, ""), lambda rest: let(F.regexp_replace(F.split_part(rest, F.lit("/"), F.lit(1)), P.PORT, ""), lambda server: of_server(rest, server)))


def own_words(host: Column) -> Column:
    """The host's labels, spaces between them, without the longest known ending behind another label."""

    def cut(labels: Column) -> Column:
        last = lambda n: F.lower(F.array_join(F.slice(labels, F.size(labels) - (n - 1), F.lit(n)), "."))
        known = lambda n: [e for e in DOMAIN_ENDINGS if e.count(".") == n - 1]
        drop = F.when(F.size(labels) < 2, 0).when((F.size(labels) > 2) & last(2).isin(known(2)), 2).when(last(1).isin(known(1)), 1).otherwise(0)
        return F.translate(F.array_join(F.slice(labels, F.lit(1), F.size(labels) - drop), " "), "-_", "  ")

    return let(F.split(host, "[.]"), cut)


def clean_domain_name(name: Column) -> Column:
    """basic_clean of a domain's own words if the name looks like a URL or domain, else of the name. A name such as "X/..." reads as a host too, which is kept."""

    def of_name(name: Column) -> Column:
        host = F.when(F.contains(name, F.lit(".")) | F.contains(name, F.lit("/")), host_of(name))
        return F.coalesce(let(host, lambda h: F.when(h.isNotNull(), own_words(h))), name)

    return basic_clean(let(F.trim(F.coalesce(name, F.lit(""))), of_name))


def normalize_country(country: Column) -> Column:
    key = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    return mapped(F.trim(F.regexp_replace(key, P.NOT_WORD, "")), COUNTRY_FOLDS)


def normalize_name(name: Column, strip_suffixes: bool = False) -> Column:
    """The cleaned name, its legal suffixes folded, or dropped wherever they stand."""
    words = F.split(clean_domain_name(name), " ")
    if strip_suffixes:
        words = F.filter(words, lambda w: ~w.isin(LEGAL_SUFFIXES))
    else:
        words = F.transform(words, lambda w: mapped(w, SUFFIX_FOLDS))
    return F.array_join(words, " ")


def normalize_address(address: Column) -> Column:
    return F.array_join(F.transform(F.split(basic_clean(address), " "), lambda w: mapped(w, STREET_FOLDS)), " ")
