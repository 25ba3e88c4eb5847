"""Normalisers and name features as built-in column expressions."""

from __future__ import annotations

import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as X

PUNCTUATION = r"[\p{P}$+<=>^`|~]"


def casefold(x: Column) -> Column:
    """Lower case with sharp s and the f-ligatures taken apart."""
    x = F.lower(x)
    for a, b in (("ß", "ss"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[\s\x1c-\x1f]+", " "))


def unpunctuate(x: Column) -> Column:
    return F.regexp_replace(x, PUNCTUATION, " ")


def fold_accents(x: Column) -> Column:
    pairs = [(c, a) for a, cs in X.ACCENTS.items() for c in cs]
    pairs += [(c.upper(), a) for c, a in pairs if len(c.upper()) == 1 and c.upper() != c]
    return F.translate(x, "".join(p[0] for p in pairs), "".join(p[1] for p in pairs))


def transliterate(x: Column) -> Column:
    """Indic letters by their place in the block; every other character beyond ASCII goes."""
    known = [(chr(c), X.BRAHMIC[c % 0x80]) for c in range(0x0900, 0x0D80) if c % 0x80 in X.BRAHMIC]
    return F.regexp_replace(F.translate(x, "".join(k for k, _ in known), "".join(v for _, v in known)), r"[^\x00-\x7F]", "")


def strip_domains(x: Column) -> Column:
    for d in X.DOMAINS:
        x = F.replace(x, F.lit(d), F.lit(" "))
    return x


def is_indic(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike("[ऀ-ൿ]")


def is_non_latin(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]")


def _without_marks(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn"))


def strip_marks(x: Column) -> Column:
    """Compatibility decomposition without combining marks; Spark has no function for it."""
    return F.pandas_udf(_without_marks, "string")(x)


def normalize(x: Column, mode: str, accents: str = "drop") -> Column:
    """Modes: exact and marks (null if empty); latin, domains, ascii, champion ('' if empty).  accents: drop or
    fold, for the modes that transliterate."""
    if mode in ("exact", "marks"):
        x = strip_marks(x) if mode == "marks" else x
        return F.nullif(collapse(unpunctuate(casefold(x))), F.lit(""))
    x = F.coalesce(x, F.lit(""))
    if mode == "latin":
        return collapse(unpunctuate(fold_accents(casefold(x))))
    if accents == "fold":
        x = fold_accents(x)
    if mode == "domains":
        return collapse(unpunctuate(strip_domains(casefold(transliterate(x)))))
    x = transliterate(casefold(x)) if mode == "champion" else casefold(transliterate(x))
    marks = string.punctuation.replace("_", "")
    return collapse(F.translate(strip_domains(x), marks, " " * len(marks)))


def words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


def listed(values) -> Column:
    """An array of constants as one constant expression, which is folded when the query is planned."""
    return F.split(F.lit("|".join(values)), r"\|")


def without(tokens: Column, *lists: list[str]) -> Column:
    drop = listed(sorted({w for ws in lists for w in ws}))
    return F.filter(tokens, lambda t: ~F.array_contains(drop, t))


def joined(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def core_name(nn: Column, legal: list[str]) -> Column:
    return joined(without(words(nn), legal))


def sorted_core(nn: Column, legal: list[str], stop: list[str], distinct: bool = True, least: int = 2) -> Column:
    t = without(words(nn), legal, stop)
    t = F.array_distinct(t) if distinct else t
    return F.when(F.size(t) >= least, joined(F.array_sort(t))).otherwise("")


def tokens(nn: Column, least: int, *lists: list[str]) -> Column:
    """The words of a normalised name of at least ``least`` letters that are in none of the lists, in order."""
    return F.filter(without(words(nn), *lists), lambda t: F.length(t) >= least)


def first_long(tokens: Column, n: int) -> Column:
    return F.coalesce(F.get(F.filter(tokens, lambda t: F.length(t) >= n), F.lit(0)), F.lit(""))


def spaceless(nn: Column) -> Column:
    return F.replace(nn, F.lit(" "), F.lit(""))


def trigrams(nn: Column) -> Column:
    s = spaceless(nn)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 2, F.lit(1))), lambda i: F.substr(s, i, F.lit(3))))


def phonetic(w: Column) -> Column:
    """First letter and the codes of the coded letters behind it; equal neighbours once, vowels don't part them."""
    letters, codes = "".join(X.SOUNDEX.values()), "".join(k * len(v) for k, v in X.SOUNDEX.items())
    w = F.lower(w)
    body = F.translate(F.regexp_replace(F.substring(w, 2, 1 << 30), f"[^{letters}]", ""), letters, codes)
    for k in X.SOUNDEX:
        body = F.regexp_replace(body, f"{k}+", k)
    return F.when(w == "", "").otherwise(F.rpad(F.substring(F.concat(F.substring(w, 1, 1), body), 1, 4), 4, "0"))


def phonetic_reset(w: Column) -> Column:
    """The analysis flavour: upper-case first letter, whose code counts, and any uncoded letter parts equal codes."""
    letters, codes = "".join(X.SOUNDEX.values()), "".join(k * len(v) for k, v in X.SOUNDEX.items())
    a = F.regexp_replace(F.lower(w), "[^a-z]", "")
    coded = F.translate(F.regexp_replace(a, f"[^{letters}]", "0"), letters, codes)
    for k in X.SOUNDEX:
        coded = F.regexp_replace(coded, f"{k}+", k)
    tail = F.replace(F.substring(coded, 2, 1 << 30), F.lit("0"), F.lit(""))
    return F.when(a == "", "").otherwise(F.rpad(F.substring(F.concat(F.upper(F.substring(a, 1, 1)), tail), 1, 4), 4, "0"))
