"""Address features as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as X
from .text import listed, words


def _ascii_digits(x: Column) -> Column:
    digits = [(chr(b + d), str(d)) for b in range(0x0966, 0x0D67, 0x80) for d in range(10)]
    return F.translate(x, "".join(a for a, _ in digits), "".join(b for _, b in digits))


def primary_number(addr: Column) -> Column:
    """The first whole number, 0 unless it lies in 1..9,999,999 (later numbers aren't tried)."""
    n = F.regexp_replace(_ascii_digits(F.regexp_extract(F.coalesce(addr, F.lit("")), r"(?U)\b\d+\b", 0)), "^0+", "")
    return F.when(F.length(n).between(1, 7), n.try_cast("int")).otherwise(0)


def numbers(addr: Column, most: int = 3) -> Column:
    """The first valid numbers."""
    found = F.transform(F.regexp_extract_all(F.coalesce(addr, F.lit("")), F.lit(r"(\b\d+\b)"), F.lit(1)), lambda s: F.regexp_replace(s, "^0+", ""))
    return F.slice(F.transform(F.filter(found, lambda s: F.length(s).between(1, 7)), lambda s: s.try_cast("int")), 1, most)


def postal_code(addr: Column, country: Column | None = None) -> Column:
    """The first whole number of six digits (not from 0) or five; by country: six for India, five elsewhere."""
    six, five = r"\b[1-9]\d{5}\b", r"\b\d{5}\b"
    take = lambda p: F.regexp_extract(F.coalesce(addr, F.lit("")), f"(?U){p}", 0)
    if country is None:
        return take(f"{six}|{five}")
    return F.when(F.lower(country) == "india", take(six)).when(F.lower(country).isin("us", "usa", "united states", "france"), take(five)).otherwise("")


def _plain(tokens: Column, least: int, stop: list[str]) -> Column:
    drop = listed(stop)
    return F.filter(tokens, lambda t: (F.length(t) >= least) & ~F.array_contains(drop, t) & ~t.rlike("^[0-9]+$"))


def street_token(na: Column, stop: list[str]) -> Column:
    return F.coalesce(F.get(_plain(words(na), 4, stop), F.lit(0)), F.lit(""))


def address_tokens(na: Column, stop: list[str]) -> Column:
    return F.array_distinct(_plain(words(na), 3, stop))


def _first_of(tokens: Column, among: list[str]) -> Column:
    known = listed(among)
    return F.get(F.filter(tokens, lambda t: F.array_contains(known, t)), F.lit(0))


def _mapped(tokens: Column, table: dict[str, str]) -> Column:
    literal = F.str_to_map(F.lit("|".join(f"{k}:{v}" for k, v in table.items())), F.lit(r"\|"), F.lit(":"))
    return F.try_element_at(literal, _first_of(tokens, list(table)))


def state(na: Column, country: Column, wide: bool = True) -> Column:
    """wide: joined or scattered state names, abbreviations and unambiguous codes; else plain containment and codes.
    States are tried in the order of the list, codes in the order of the address."""
    t, c = words(na), F.lower(country)
    flat = F.replace(na, F.lit(" "), F.lit(""))
    india = []
    for s in X.INDIA_STATES:
        if not wide:
            hit = na.contains(s)
        else:
            hit = F.lit(True)
            for w in s.split():
                hit = hit & F.array_contains(t, w)
            hit = hit if s == "goa" else hit | flat.contains(s.replace(" ", ""))
        india.append(F.when(hit, "odisha" if wide and s == "orissa" else s))
    if wide:
        first = F.when(F.array_contains(t, "orissa"), "odisha")
        clear = [s for s in X.US_STATES if s not in X.US_AMBIGUOUS]
        last = F.slice(t, F.greatest(F.size(t) - 1, F.lit(1)), 2)
        ind = F.coalesce(first, *india, _mapped(t, X.INDIA_ABBR))
        us = F.coalesce(_first_of(t, clear), _first_of(last, X.US_STATES))
    else:
        ind, us = F.coalesce(*india), _first_of(t, X.US_STATES)
    return F.coalesce(F.when(c == "india", ind).when(c == "us", us), F.lit(""))


def metro(na: Column, country: Column) -> Column:
    return F.when(F.lower(country) == "india", F.coalesce(_mapped(words(na), X.METROS), F.lit(""))).otherwise("")


def shares_registration_number(a: Column, b: Column) -> Column:
    """Any shared standalone number of 6, 7 or 10 digits (a diagnostic)."""
    take = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\b(\d{10}|\d{6,7})\b"), F.lit(1))
    return F.arrays_overlap(take(a), take(b))
