"""Score ladders: a column of 0..100 for a pair, by channel and profile; 0 rejects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import similarity as S

L, R = S.Side("l_"), S.Side("r_")
PAIR = S.Side("")


def similar(j: float, g: float) -> Column:
    return (S.jaccard(L.toks, R.toks) >= j) | (S.jaccard(L.grams, R.grams) >= g)


def _initial() -> Column:
    return F.substring(L.nn, 1, 1) == F.substring(R.nn, 1, 1)


def _chain(*rules: tuple[Column, Column | int]) -> Column:
    out = F.when(F.lit(False), 0)
    for cond, v in rules:
        out = out.when(cond, v)
    return out.otherwise(0)


def _evidence(number: int, post: int, shared: int | None, other: int, l: S.Side = L, r: S.Side = R) -> Column:
    rules = [(S.same_number(l, r), number), (S.same(l.post, r.post), post)]
    if shared is not None:
        rules.append((S.shared_address(l, r), shared))
    return _chain(*rules, (F.lit(True), other))


def _stream(exact, core, sorted_, prefix, anchor, token_street, sound_street, pin, spaceless=None, brand_state=None) -> Column:
    """The later profiles: four grades of evidence for names, similarity for the other channels."""
    rules = [(PAIR.channel == "exact", _evidence(*exact)), (PAIR.channel == "core", F.when(S.single_word_guard(L, R), _evidence(*core)).otherwise(0)), (PAIR.channel == "sorted", _evidence(sorted_[0], sorted_[1], None, sorted_[2]))]
    if spaceless:
        rules.append((PAIR.channel == "spaceless", F.lit(spaceless)))
    for name, t in (("prefix", prefix), ("anchor", anchor), ("token_street", token_street), ("sound_street", sound_street), ("brand_state", brand_state), ("pin", pin)):
        if t:
            rules.append((PAIR.channel == name, F.when(similar(t[1], t[2]), t[0]).otherwise(0)))
    return _chain(*rules)


def _graded(t: dict) -> Column:
    """v09 and v10: exact or near number, or a missing one by bucket size; metro and postcode veto all but pin."""
    eq, near, missing = S.same_number(L, R), S.number_near(L, R), S.number_missing(L, R)
    veto = S.differ(L.metro, R.metro) | S.differ(L.post, R.post)
    street = S.same(L.s_tok, R.s_tok)
    a, b, c, d, e = (similar(*t[k]) for k in ("street", "other", "anchor", "token", "pin"))
    grams = S.jaccard(L.grams, R.grams)
    return _chain(
        ((PAIR.channel != "pin") & veto, 0),
        (PAIR.channel == "exact", _chain((eq, 100), (near, 92), (missing & S.same(L.post, R.post), 94), (missing & (PAIR.bucket <= 3), 90), (missing & (PAIR.bucket <= 6), 84))),
        (PAIR.channel == "core", _chain((eq, 94), (near, 88), (missing & (PAIR.bucket <= 2), 88))),
        (PAIR.channel == "sorted", _chain((eq, 92), (near, 86), (missing & (PAIR.bucket <= 2), 84))),
        (PAIR.channel == "prefix", _chain((street & a, 92), (street, t["floor"]), (b, 88))),
        (PAIR.channel == "anchor", F.when(c | (_initial() & (grams >= t["initial"])), 84).otherwise(0)),
        (PAIR.channel == "token_street", F.when(d, 90).otherwise(0)),
        (PAIR.channel == "pin", F.when(e, 88).otherwise(0)),
    )


def _rebound(hardened: bool) -> Column:
    """v05, and v06 with vetoes and similarity."""
    eq, conflict, missing = S.same_number(L, R), S.number_conflict(L, R), S.number_missing(L, R)
    j = S.jaccard(L.toks, R.toks)
    veto = (S.differ(L.metro, R.metro) | S.differ(L.post, R.post)) if hardened else F.lit(False)
    post = S.same(L.post, R.post) & missing if hardened else F.lit(False)
    anchor = ((j >= 0.33) | _initial()) if hardened else ((PAIR.bucket == 1) | _initial())
    token = (~S.differ(L.metro, R.metro) & ((j >= 0.30) | (F.length(L.brand) >= 7))) if hardened else F.lit(True)
    return _chain(
        (PAIR.channel.isin("exact", "core", "sorted") & (veto | conflict), 0),
        (PAIR.channel == "exact", _chain((eq, 100), (post, 90), (missing & (PAIR.bucket <= 6), 85), (missing & (PAIR.bucket <= 12), 80))),
        (PAIR.channel == "core", _chain((eq, 90), (post, 90), (missing & (PAIR.bucket <= 3), 80))),
        (PAIR.channel == "sorted", _chain((eq, 88), (post, 90), (missing & (PAIR.bucket <= 2), 80))),
        (PAIR.channel == "prefix", F.lit(84 if hardened else 82)),
        (PAIR.channel == "anchor", F.when(anchor, 76 if hardened else 75).otherwise(0)),
        (PAIR.channel == "token_street", F.when(token, 85 if hardened else 82).otherwise(0)),
        (PAIR.channel == "pin", F.lit(84 if hardened else 82)),
    )


def _first() -> Column:
    eq, missing = S.same_number(L, R), S.number_missing(L, R)
    return _chain(
        (PAIR.channel == "exact", _chain((eq, 100), (missing & (PAIR.bucket <= 3), 80))),
        (PAIR.channel == "core", _chain((eq, 90), (missing & (PAIR.bucket <= 2), 75))),
        (PAIR.channel == "anchor", F.lit(70)),
    )


def _decoupled() -> Column:
    eq, missing, street = S.same_number(L, R), S.number_missing(L, R), S.same(L.s_tok, R.s_tok)
    return _chain(
        (PAIR.channel == "exact", _chain((eq, 100), (missing & (PAIR.bucket <= 3), 80), (missing & street, 85))),
        (PAIR.channel == "core", _chain((eq, 90), (missing & (PAIR.bucket <= 2), 75), (missing & street, 80))),
        (PAIR.channel == "sorted", _chain((eq, 88), (missing & (PAIR.bucket <= 2), 75), (missing & street, 80))),
        (PAIR.channel == "number_token", _chain((street, 85), (PAIR.bucket == 1, 78))),
        (PAIR.channel == "anchor", _chain((PAIR.bucket <= 2, 72), (R.indic, 71), (_initial(), 71), (PAIR.bucket <= 4, 70))),
    )


def _evaluated() -> Column:
    """v04 as its evaluation runs it."""
    eq, missing, street = S.same_number(L, R), S.number_missing(L, R), S.same(L.s_tok, R.s_tok)
    return _chain(
        (PAIR.channel == "exact", _chain((eq, 100), (missing & (PAIR.bucket <= 3), 80), (missing & street, 85))),
        (PAIR.channel == "core", _chain((eq, 90), (missing & (PAIR.bucket <= 2), 75), (missing & street, 80))),
        (PAIR.channel == "sorted", _chain((eq, 88), (missing & (PAIR.bucket <= 2), 75), (missing & street, 80))),
        (PAIR.channel == "number_token", _chain((street, 85), (PAIR.bucket == 1, 78))),
        (PAIR.channel == "anchor", _chain((PAIR.bucket == 1, 74), (R.indic, 73), (_initial(), 72), (PAIR.bucket <= 3, 70))),
    )


def tuner() -> Column:
    """The graded scorer of the tuner; bucket is the size of the candidate union.  A pair that a rule on shared words
    doesn't settle goes on to the next one."""
    eq, street = S.same_number(L, R), S.same(L.s_tok, R.s_tok)
    shared, overlap = F.size(F.array_intersect(L.name_toks, R.name_toks)), F.size(F.array_intersect(L.addr_words, R.addr_words))
    near = street | (overlap >= 1)
    return _chain(
        (S.number_conflict(L, R), 0),
        (L.nn == R.nn, _chain((eq, 100), (PAIR.bucket <= 2, 92), (PAIR.bucket <= 5, 85), (near, 88))),
        (S.same(L.core, R.core), _chain((eq, 95), (PAIR.bucket <= 2, 85), (near, 82))),
        ((shared >= 2) & eq, 90),
        ((shared >= 2) & (street | (overlap >= 2)), 80),
        ((shared >= 1) & eq & near, 85),
        (eq & street & (PAIR.bucket <= 4), 78),
    )


SCORERS = {
    "equal": lambda: F.lit(100),
    "s1": _first,
    "s2": _decoupled,
    "s3": _evaluated,
    "s7": tuner,
    "s4": lambda: _rebound(False),
    "s5": lambda: _rebound(True),
    "s6a": lambda: _graded({"street": (0.30, 0.40), "other": (0.35, 0.50), "floor": 86, "anchor": (0.30, 0.45), "initial": 0.30, "token": (0.33, 0.45), "pin": (0.33, 0.45)}),
    "s6b": lambda: _graded({"street": (0.25, 0.35), "other": (0.30, 0.40), "floor": 84, "anchor": (0.25, 0.35), "initial": 0.25, "token": (0.30, 0.40), "pin": (0.30, 0.40)}),
    "s8": lambda: _stream((100, 98, 95, 90), (95, 92, 88, 85), (92, 90, 85), (90, 0.35, 0.45), (88, 0.35, 0.45), (92, 0.40, 0.50), (88, 0.45, 0.55), (88, 0.35, 0.45)),
    "s9": lambda: _stream((100, 98, 95, 90), (95, 92, 88, 84), (92, 90, 84), (90, 0.30, 0.40), (88, 0.30, 0.40), (92, 0.35, 0.45), (88, 0.40, 0.50), (88, 0.35, 0.45), 95, (88, 0.35, 0.45)),
    "s10": lambda: _stream((100, 98, 95, 88), (95, 92, 88, 85), (92, 90, 85), (90, 0.35, 0.45), (88, 0.35, 0.45), (92, 0.40, 0.50), (88, 0.45, 0.55), (88, 0.38, 0.48)),
}
