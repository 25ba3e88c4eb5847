"""Matching profiles as data: which normaliser, channels, limits, scores, gate and selection each one uses."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import lexicons as X


@dataclass(frozen=True)
class Profile:
    name: str
    normalizer: str
    channels: tuple[str, ...]
    scorer: str
    index_side: str = "targets"  # whose postings caps and bucket sizes count: targets or reference
    legal: tuple[str, ...] = tuple(X.LEGAL)
    stop: tuple[str, ...] = tuple(X.STOP_SHORT)
    distinct_core: bool = True
    least_core: int = 2
    wide_state: bool = True
    street_phonetic: bool = False
    street_needs_number: bool = False  # no street token without a number
    loose_probe: bool = False  # a reference record looks up its core and sorted core whatever its whole name is
    strict_probe: bool = False  # a target's sorted core counts only if its core isn't its whole name
    caps: dict[str, int] = field(default_factory=dict)  # keep the first n postings of a key
    suppress: dict[str, int] = field(default_factory=dict)  # use a key only up to n postings
    threshold: int = 0
    gate: tuple[bool, str] | None = None  # (relaxed, rule without proof)
    merge: str = "max"  # max, append, ladder, fallback, both_empty, union
    top: int | None = None
    tiers: tuple[tuple[int, int], ...] = ()  # (rank, least score)
    candidate_cap: int | None = None
    match_cap: int | None = None
    accents: str = "drop"


_WIDE = dict(legal=tuple(X.INDUSTRY), stop=tuple(X.STOP_LONG))
_FIVE = ("exact", "core", "sorted", "prefix", "anchor", "token_street", "pin")
_STREAM = ("exact", "core", "sorted", "prefix", "anchor", "token_street", "sound_street", "pin")

PROFILES = {
    p.name: p
    for p in (
        Profile("v01", "exact", ("exact",), "equal"),
        Profile("v02", "marks", ("exact",), "equal"),
        Profile("v03", "latin", ("exact", "core", "anchor"), "s1", suppress={"anchor": 6}, distinct_core=False, least_core=1, street_needs_number=True, merge="fallback", top=2),
        Profile("v04", "latin", ("exact", "core", "sorted", "number_token", "anchor"), "s2", distinct_core=False, least_core=1, street_needs_number=True, caps={"sorted": 20, "anchor": 20, "number_token": 15}, suppress={"anchor": 6, "number_token": 3}, merge="ladder", top=2),
        Profile("v04e", "latin", ("exact", "core", "sorted", "number_token", "anchor"), "s3", distinct_core=False, least_core=1, street_needs_number=True, caps={"sorted": 20, "anchor": 20, "number_token": 15}, suppress={"anchor": 5, "number_token": 3}, merge="both_empty", top=2),
        Profile("tuner", "latin", ("exact", "core", "sorted", "anchor", "number_tokens", "two_words"), "s7", distinct_core=False, least_core=1, street_needs_number=True, caps={"exact": 50, "core": 30, "sorted": 30, "anchor": 20, "number_tokens": 20, "two_words": 20}, loose_probe=True, threshold=80, merge="union", top=2),
        Profile("v05", "domains", _FIVE, "s4", distinct_core=False, suppress={"prefix": 4, "anchor": 6, "token_street": 4, "pin": 4}, caps={"prefix": 10, "token_street": 8, "pin": 8}, threshold=75, merge="append", top=5),
        Profile("v06", "domains", _FIVE, "s5", suppress={"prefix": 4, "anchor": 6, "token_street": 4, "pin": 4}, caps={"prefix": 10, "token_street": 8, "pin": 8}, threshold=75, merge="append", top=5),
        Profile("v09", "domains", _FIVE, "s6a", **_WIDE, suppress={"prefix": 6, "anchor": 1, "token_street": 4, "pin": 3}, caps={"prefix": 8, "token_street": 6, "pin": 6}, threshold=82, merge="append", top=4),
        Profile("v10", "domains", _FIVE, "s6b", **_WIDE, suppress={"prefix": 6, "anchor": 1, "token_street": 4, "pin": 3}, caps={"prefix": 8, "token_street": 6, "pin": 6}, threshold=82, top=4),
        Profile("v11", "ascii", _STREAM, "s8", "reference", **_WIDE, wide_state=False, caps={"prefix": 6, "anchor": 6, "token_street": 5, "sound_street": 5, "pin": 6}, threshold=85, gate=(False, "distinctive"), tiers=((3, 95), (2, 85)), candidate_cap=8, match_cap=5),
        Profile("v12", "ascii", (*_STREAM, "spaceless", "brand_state"), "s9", "reference", **_WIDE, street_phonetic=True, caps={"prefix": 6, "anchor": 6, "token_street": 5, "sound_street": 5, "brand_state": 5, "pin": 6}, threshold=82, gate=(True, "names"), tiers=((3, 90), (2, 82)), candidate_cap=8, match_cap=5),
        Profile("v13", "champion", _STREAM, "s10", "reference", **_WIDE, street_phonetic=True, strict_probe=True, caps={"token_street": 5, "sound_street": 5}, threshold=85, gate=(False, "words"), tiers=((3, 95), (2, 90), (1, 85)), candidate_cap=8, match_cap=5),
    )
}
