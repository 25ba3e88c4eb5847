"""Set similarity and the address gates, over two sides of features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words


class Side:
    """Columns of one side of a pair: ``side.b_num`` is ``<prefix>b_num``."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(self._prefix + name)


class Fields(Side):
    """Fields of a struct: ``side.b_num`` is its ``b_num``."""

    def __init__(self, x: Column):
        self._x = x

    def __getattr__(self, name: str) -> Column:
        return self._x[name]


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def both(a: Column, b: Column) -> Column:
    return (a != "") & (b != "")


def differ(a: Column, b: Column) -> Column:
    return both(a, b) & (a != b)


def same(a: Column, b: Column) -> Column:
    return both(a, b) & (a == b)


def same_number(l: Side, r: Side) -> Column:
    return (l.b_num > 0) & (l.b_num == r.b_num)


def number_conflict(l: Side, r: Side) -> Column:
    return (l.b_num > 0) & (r.b_num > 0) & (l.b_num != r.b_num)


def number_near(l: Side, r: Side, band: int = 2) -> Column:
    return (l.b_num > 0) & (r.b_num > 0) & (F.abs(l.b_num - r.b_num) <= band)


def number_far(l: Side, r: Side) -> Column:
    return (l.b_num > 0) & (r.b_num > 0) & (F.abs(l.b_num - r.b_num) > 2)


def number_missing(l: Side, r: Side) -> Column:
    return (l.b_num == 0) | (r.b_num == 0)


def shared_address(l: Side, r: Side) -> Column:
    return F.arrays_overlap(l.a_toks, r.a_toks)


def near_address(l: Side, r: Side) -> Column:
    return (F.size(F.array_intersect(l.a_toks, r.a_toks)) >= 2) | (jaccard(l.a_toks, r.a_toks) >= 0.25)


def vetoes(l: Side, r: Side, relaxed: bool = False) -> dict[str, Column]:
    """Reasons to reject a pair, in order: state, metro, postcode, building."""
    split = F.array_sort(F.array(l.state, r.state)) == F.array(F.lit("andhra pradesh"), F.lit("telangana"))
    far = number_far(l, r) & ~near_address(l, r) if relaxed else number_far(l, r)
    return {
        "state": differ(l.state, r.state) & ~(split & shared_address(l, r)),
        "metro": differ(l.metro, r.metro),
        "postcode": differ(l.post, r.post),
        "building": far,
    }


def proof(l: Side, r: Side) -> Column:
    return same_number(l, r) | same(l.post, r.post) | shared_address(l, r)


def empty_address(l: Side, r: Side, rule: str) -> Column:
    """What may pass without any proof, where a side has no address tokens.  rule: distinctive, names, words,
    diagnostic."""
    bare = (F.size(l.a_toks) == 0) | (F.size(r.a_toks) == 0)
    exact, no_post = l.nn == r.nn, (l.post == "") & (r.post == "")
    core = (l.core != "") & (l.core == r.core)
    flat = l.flat == r.flat
    n = F.size(words(l.nn))
    rules = {
        "distinctive": no_post & exact & (F.size(l.toks) >= 3),
        "names": exact | (core & (F.size(words(l.core)) >= 2)) | (flat & (F.length(r.nn) >= 6)),
        "words": no_post & exact & ((n >= 3) | ((n >= 2) & (F.length(l.nn) >= 14))),
        "diagnostic": exact | core | same(l.sorted_core, r.sorted_core) | flat,
    }
    return bare & rules[rule]


def gate_reason(l: Side, r: Side, relaxed: bool, rule: str) -> Column:
    """The first veto that rejects, 'no proof', or null for a pair that passes."""
    out = F.when(F.lit(False), "")
    for name, hit in vetoes(l, r, relaxed).items():
        out = out.when(hit, name)
    return out.when(~(proof(l, r) | empty_address(l, r, rule)), "no proof")


def gate(l: Side, r: Side, relaxed: bool, rule: str) -> Column:
    return gate_reason(l, r, relaxed, rule).isNull()


def plain_gate_reason(l: Side, r: Side) -> Column:
    """The four steps of the evaluation gate: the first that rejects, or null."""
    apart = (F.size(l.a_toks) > 0) & (F.size(r.a_toks) > 0) & ~proof(l, r)
    far = number_conflict(l, r) & ~number_near(l, r)
    return F.when(differ(l.state, r.state), "state").when(differ(l.post, r.post), "postcode").when(far, "building").when(apart, "no overlap")


def single_word_guard(l: Side, r: Side, loose: bool = False) -> Column:
    """A core of one word needs an equal number or postcode; if loose, any proof of the address."""
    return (F.size(words(r.core)) != 1) | (proof(l, r) if loose else same_number(l, r) | same(l.post, r.post))
