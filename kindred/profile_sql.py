"""The DuckDB SQL of whole profiles over the firm records: an independent rendering of the rules, for comparison."""

from __future__ import annotations

import string

from .functions import lexicons as X
from .plans.profiles import PROFILES, Profile
from .sources import fixtures

FIRMS = f"records AS ({fixtures.FIRMS.format(part='(SELECT p_partkey AS k FROM part)')})"
FIRM_TRUTH = "truth AS (SELECT a.entity_id AS s1, b.entity_id AS cid FROM records a JOIN records b ON a.entity_id LIKE 'S1-%' AND b.entity_id NOT LIKE 'S1-%' AND CAST(floor(CAST(split_part(a.entity_id, '-', 2) AS BIGINT) / 4) AS BIGINT) = CAST(floor(CAST(split_part(b.entity_id, '-', 2) AS BIGINT) / 4) AS BIGINT))"


def words_list(ws) -> str:
    return "[" + ", ".join(f"'{w}'" for w in ws) + "]"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Normalisers ------------------------------------------------------------------------------------------------


def casefold(x: str) -> str:
    return f"replace(replace(replace(replace(lower({x}), 'ß', 'ss'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def unpunctuate(x: str) -> str:
    return rf"regexp_replace({x}, '[\p{{P}}$+<=>^`|~]', ' ', 'g')"


def fold(x: str) -> str:
    return f"translate({x}, {_quoted(''.join(X.ACCENTS.values()))}, {_quoted(''.join(k * len(v) for k, v in X.ACCENTS.items()))})"


def indic(x: str) -> str:
    pairs = [(chr(c), X.BRAHMIC[c % 128]) for c in range(0x900, 0xD80) if c % 128 in X.BRAHMIC]
    return rf"regexp_replace(translate({x}, {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs))}), '[^\x00-\x7F]', '', 'g')"


def domains(x: str) -> str:
    for d in X.DOMAINS:
        x = f"replace({x}, '{d}', ' ')"
    return x


def normalized(x: str, mode: str) -> str:
    if mode == "exact":
        return f"nullif({collapse(unpunctuate(casefold(x)))}, '')"
    if mode == "marks":
        return f"nullif({collapse(unpunctuate(casefold(f'strip_accents({x})')))}, '')"
    if mode == "latin":
        return collapse(unpunctuate(fold(casefold(x))))
    if mode == "domains":
        return collapse(unpunctuate(domains(casefold(indic(x)))))
    marks = string.punctuation.replace("_", "")
    plain = indic(casefold(x)) if mode == "champion" else casefold(indic(x))
    return collapse(f"translate({domains(plain)}, {_quoted(marks)}, '{' ' * len(marks)}')")


# Features ---------------------------------------------------------------------------------------------------


def state(p: Profile) -> str:
    found = []
    for s in X.INDIA_STATES:
        if not p.wide_state:
            found.append(f"WHEN contains(na, '{s}') THEN '{s}'")
            continue
        hit = " AND ".join(f"list_contains(t, '{w}')" for w in s.split())
        if s != "goa":
            hit = f"({hit}) OR contains(replace(na, ' ', ''), '{s.replace(' ', '')}')"
        found.append(f"WHEN {hit} THEN '{'odisha' if s == 'orissa' else s}'")
    codes = words_list(X.US_STATES)
    if not p.wide_state:
        return f"CASE WHEN c = 'india' THEN CASE {' '.join(found)} ELSE '' END WHEN c = 'us' THEN coalesce(list_filter(t, lambda x: list_contains({codes}, x))[1], '') ELSE '' END"
    short = f"CASE list_filter(t, lambda x: list_contains({words_list(X.INDIA_ABBR)}, x))[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.INDIA_ABBR.items()) + " ELSE '' END"
    clear = words_list([s for s in X.US_STATES if s not in X.US_AMBIGUOUS])
    us = f"coalesce(list_filter(t, lambda x: list_contains({clear}, x))[1], list_filter(t[-2:], lambda x: list_contains({codes}, x))[1], '')"
    return f"CASE WHEN c = 'india' THEN CASE WHEN list_contains(t, 'orissa') THEN 'odisha' {' '.join(found)} ELSE {short} END WHEN c = 'us' THEN {us} ELSE '' END"


def sound(x: str) -> str:
    body = f"translate(regexp_replace(substr({x}, 2), '[^bfpvcgjkqsxzdtlmnr]', '', 'g'), 'bfpvcgjkqsxzdtlmnr', '111122222222334556')"
    for k in "123456":
        body = f"regexp_replace({body}, '{k}+', '{k}', 'g')"
    return f"CASE WHEN {x} = '' THEN '' ELSE rpad(substr(substr({x}, 1, 1) || {body}, 1, 4), 4, '0') END"


def features(p: Profile) -> str:
    """CTEs records and f of a profile."""
    legal, both, stop = words_list(p.legal), words_list((*p.legal, *p.stop)), words_list(p.stop)
    split = lambda x: f"list_filter(string_split({x}, ' '), lambda x: x <> '')"
    kept = f"list_filter(w, lambda x: NOT list_contains({both}, x))"
    base = kept if not p.distinct_core else f"list_distinct({kept})"
    metros = f"CASE list_filter(t, lambda x: list_contains({words_list(X.METROS)}, x))[1] " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.METROS.items()) + " ELSE '' END"
    plain = f"list_filter(t, lambda x: NOT list_contains({stop}, x) AND NOT regexp_matches(x, '^[0-9]+$'))"
    street = f"coalesce(list_filter({plain}, lambda x: length(x) >= 4)[1], '')"
    if p.street_needs_number:
        street = f"CASE WHEN b_num > 0 THEN {street} ELSE '' END"
    return rf"""{FIRMS}, f0 AS (
  SELECT entity_id, split_part(entity_id, '-', 1) AS src, lower(trim(country)) AS c, business_name AS name, business_address AS addr,
    {normalized('business_name', p.normalizer)} AS nn, coalesce({normalized('business_address', p.normalizer)}, '') AS na
  FROM records), f1 AS (
  SELECT *, {split('nn')} AS w, {split('na')} AS t, replace(nn, ' ', '') AS flat,
    CASE WHEN length(ltrim(regexp_extract(addr, '\b\d+\b'), '0')) BETWEEN 1 AND 7 THEN CAST(regexp_extract(addr, '\b\d+\b') AS INTEGER) ELSE 0 END AS b_num,
    regexp_extract(addr, '\b[1-9]\d{{5}}\b|\b\d{{5}}\b') AS post
  FROM f0 WHERE nn IS NOT NULL AND nn <> '' AND c <> ''), f2 AS (
  SELECT *, array_to_string(list_filter(w, lambda x: NOT list_contains({legal}, x)), ' ') AS core,
    CASE WHEN len({base}) >= {p.least_core} THEN array_to_string(list_sort({base}), ' ') ELSE '' END AS sorted_core,
    list_distinct({kept}) AS toks, coalesce(list_filter({kept}, lambda x: length(x) >= 5)[1], '') AS brand,
    coalesce(list_filter({kept}, lambda x: length(x) >= 4)[1], '') AS first_tok, list_filter({kept}, lambda x: length(x) >= 3) AS name_toks,
    {street} AS s_tok, list_distinct(list_filter({plain}, lambda x: length(x) >= 3)) AS a_toks,
    list_filter(t, lambda x: NOT list_contains({both}, x) AND length(x) >= 3) AS addr_words,
    {state(p)} AS state, CASE WHEN c = 'india' THEN {metros} ELSE '' END AS metro,
    regexp_matches(name, '[\x{{0900}}-\x{{0D7F}}]') AS indic,
    list_distinct(list_transform(generate_series(1, greatest(length(flat) - 2, 1)), lambda i: substr(flat, i, 3))) AS grams
  FROM f1), f AS (SELECT *, {sound('brand')} AS brand_sound, {sound('s_tok') if p.street_phonetic else 's_tok'} AS street_key FROM f2)"""


# Channels ---------------------------------------------------------------------------------------------------


def channel_keys(p: Profile) -> str:
    ref = "src = 'S1'" if p.loose_probe else "false"
    strict = "AND (src = 'S1' OR core <> nn)" if p.strict_probe else ""
    table = {
        "exact": ("nn", "true"),
        "spaceless": ("flat", "length(nn) >= 6"),
        "core": ("core", f"core <> '' AND ({ref} OR core <> nn)"),
        "sorted": ("sorted_core", f"sorted_core <> '' AND ({ref} OR sorted_core <> core) {strict}"),
        "prefix": ("b_num || '|' || left(nn, 4)", "b_num > 0 AND length(nn) >= 4"),
        "number_token": ("b_num || '|' || first_tok", "b_num > 0 AND first_tok <> ''"),
        "anchor": ("b_num || '|' || street_key", "b_num > 0 AND s_tok <> ''"),
        "token_street": ("brand || '|' || s_tok", "brand <> '' AND s_tok <> ''"),
        "sound_street": ("s_tok || '|' || metro || '|' || brand_sound", "brand <> '' AND s_tok <> ''"),
        "brand_state": ("brand || '|' || state", "brand <> '' AND state <> ''"),
        "pin": ("post || '|' || left(nn, 4)", "post <> '' AND length(nn) >= 4"),
        "two_words": ("w[1] || '|' || w[2]", "len(w) >= 2"),
        "number_tokens": ("b_num || '|' || unnest(list_distinct(name_toks[:2]))", "b_num > 0 AND len(name_toks) > 0"),
    }
    return " UNION ALL ".join(f"SELECT entity_id, src, c, '{k}' AS channel, {table[k][0]} AS key FROM f WHERE {table[k][1]}" for k in p.channels)


def candidates(p: Profile) -> str:
    """CTEs up to cand (s1, cid, src, channel, bucket)."""
    side = "src = 'S1'" if p.index_side == "reference" else "src <> 'S1'"
    cap = "CASE channel " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in p.caps.items()) + " ELSE n END" if p.caps else "n"
    most = "CASE channel " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in p.suppress.items()) + " ELSE bucket END" if p.suppress else "bucket"
    ref, new = ("b", "k") if p.index_side == "reference" else ("k", "b")
    return f"""{features(p)}, k AS ({channel_keys(p)}), b0 AS (
  SELECT *, row_number() OVER (PARTITION BY c, channel, key ORDER BY entity_id) AS n FROM k WHERE {side}), b1 AS (
  SELECT *, count(*) OVER (PARTITION BY c, channel, key) AS bucket FROM b0 WHERE n <= {cap}), b AS (
  SELECT * FROM b1 WHERE bucket <= {most}), cand AS (
  SELECT {ref}.entity_id AS s1, {new}.entity_id AS cid, {new}.src AS src, k.channel, bucket
  FROM k JOIN b ON k.c = b.c AND k.channel = b.channel AND k.key = b.key AND {'k.src <> ' if p.index_side == 'reference' else 'k.src = '}'S1')"""


# Pairs ------------------------------------------------------------------------------------------------------

EQ, NEAR, MISSING, CONFLICT = "(l.b_num > 0 AND l.b_num = r.b_num)", "(l.b_num > 0 AND r.b_num > 0 AND abs(l.b_num - r.b_num) <= 2)", "(l.b_num = 0 OR r.b_num = 0)", "(l.b_num > 0 AND r.b_num > 0 AND l.b_num <> r.b_num)"
SHARED = "(len(list_intersect(l.a_toks, r.a_toks)) > 0)"
INITIAL = "(left(l.nn, 1) = left(r.nn, 1))"


def same(x: str) -> str:
    return f"(l.{x} <> '' AND l.{x} = r.{x})"


def differ(x: str) -> str:
    return f"(l.{x} <> '' AND r.{x} <> '' AND l.{x} <> r.{x})"


def jaccard(x: str) -> str:
    return f"(CASE WHEN len(l.{x}) = 0 OR len(r.{x}) = 0 THEN 0.0 ELSE len(list_intersect(l.{x}, r.{x})) / len(list_distinct(list_concat(l.{x}, r.{x}))) END)"


def similar(j: float, g: float) -> str:
    return f"({jaccard('toks')} >= {j} OR {jaccard('grams')} >= {g})"


def chain(*rules) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + " ELSE 0 END"


PROOF = f"({EQ} OR {same('post')} OR {SHARED})"
EMPTY = {
    "distinctive": "l.post = '' AND r.post = '' AND l.nn = r.nn AND len(l.toks) >= 3",
    "names": "l.nn = r.nn OR (l.core <> '' AND l.core = r.core AND len(string_split(l.core, ' ')) >= 2) OR (l.flat = r.flat AND length(r.nn) >= 6)",
    "words": "l.post = '' AND r.post = '' AND l.nn = r.nn AND (len(l.w) >= 3 OR (len(l.w) >= 2 AND length(l.nn) >= 14))",
}


def gate_reason(relaxed: bool, rule: str) -> str:
    twins = f"(list_sort([l.state, r.state]) = ['andhra pradesh', 'telangana'] AND {SHARED})"
    far = f"(l.b_num > 0 AND r.b_num > 0 AND abs(l.b_num - r.b_num) > 2)"
    if relaxed:
        far = f"({far} AND len(list_intersect(l.a_toks, r.a_toks)) < 2 AND {jaccard('a_toks')} < 0.25)"
    bare = f"((len(l.a_toks) = 0 OR len(r.a_toks) = 0) AND ({EMPTY[rule]}))"
    return f"CASE WHEN {differ('state')} AND NOT {twins} THEN 'state' WHEN {differ('metro')} THEN 'metro' WHEN {differ('post')} THEN 'postcode' WHEN {far} THEN 'building' WHEN NOT ({PROOF} OR {bare}) THEN 'no proof' END"


def _evidence(number: int, post: int, *rest: int) -> str:
    shared = [(SHARED, rest[0])] if len(rest) == 2 else []
    return chain((EQ, number), (same("post"), post), *shared, ("true", rest[-1]))


def _named(ladders: dict[str, tuple]) -> str:
    return chain(*((f"channel = '{k}'", v if isinstance(v, (int, str)) else chain(*v)) for k, v in ladders.items()))


def score(name: str) -> str:
    street = same("s_tok")
    if name == "equal":
        return "100"
    if name == "s1":
        return _named({"exact": ((EQ, 100), (f"{MISSING} AND bucket <= 3", 80)), "core": ((EQ, 90), (f"{MISSING} AND bucket <= 2", 75)), "anchor": 70})
    if name in ("s2", "s3"):
        part = lambda most, *v: ((EQ, v[0]), (f"{MISSING} AND bucket <= {most}", v[1]), (f"{MISSING} AND {street}", v[2]))
        anchor = (("bucket <= 2", 72), ("r.indic", 71), (INITIAL, 71), ("bucket <= 4", 70)) if name == "s2" else (("bucket = 1", 74), ("r.indic", 73), (INITIAL, 72), ("bucket <= 3", 70))
        return _named({"exact": part(3, 100, 80, 85), "core": part(2, 90, 75, 80), "sorted": part(2, 88, 75, 80), "number_token": ((street, 85), ("bucket = 1", 78)), "anchor": anchor})
    if name == "s4":
        return _named({"exact": ((EQ, 100), (CONFLICT, 0), ("bucket <= 6", 85), ("bucket <= 12", 80)), "core": ((EQ, 90), (CONFLICT, 0), ("bucket <= 3", 80)), "sorted": ((EQ, 88), (CONFLICT, 0), ("bucket <= 2", 80)), "prefix": 82, "anchor": ((f"bucket = 1 OR {INITIAL}", 75),), "token_street": 82, "pin": 82})
    if name == "s5":
        veto = (f"{differ('metro')} OR {differ('post')} OR {CONFLICT}", 0)
        post = (f"{same('post')} AND {MISSING}", 90)
        return _named({"exact": (veto, (EQ, 100), post, ("bucket <= 6", 85), ("bucket <= 12", 80)), "core": (veto, (EQ, 90), post, ("bucket <= 3", 80)), "sorted": (veto, (EQ, 88), post, ("bucket <= 2", 80)), "prefix": 84, "anchor": ((f"{jaccard('toks')} >= 0.33 OR {INITIAL}", 76),), "token_street": ((f"NOT {differ('metro')} AND ({jaccard('toks')} >= 0.3 OR length(l.brand) >= 7)", 85),), "pin": 84})
    if name in ("s6a", "s6b"):
        a = name == "s6a"
        veto = (f"{differ('metro')} OR {differ('post')}", 0)
        both, alone, anchor, token, first, floor = ((0.3, 0.4), (0.35, 0.5), (0.3, 0.45), (0.33, 0.45), 0.3, 86) if a else ((0.25, 0.35), (0.3, 0.4), (0.25, 0.35), (0.3, 0.4), 0.25, 84)
        return _named({
            "exact": (veto, (EQ, 100), (NEAR, 92), (f"{MISSING} AND {same('post')}", 94), (f"{MISSING} AND bucket <= 3", 90), (f"{MISSING} AND bucket <= 6", 84)),
            "core": (veto, (EQ, 94), (NEAR, 88), (f"{MISSING} AND bucket <= 2", 88)),
            "sorted": (veto, (EQ, 92), (NEAR, 86), (f"{MISSING} AND bucket <= 2", 84)),
            "prefix": (veto, (f"{street} AND {similar(*both)}", 92), (street, floor), (similar(*alone), 88)),
            "anchor": (veto, (f"{similar(*anchor)} OR ({INITIAL} AND {jaccard('grams')} >= {first})", 84)),
            "token_street": (veto, (similar(*token), 90)),
            "pin": ((similar(*token), 88),),
        })
    if name == "s7":
        near, shared = f"({street} OR len(list_intersect(l.addr_words, r.addr_words)) >= 1)", "len(list_intersect(l.name_toks, r.name_toks))"
        return chain((CONFLICT, 0), ("l.nn = r.nn", chain((EQ, 100), ("bucket <= 2", 92), ("bucket <= 5", 85), (near, 88))), (same("core"), chain((EQ, 95), ("bucket <= 2", 85), (near, 82))), (f"{shared} >= 2 AND {EQ}", 90), (f"{shared} >= 2 AND ({street} OR len(list_intersect(l.addr_words, r.addr_words)) >= 2)", 80), (f"{shared} >= 1 AND {EQ} AND {near}", 85), (f"{EQ} AND {street} AND bucket <= 4", 78))
    core_floor, sorted_floor, exact_floor = {"s8": (85, 85, 90), "s9": (84, 84, 90), "s10": (85, 85, 88)}[name]
    sims = {
        "s8": {"prefix": (90, 0.35, 0.45), "anchor": (88, 0.35, 0.45), "token_street": (92, 0.4, 0.5), "sound_street": (88, 0.45, 0.55), "pin": (88, 0.35, 0.45)},
        "s9": {"prefix": (90, 0.3, 0.4), "anchor": (88, 0.3, 0.4), "token_street": (92, 0.35, 0.45), "sound_street": (88, 0.4, 0.5), "brand_state": (88, 0.35, 0.45), "pin": (88, 0.35, 0.45)},
        "s10": {"prefix": (90, 0.35, 0.45), "anchor": (88, 0.35, 0.45), "token_street": (92, 0.4, 0.5), "sound_street": (88, 0.45, 0.55), "pin": (88, 0.38, 0.48)},
    }[name]
    single = f"len(string_split(r.core, ' ')) = 1 AND NOT {EQ} AND NOT {same('post')}"
    return _named({
        "exact": _evidence(100, 98, 95, exact_floor), "core": ((single, 0), ("true", _evidence(95, 92, 88, core_floor))), "sorted": _evidence(92, 90, sorted_floor), "spaceless": 95,
        **{k: ((similar(j, g), v),) for k, (v, j, g) in sims.items()},
    })


def scored(p: Profile) -> str:
    """CTEs up to scored (s1, src, cid, channel, bucket, score)."""
    gate = f"WHERE ({gate_reason(*p.gate)}) IS NULL" if p.gate else ""
    found = "cand" if p.merge != "union" else "(SELECT s1, cid, src, 'union' AS channel, count(*) OVER (PARTITION BY s1) AS bucket FROM (SELECT DISTINCT s1, cid, src FROM cand))"
    return f"{candidates(p)}, scored AS (SELECT s1, x.src, cid, channel, bucket, {score(p.scorer)} AS score FROM {found} x JOIN f l ON l.entity_id = s1 JOIN f r ON r.entity_id = cid {gate})"


def _step(p: Profile) -> str:
    order = ["exact", "spaceless", "core", "sorted", "prefix", "number_token", "anchor"]
    return "CASE channel " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(order)) + " END"


def chosen(p: Profile) -> str:
    """CTEs up to chosen (s1, src, cid, score, rank)."""
    hits = f"{scored(p)}, hits AS (SELECT * FROM scored WHERE score > 0 AND score >= {p.threshold})"
    best = "SELECT s1, src, cid, max(score) AS score FROM {0} GROUP BY ALL"
    merged = {
        "max": best.format("hits"), "union": best.format("hits"), "append": "SELECT s1, src, cid, score FROM hits",
        "fallback": best.format("(SELECT * FROM hits h WHERE channel <> 'core' OR NOT EXISTS (SELECT 1 FROM hits e WHERE e.s1 = h.s1 AND e.channel = 'exact'))"),
        "both_empty": best.format(f"(SELECT *, min({_step(p)}) OVER (PARTITION BY s1) AS least FROM hits) WHERE {_step(p)} = least"),
        "ladder": f"SELECT s1, src, cid, score FROM (SELECT *, min({_step(p)}) OVER (PARTITION BY s1, src) AS least, row_number() OVER (PARTITION BY s1, src, channel ORDER BY cid) AS nth FROM hits) WHERE {_step(p)} = least AND (channel = 'exact' OR nth = 1)",
    }[p.merge]
    out = f"{hits}, merged AS ({merged})"
    if p.match_cap:
        out += f", capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY cid) AS arrival FROM merged) WHERE arrival <= {p.match_cap})"
    tie = "cid" if p.tiers else "cid DESC"
    keep = " OR ".join(f"(rank <= {r} AND score >= {s})" for r, s in p.tiers) or (f"rank <= {p.top}" if p.top else "true")
    ranked = f"SELECT s1, src, cid, score, row_number() OVER (PARTITION BY s1, src ORDER BY score DESC, {tie}) AS rank FROM {'capped' if p.match_cap else 'merged'}"
    if p.merge == "append":
        return out + f", chosen AS (SELECT s1, src, cid, max(score) AS score, min(rank) AS rank FROM ({ranked}) WHERE {keep} GROUP BY ALL)"
    return out + f", chosen AS (SELECT * FROM ({ranked}) WHERE {keep})"


def matches(profile: str) -> str:
    """source1_entity_id and ids (comma list) of every reference record."""
    p = PROFILES[profile]
    order = "src, rank" if p.index_side == "reference" else "cid"
    return f"WITH {chosen(p)} SELECT l.entity_id AS source1_entity_id, coalesce(string_agg(cid, ',' ORDER BY {order}), '') AS ids FROM (SELECT DISTINCT entity_id FROM records WHERE entity_id LIKE 'S1-%') l LEFT JOIN chosen ON s1 = l.entity_id GROUP BY l.entity_id"


def candidate_lists(profile: str) -> str:
    p = PROFILES[profile]
    seen = "scored"
    extra = ""
    if p.merge in ("ladder", "both_empty", "fallback"):
        need = {"ladder": f"n < 2 OR n IS NULL OR {_step(p)} <= last", "both_empty": f"n IS NULL OR {_step(p)} <= first", "fallback": "channel <> 'core' OR coalesce(exact, 0) = 0"}[p.merge]
        extra = f", firsts AS (SELECT s1, src, min({_step(p)}) AS step, max(CASE WHEN channel = 'exact' THEN 1 ELSE 0 END) AS exact FROM hits GROUP BY ALL), need AS (SELECT s1, min(step) AS first, max(step) AS last, count(*) AS n, max(exact) AS exact FROM firsts GROUP BY s1), seen AS (SELECT scored.* FROM scored LEFT JOIN need USING (s1) WHERE {need})"
        seen = "seen"
    least = "WHERE score > 0" if p.index_side == "reference" else ""
    cap = f"WHERE n <= {p.candidate_cap}" if p.candidate_cap else ""
    return f"WITH {chosen(p)}{extra}, listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, src ORDER BY cid) AS n FROM (SELECT DISTINCT s1, src, cid FROM {seen} {least})) {cap}) SELECT l.entity_id AS source1_entity_id, coalesce(string_agg(cid, ',' ORDER BY cid), '') AS ids FROM (SELECT DISTINCT entity_id FROM records WHERE entity_id LIKE 'S1-%') l LEFT JOIN listed ON s1 = l.entity_id GROUP BY l.entity_id"


def channel_pairs(profile: str, channel: str) -> str:
    return f"WITH {candidates(PROFILES[profile])} SELECT DISTINCT s1, cid, src FROM cand WHERE channel = '{channel}'"


def gate_reasons(profile: str) -> str:
    p = PROFILES[profile]
    return f"WITH {candidates(p)} SELECT s1, cid, coalesce({gate_reason(*p.gate)}, 'pass') AS reason FROM (SELECT DISTINCT s1, cid FROM cand) x JOIN f l ON l.entity_id = s1 JOIN f r ON r.entity_id = cid"


def channel_scores(profile: str) -> str:
    return f"WITH {scored(PROFILES[profile])} SELECT s1, src, cid, channel, score FROM scored"
