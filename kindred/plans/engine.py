"""A profile from records to matches."""

from __future__ import annotations

from collections import deque

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..operators import blocking, scoring, selection
from .profiles import PROFILES, Profile


_KEPT: deque[DataFrame] = deque()
KEEP = 4


def kept(df: DataFrame) -> DataFrame:
    """Stored when first used, because keys and both sides of the pairs read it; blocks that are lost or let go (only
    the last KEEP tables are held) are computed again."""
    while len(_KEPT) >= KEEP:
        old = _KEPT.popleft()
        if old.sparkSession.sparkContext._jsc is not None:
            old.unpersist()
    _KEPT.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _KEPT[-1]


def scored_pairs(records: DataFrame, profile: Profile | str) -> tuple[DataFrame, DataFrame]:
    """(features, pairs with channel, bucket and score); gated pairs only, also with score 0."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    features = kept(blocking.with_features(records, p))
    found = blocking.candidates(features, p)
    if p.merge == "union":  # each pair once, beside the number of its reference record's candidates
        found = found.select("s1", "cid", "src").distinct()
        found = found.join(found.groupBy("s1").agg(F.count("*").alias("bucket")), "s1").withColumn("channel", F.lit("union"))
    pairs = blocking.paired(found, features)
    if p.gate:
        pairs = pairs.where(S.gate(scoring.L, scoring.R, *p.gate))
    return features, pairs.select("s1", "src", "cid", "channel", "bucket", scoring.SCORERS[p.scorer]().alias("score"))


def accepted(pairs: DataFrame, p: Profile) -> DataFrame:
    return pairs.where(F.col("score") > 0).where(F.col("score") >= p.threshold)


def select(pairs: DataFrame, p: Profile) -> DataFrame:
    """Accepted (s1, src, cid, score, rank)."""
    hits = accepted(pairs, p)
    if p.merge == "append":
        return selection.top_k_rows(hits, p.top)
    merged = {"max": selection.max_merge, "union": selection.max_merge, "ladder": selection.ladder, "fallback": selection.fallback, "both_empty": selection.both_empty}[p.merge](hits)
    if p.match_cap:
        merged = selection.first_n(merged, p.match_cap)
    if p.tiers:
        return selection.tiered(merged, p.tiers)
    if p.top:
        return selection.top_k(merged, p.top)
    return merged.withColumn("rank", F.lit(1))


def equal_names(records: DataFrame, p: Profile) -> DataFrame:
    """``match`` of a profile that takes every pair of equal keys: the targets of a key are one list, made once and
    shared by its reference records, instead of a row a pair."""
    by = ["country", "channel", "key"]
    postings = kept(blocking.keys(blocking.with_features(records, p), p))
    found = postings.where("src <> 'S1'").groupBy(*by).agg(F.sort_array(F.collect_set("entity_id")).alias("ids"))
    own = postings.where("src = 'S1'").groupBy("entity_id").agg(F.collect_set(F.struct(*by)).alias("keys"))
    ref = records.where("entity_id like 'S1-%'").select("entity_id").distinct().join(own, "entity_id", "left").withColumn("n", F.coalesce(F.size("keys"), F.lit(0)))
    one = ref.where("n <= 1").withColumn("k", F.get("keys", F.lit(0))).select("entity_id", "k.*").join(found, by, "left").select("entity_id", "ids")
    many = ref.where("n > 1").select("entity_id", F.explode("keys").alias("k")).select("entity_id", "k.*").join(found, by)
    many = many.groupBy("entity_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))  # rows that share an id
    many = ref.where("n > 1").select("entity_id").join(many, "entity_id", "left")
    return one.unionByName(many).select(F.col("entity_id").alias("source1_entity_id"), F.coalesce("ids", F.array().cast("array<string>")).alias("matched_entity_ids"))


def match(records: DataFrame, profile: Profile | str) -> DataFrame:
    """source1_entity_id and matched_entity_ids (array) for every reference record."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    if p.channels == ("exact",) and (p.scorer, p.merge, p.index_side) == ("equal", "max", "targets") and not (p.gate or p.caps or p.suppress or p.top or p.tiers or p.match_cap or p.threshold > 100):
        return equal_names(records, p)
    _, pairs = scored_pairs(records, p)
    reference = records.where("entity_id like 'S1-%'").select("entity_id").distinct()
    return selection.lists(select(pairs, p), reference, ranked=p.index_side == "reference")


def candidate_lists(records: DataFrame, profile: Profile | str) -> DataFrame:
    """source1_entity_id and candidate_entity_ids: pairs looked at, whatever their score; profiles that index the
    reference list the first candidate_cap a source that scored."""
    p = PROFILES[profile] if isinstance(profile, str) else profile
    _, pairs = scored_pairs(records, p)
    if p.index_side == "reference":
        pairs = pairs.where(F.col("score") > 0)
    seen = selection.max_merge(selection.visited(pairs, accepted(pairs, p), p.merge))
    seen = selection.first_n(seen, p.candidate_cap) if p.candidate_cap else seen
    reference = records.where("entity_id like 'S1-%'").select("entity_id").distinct()
    return selection.lists(seen, reference, False, "candidate_entity_ids")
